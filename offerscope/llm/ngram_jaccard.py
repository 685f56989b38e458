"""Exact self-join of documents by Jaccard similarity of word shingles, with a
token-group matrix.

Documents with equal shingle sets are one vertex.  Shingles are ordered from
rare to common (by a count sketch over all shingles, then by hash); two sets
of similarity ``NEED``/100 share one of the first quarter of each, their
prefix, so only prefixes are indexed.

1. Stars: in each prefix token's list, every vertex is compared with the least
   and the greatest vertex.  What links is one group; all other vertices are
   groups of their own.  A large cluster of near copies costs a few
   comparisons a member.
2. Matrix: each group's union of prefix tokens, as (token, group) rows.  A
   vertex queries the groups that share a token with it; the number of its
   prefix tokens in a group's union bounds its overlap with every member, and
   only groups that pass are opened, in blocks of members.  Members of one
   group are never compared with each other again.
3. Pairs from both steps go through parity bitmaps (the bits in which two
   bitmaps differ are at most the sets' difference, an exact bound) and are
   then decided on the whole sets.

Links between vertices that steps 1 and 2 leave out lie within one group, so
components are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, python_stages, text_or_empty
from .components import components
from .shingles import mix, shingle_sets

NEED = 75               # 100 * intersection >= NEED * union; prefixes and bounds follow from it
CELLS = 1 << 16         # of the count sketch; a fixed size
BLOOM = 1 << 24         # bits that mark documents whose sets are read again; a fixed size
BAND = 1.1              # ratio of the set sizes of a band
BLOCK = 32              # members of a group tested together, on average
SEEN = 200_000          # vertices a task remembers, to emit copies once


def set_key(s: np.ndarray) -> int:
    """64-bit key of a set."""
    with np.errstate(over="ignore"):
        h = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)
        return int(mix(np.asarray([h], np.uint64)).view(np.int64)[0])


def parity_bits(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the set's hashes end in i; a power
    of two of bits, at least four a hash."""
    size = 64
    while size < 4 * len(s):
        size *= 2
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(x: bytes, nx: int, y: bytes, ny: int) -> bool:
    """False only if the sets cannot link: a link leaves at most
    nx + ny - 2 * overlap differing elements.  The wider bitmap is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    differ = int(np.bitwise_count(a ^ b).sum())
    least = -(-NEED * (nx + ny) // (100 + NEED))
    return differ <= nx + ny - 2 * least


def prefix_length(n: int) -> int:
    return n - -(-NEED * n // 100) + 1


def _scan(batches):
    import pyarrow as pa
    cells = np.zeros(CELLS, np.int64)
    names = ["doc_id", "n", "key", "bits", "cell", "count"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist())
        if sum(map(len, sets)):
            cells += np.bincount((np.concatenate(sets) >> np.uint64(48)).astype(np.int64), minlength=CELLS)
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([parity_bits(s) if len(s) else None for s in sets], pa.binary()), none, none], names=names)
    used = np.flatnonzero(cells)
    columns = [pa.nulls(len(used), k) for k in kinds[:4]] + [pa.array(used, pa.int64()), pa.array(cells[used], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def rarity_classes(cells: np.ndarray) -> np.ndarray:
    """Class of each cell: 0, or the size of what it holds beyond a usual
    cell.  Any order gives right results; this one keeps common shingles out
    of prefixes."""
    usual = cells.mean()
    beyond = cells - usual
    return np.where(beyond > 8 * np.sqrt(usual) + 8, np.floor(np.log2(np.maximum(beyond, 1))), 0).astype(np.int64)


def _prefixes(batches, classes: np.ndarray):
    import pyarrow as pa
    seen: set[int] = set()
    for batch in batches:
        tokens, keys, sizes = [], [], []
        for s in shingle_sets(batch.column(0).to_pylist()):
            if not len(s):
                continue
            key = set_key(s)
            if key in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(key)
            rare = classes[(s >> np.uint64(48)).astype(np.int64)]
            first = s[np.argsort(rare, kind="stable")[:prefix_length(len(s))]]     # s is sorted: ties by hash
            tokens.append(first.view(np.int64))
            keys.append(np.full(len(first), key))
            sizes.append(np.full(len(first), len(s)))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (tokens, keys, sizes)], names=["token", "key", "n"])


def _bounded(batches):
    """Pairs (a, na, x, b, nb, y) whose bitmaps allow a link."""
    import pyarrow as pa
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns])
        fine = [(a, b) for a, na, x, b, nb, y in rows if may_link(x, na, y, nb)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in fine], pa.int64()), pa.array([f[1] for f in fine], pa.int64())], names=["a", "b"])


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _bounded_blocks(batches):
    """Pairs (a, b) of queries (a, na, x) and the members (b, nb, y) of a block
    that sizes and bitmaps allow; a block's bitmaps are tested at once."""
    import pyarrow as pa
    for batch in batches:
        left, right = [], []
        for a, na, x, block in zip(*[c.to_pylist() for c in batch.columns]):
            x = np.frombuffer(x, np.uint8)
            for width in {len(m["y"]) for m in block}:
                same = [m for m in block if len(m["y"]) == width]
                nb = np.asarray([m["nb"] for m in same])
                y = np.frombuffer(b"".join(m["y"] for m in same), np.uint8).reshape(len(same), width)
                narrow = min(width, len(x))
                differ = np.bitwise_count(_fold(y, narrow) ^ _fold(x, narrow)).sum(axis=1, dtype=np.int64)
                least = -(-NEED * (na + nb) // (100 + NEED))
                fine = (100 * nb >= NEED * na) & (100 * na >= NEED * nb) & (differ <= na + nb - 2 * least)
                right += [same[i]["b"] for i in np.flatnonzero(fine)]
            left += [a] * (len(right) - len(left))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _sets_of(batches, bloom: np.ndarray):
    import pyarrow as pa
    for batch in batches:
        cell = batch.column(1).to_numpy(zero_copy_only=False)
        wanted = np.flatnonzero(bloom[cell >> 3] >> (cell & 7) & 1)
        sets = [s for s in shingle_sets(batch.column(0).take(pa.array(wanted)).to_pylist()) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "hashes"])


def _linked(batches):
    import pyarrow as pa
    for batch in batches:
        out = []
        for a, x, b, y in zip(*[c.to_pylist() for c in batch.columns]):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * common >= NEED * (len(s) + len(t) - common):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


class JaccardJoin:
    """One run over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        python_stages(self.spark)
        self.scratch = Scratch(self.spark, "ngram-jaccard")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def run(self) -> DataFrame:
        write = self.scratch.write
        scan = write(self.docs.mapInArrow(_scan, "doc_id long, n long, key long, bits binary, cell long, count long"), "scan")
        cells = np.zeros(CELLS, np.int64)
        for r in scan.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("count").alias("count")).collect():
            cells[r["cell"]] = r["count"]
        found = scan.where("cell IS NULL").select("doc_id", "n", "key", "bits")
        # A null doc_id is no vertex of its own, but its set counts like any.
        self.vertices = write(found.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "vertices")
        shared = self._shared(rarity_classes(cells))
        stars = write(self._decided(write(self._bounded(self._stars(shared)), "stars-pairs"), "stars"), "star-links")
        groups = components(stars, self.scratch, "groups")
        more = write(self._decided(write(self._opened(shared, groups), "opened-pairs"), "opened"), "group-links")
        self.links = stars.unionByName(more)
        roots = components(self.links, self.scratch, "components")
        member = self.vertices.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        lowest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
        known = member.join(lowest, "root").select("key", "component_id")
        joined = found.where("key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n", "key").join(known, "key").select("doc_id", "n", "component_id")
        alone = found.where("key IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return joined.unionByName(alone).withColumnRenamed("n", "n_shingles")

    def _shared(self, classes: np.ndarray) -> DataFrame:
        """(token, key, n) of prefix tokens that several vertices have, with the
        list's least and greatest vertex."""
        shared = self.spark.sparkContext.broadcast(classes)     # CELLS numbers
        rows = self.docs.where("doc_id IS NOT NULL").select("text").mapInArrow(lambda it: _prefixes(it, shared.value), "token long, key long, n long")
        listed = Window.partitionBy("token")
        once = rows.repartition("token").dropDuplicates(["token", "key"])
        spread = once.withColumns({"low": F.min("key").over(listed), "high": F.max("key").over(listed)})
        return self.scratch.write(spread.where("low < high"), "shared")

    def _stars(self, shared: DataFrame) -> DataFrame:
        return (shared.select(F.col("key").alias("a"), F.col("n").alias("na"), F.explode(F.array_distinct(F.array("low", "high"))).alias("b"))
                .where("a <> b").distinct())

    def _opened(self, shared: DataFrame, groups: DataFrame) -> DataFrame:
        """(a, b): queries and members of the groups they open, as far as the
        bitmaps allow a link.  A group is opened in blocks of about ``BLOCK``
        members, so no row stands for one pair before its bitmaps are tested."""
        # A group's union is kept by size band: the bound needs the members'
        # sizes, and a wide range of them would make it weak.
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
        sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        of = groups.join(sizes, "root").select(F.col("node").alias("key"), "root", "size")
        rows = (shared.select("token", "key", "n").join(of, "key", "left")
                .select("token", "key", "n", F.coalesce("root", "key").alias("g"), F.coalesce("size", F.lit(1)).alias("size"), band.alias("band")))
        rows = self.scratch.write(rows, "incidence")
        matrix = (rows.groupBy("token", F.col("g").alias("to"), F.col("band").alias("to_band")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("size").alias("to_size")))
        # The vertex of the smaller group asks.
        asks = (F.col("size") < F.col("to_size")) | ((F.col("size") == F.col("to_size")) & (F.col("g") < F.col("to")))
        fits = (100 * F.col("n") >= NEED * F.col("least")) & (100 * F.col("most") >= NEED * F.col("n"))
        overlap = (rows.join(matrix, "token").where(asks & fits)
                   .groupBy("key", "to", "to_band").agg(F.count(F.lit(1)).alias("overlap"), F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("to_size").alias("to_size")))
        n, share = F.col("n"), NEED / (100 + NEED)
        low = F.greatest("least", F.ceil(n * (NEED / 100)))
        high = F.least("most", F.floor(n * (100 / NEED)))
        # Common prefix tokens that a link needs: its overlap less what follows
        # either prefix.  Both forms are linear in the member's size.
        need = F.least(share * (n + low) - n * (NEED / 100), share * (n + high) - high * (NEED / 100)) - 1e-6
        blocks = lambda size: F.ceil(F.col(size) / BLOCK)
        opened = (overlap.where(F.col("overlap") >= need)
                  .select(F.col("key").alias("a"), F.col("n").alias("na"), "to", "to_band", F.explode(F.sequence(F.lit(0).cast("long"), blocks("to_size") - 1)).alias("block")))
        bits = self.vertices.select("key", "bits")
        members = (rows.select("g", "band", "key", "n", "size").distinct().join(bits, "key")
                   .groupBy(F.col("g").alias("to"), F.col("band").alias("to_band"), F.pmod(F.xxhash64("key"), blocks("size")).alias("block"))
                   .agg(F.collect_list(F.struct(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))).alias("members")))
        asked = opened.join(bits.select(F.col("key").alias("a"), F.col("bits").alias("x")), "a").join(members, ["to", "to_band", "block"])
        return asked.select("a", "na", "x", "members").mapInArrow(_bounded_blocks, "a long, b long")

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, na, b) whose sizes and bitmaps allow a link."""
        bits = self.vertices.select("key", "n", "bits")
        right = bits.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
        sized = (100 * F.col("nb") >= NEED * F.col("na")) & (100 * F.col("na") >= NEED * F.col("nb"))
        both = pairs.join(right, "b").where(sized).join(bits.select(F.col("key").alias("a"), F.col("bits").alias("x")), "a")
        return both.select("a", "na", "x", "b", "nb", "y").mapInArrow(_bounded, "a long, b long")

    def _decided(self, kept: DataFrame, name: str) -> DataFrame:
        """The links among pairs (a, b), on whole sets."""
        wanted = kept.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        cell = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM))
        marked = (self.vertices.select("key", F.col("rep").alias("doc_id")).join(wanted, "key").select(cell.alias("cell"))
                  .groupBy(F.expr("cell DIV 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(cell % 32))")).alias("on")).collect())
        bloom = np.zeros(BLOOM // 32, np.uint32)
        for r in marked:
            bloom[r["word"]] = r["on"]
        shared = self.spark.sparkContext.broadcast(bloom.view(np.uint8))    # BLOOM / 8 bytes
        sets = (self.docs.select("text", cell.alias("cell")).mapInArrow(lambda it: _sets_of(it, shared.value), "key long, hashes binary")
                .join(wanted, "key", "left_semi").dropDuplicates(["key"]))
        sets = self.scratch.write(sets, f"{name}-sets")
        a = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
        b = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
        return kept.join(a, "a").join(b, "b").select("a", "x", "b", "y").mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest ``doc_id`` reachable
    by links, itself included) of every row of ``docs`` (doc_id, text).

    Null or wordless text has no shingles and links with nothing; so does a
    null ``doc_id``, whose component is null.  Repeated rows each get their row;
    rows that share a ``doc_id`` are compared as texts of their own.  Other
    columns are not read; an empty table gives no rows."""
    return JaccardJoin(docs).run()
