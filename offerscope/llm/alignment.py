"""Alignment of the tokens of two tokenizers over the same bytes.

Both token sequences of a text end at byte offsets.  Divide and conquer at
shared cuts: in an interval, a common end near the middle is located by
bisecting the other sequence's ends, probing outward from the middle; the two
halves are treated alike, and an interval without a common end is a leaf group.
All open intervals of a batch are probed at once, so the steps are array
operations.

A single blank between words, and a single line feed, is always a common end
(neither vocabulary has a token across them; ``_units``), so the recursion's
upper levels are these cuts and a word's alignment is remembered.  A text with
other white space is aligned whole.

Id pairs are counted over all documents in which they are linked.  The counts
of the most frequent pairs, a bounded table, are looked up in the Python stage;
those of all others are joined."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, python_stages
from .encode import _ODD_BLANK, _ODD_SPACE

UNITS = 300_000          # words remembered a worker, about 200 MB
HEAD = 1 << 17           # pairs whose counts are sent to every worker: 17 bytes each
MERGE = 1 << 22          # keys counted at once
_DENSE = 1 << 12         # token pairs of one group listed one by one
_LINES = re.compile(r"\S+(?:\n\S+)+")


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indices into ``a`` of the common ends inside each interval
    ``first .. last`` (the ends at ``last - 1``, which close it, left out).
    ``a`` and ``b`` are ascending."""
    lo, hi = first, last - 1
    step = np.zeros(len(lo), np.int64)
    some = lo < hi
    lo, hi, step, found = lo[some], hi[some], step[some], []
    while len(lo):
        middle = lo + (hi - lo) // 2
        probe = middle + np.where(step & 1, -(step + 1) // 2, step // 2)
        at = np.minimum(np.searchsorted(b, a[probe]), len(b) - 1)
        hit = b[at] == a[probe]
        cut, left, right = probe[hit], lo[hit], hi[hit]
        found.append(cut)
        go_on = ~hit & (step + 1 < hi - lo)
        lo, hi, step = (np.concatenate([left, cut + 1, lo[go_on]]), np.concatenate([cut, right, hi[go_on]]),
                        np.concatenate([np.zeros(2 * len(cut), np.int64), step[go_on] + 1]))
        some = lo < hi
        lo, hi, step = lo[some], hi[some], step[some]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def _units(text: str) -> list[str] | None:
    """Parts of a text that are aligned on their own: words without their
    leading blank, later lines of a word with their line feed; None if the
    text has to be taken whole."""
    if _ODD_SPACE.search(" " + text) or _ODD_BLANK.search(text):
        return None
    out = text.split(" ")
    if "\n" not in text:
        return out
    cut = []
    for p in out:
        if "\n" in p and _LINES.fullmatch(p):
            head, *rest = p.split("\n")
            cut.append(head)
            cut += ["\n" + x for x in rest]
        else:
            cut.append(p)
    return cut


class _Units(dict):
    """Number of each unit; a new one is noted for the next ``_resolve``."""

    def __init__(self):
        self.new: list[str] = []
        self.n = 0

    def __missing__(self, unit: str) -> int:
        k = self[unit] = self.n
        self.n += 1
        self.new.append(unit)
        return k


class Aligner:
    """Aligns texts in the two tokenizers' files: ``path_a`` of the tokenizers
    library (byte level), ``path_b`` of sentencepiece."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        from .speculative_bpe import byte_letters
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: bytes([k]) for c, k in byte_letters().items()}
        n_a = self.a.get_vocab_size()
        self.bytes_a = [b"".join(letters.get(c, c.encode()) for c in self.a.id_to_token(k) or "") for k in range(n_a)]
        self.n_b = self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k in range(self.n_b) for p in [self.b.id_to_piece(k)]]
        self.size_a, self.size_b = (np.asarray([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Strings of an id inside and at the end of its side of a group; A's, then B's.
        self.strings = [f"{k}{s}" for k in range(n_a) for s in ",|"] + [f"{k}{s}" for k in range(self.n_b) for s in ",;"]
        self.shift_b = 2 * n_a
        self.small = n_a * self.n_b < 1 << 32
        self._forget()

    def _forget(self) -> None:
        self.units = _Units()
        self.groups: list[str] = []
        self.counts = np.empty((0, 5), np.int64)          # tokens a, b, groups, links, 1 if the bytes differ
        self.first = np.zeros(1, np.int64)                # of each unit's pairs
        self.keys, self.times = np.empty(0, np.uint64), np.empty(0, np.int64)

    def _encode(self, new: list[str]) -> tuple[list[list[int]], list[list[int]], list[bytes]]:
        lines = [x[:1] == "\n" for x in new]
        a = [e.ids for e in self.a.encode_batch_fast([x if line else " " + x for x, line in zip(new, lines)], add_special_tokens=False)]
        b = self.b.encode(new, num_threads=1)
        # B adds a blank in front of a line feed, a piece of its own.
        return a, [ids[1:] if line else ids for ids, line in zip(b, lines)], [(x if line else " " + x).encode() for x, line in zip(new, lines)]

    def _resolve(self, whole: set[int]) -> None:
        """Aligns the units noted since the last call; ``whole``: those that
        are texts of their own (and may begin with a line feed)."""
        new, base = self.units.new, len(self.groups)
        if not new:
            return
        self.units.new = []
        if whole:
            ids_a, ids_b, raw = [], [], []
            for k, x in enumerate(new):
                if base + k in whole:
                    ids_a.append(self.a.encode(" " + x, add_special_tokens=False).ids)
                    ids_b.append(self.b.encode(x))
                    raw.append((" " + x).encode())
                else:
                    one = self._encode([x])
                    ids_a += one[0]
                    ids_b += one[1]
                    raw += one[2]
        else:
            ids_a, ids_b, raw = self._encode(new)
        same = np.asarray([b"".join(map(self.bytes_a.__getitem__, x)) == r and b"".join(map(self.bytes_b.__getitem__, y)) == r
                           for x, y, r in zip(ids_a, ids_b, raw)])
        for k in np.flatnonzero(~same):
            ids_a[k], ids_b[k] = [], []
        self._align(ids_a, ids_b, same)

    def _align(self, ids_a: list[list[int]], ids_b: list[list[int]], same: np.ndarray) -> None:
        n = len(ids_a)
        len_a, len_b = (np.fromiter(map(len, x), np.int64, n) for x in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64, int(k.sum())) for ids, k in ((ids_a, len_a), (ids_b, len_b)))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        last_a, some = np.cumsum(len_a), len_a > 0
        cuts = shared_cuts(end_a, end_b, (last_a - len_a)[some], last_a[some])
        # Groups end at the cuts and at the units' ends.
        g_a = np.sort(np.concatenate([cuts, last_a[some] - 1]))
        g_b = np.searchsorted(end_b, end_a[g_a])
        n_a, n_b = np.diff(g_a, prepend=-1), np.diff(g_b, prepend=-1)
        unit = np.searchsorted(last_a, g_a, side="right")
        # Each group's ids as strings, A's then B's.
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        close_a, close_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        close_a[g_a], close_b[g_b] = 1, 1
        group_a, group_b = np.searchsorted(g_a, np.arange(len(flat_a))), np.searchsorted(g_b, np.arange(len(flat_b)))
        codes[np.arange(len(flat_a)) + (g_b + 1 - n_b)[group_a]] = 2 * flat_a + close_a
        codes[np.arange(len(flat_b)) + (g_a + 1)[group_b]] = self.shift_b + 2 * flat_b + close_b
        parts = list(map(self.strings.__getitem__, codes.tolist()))
        at, texts = 0, []
        for k in (len_a + len_b).tolist():
            texts.append("".join(parts[at:at + k])[:-1])
            at += k
        self.groups += texts
        # Linked id pairs of each unit, with their number.
        product = n_a * n_b
        thin = product <= _DENSE
        p, s_a, s_b, w_b = product[thin], (g_a + 1 - n_a)[thin], (g_b + 1 - n_b)[thin], n_b[thin]
        inside = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
        a, b = np.repeat(s_a, p) + inside // np.repeat(w_b, p), np.repeat(s_b, p) + inside % np.repeat(w_b, p)
        keys, owner, times = flat_a[a] * self.n_b + flat_b[b], np.repeat(unit[thin], p), np.ones(len(a), np.int64)
        for g in np.flatnonzero(~thin):      # a wide leaf: by its distinct ids
            (x, kx), (y, ky) = (np.unique(flat[e + 1 - m:e + 1], return_counts=True) for flat, e, m in ((flat_a, g_a[g], n_a[g]), (flat_b, g_b[g], n_b[g])))
            keys = np.concatenate([keys, (x[:, None] * self.n_b + y).reshape(-1)])
            times = np.concatenate([times, (kx[:, None] * ky).reshape(-1)])
            owner = np.concatenate([owner, np.full(len(x) * len(y), unit[g])])
        owner, keys, times = merged(owner, keys.astype(np.uint64), times)
        links = np.bincount(unit, weights=product, minlength=n).astype(np.int64) if len(unit) else np.zeros(n, np.int64)
        self.counts = np.concatenate([self.counts, np.stack([len_a, len_b, np.bincount(unit, minlength=n), links, ~same], 1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner, minlength=n))])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])

    def align(self, texts: list[str | None]) -> list[tuple]:
        """Of each text: tokens of A and of B, groups, links, the groups as
        text, its distinct linked pairs (A's id times B's vocabulary plus B's
        id; ascending) and how often each is linked.  Zeros and '' if the text
        is null or empty or a tokenizer does not keep its bytes."""
        if len(self.units) > UNITS or len(self.keys) > 16 * UNITS:
            self._forget()
        whole: set[int] = set()
        known, rows = self.units.__getitem__, []
        for t in texts:
            parts = _units(t) if t else []
            if parts is None:
                self.units.pop(t, None)      # the same string as a word's rest of a line is another unit
                whole.add(known(t))
                rows.append([self.units.pop(t)])
            else:
                rows.append(list(map(known, parts)))
        self._resolve(whole)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        units = np.fromiter((u for r in rows for u in r), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(rows)), size)
        n = np.stack([np.bincount(doc, weights=self.counts[units, c], minlength=len(rows)) for c in range(5)], 1).astype(np.int64)
        off = (size == 0) | (n[:, 4] > 0)
        n[off] = 0
        take = ~off[doc]
        units, doc = units[take], doc[take]
        many = self.first[units + 1] - self.first[units]
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[units], many)
        owner, keys, times = merged(np.repeat(doc, many), self.keys[place], self.times[place])
        cut = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
        groups = self.groups.__getitem__
        return [(*n[k, :4].tolist(), "" if off[k] else ";".join(map(groups, rows[k])), keys[cut[k]:cut[k + 1]], times[cut[k]:cut[k + 1]])
                for k in range(len(rows))]


def merged(owner: np.ndarray, keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (owner, key) as one, their times added; sorted by both."""
    if not len(keys):
        return owner, keys, times
    if int(keys.max()) < 1 << 40 and int(owner.max()) < 1 << 23:
        order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | keys, kind="stable")
    else:
        order = np.lexsort([keys, owner])
    owner, keys, times = owner[order], keys[order], times[order]
    begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])]))
    return owner[begin], keys[begin], np.add.reduceat(times, begin)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner a worker process."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_NUMBERS = "n_a long, n_b long, n_groups long, n_links long"


def _aligned(batches, path_a: str, path_b: str, keep_groups: bool) -> Iterator:
    import pyarrow as pa
    tool = aligner(path_a, path_b)
    for batch in batches:
        rows = tool.align(batch.column(1).to_pylist())
        n_a, n_b, n_groups, n_links, groups, keys, times = zip(*rows) if rows else [()] * 7
        # Keys as differences: small numbers, which the files' compression likes.
        gaps = [np.diff(k, prepend=np.uint64(0)).astype("<u4" if tool.small else "<u8").tobytes() for k in keys]
        out = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)],
               pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
               pa.array([g if keep_groups else None for g in groups], pa.string()),
               pa.array(gaps, pa.binary()), pa.array([t.astype("<u4").tobytes() for t in times], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "keys", "times"])


def _stored(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column end to end, and how many each row has."""
    raw = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind), np.fromiter((len(x) // width for x in raw), np.int64, len(raw))


def _pairs(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    gaps, size = _stored(column, kind)
    run = np.cumsum(gaps.astype(np.uint64))
    begin = np.cumsum(size) - size
    before = np.concatenate([np.zeros(1, np.uint64), run])[begin]
    return run - np.repeat(before, size), size


def _counted(batches, kind: str) -> Iterator:
    """Partial counts of the pairs in this task's rows."""
    import pyarrow as pa

    def out(parts):
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    held, n = [], 0
    for batch in batches:
        keys, _ = _pairs(batch.column(0), kind)
        held.append(keys)
        n += len(keys)
        if n >= MERGE:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def _looked_up(batches, kind: str, head) -> Iterator:
    """Each document's sums over the links whose pair is in the head; the
    other pairs and their times go on."""
    import pyarrow as pa
    known, count, best = head.value
    for batch in batches:
        keys, size = _pairs(batch.column(1), kind)
        times, _ = _stored(batch.column(2), "<u4")
        times, row = times.astype(np.int64), np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        sums, bests = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        np.add.at(sums, row[hit], times[hit] * count[at[hit]])
        np.add.at(bests, row[hit], times[hit] * best[at[hit]])
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(size)))]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bests), pa.array(sums),
             pa.ListArray.from_arrays(ends, pa.array(keys[~hit].astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times[~hit]))],
            names=["_row", "n_best", "count_sum", "pairs", "times"])


def _head(pairs: DataFrame, most: int):
    """The most frequent pairs, at most ``most``: from the least count that
    leaves so few."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()   # at most 63 rows
    total, least = 0, 63
    for r in sorted(sizes, key=lambda r: -r["k"]):
        total += r["n"]
        if total > most:
            break
        least = r["k"]
    rows = pairs.where(F.floor(F.log2("n")) >= least).orderBy("pair").toPandas() if least < 63 else None
    if rows is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows = rows.sort_values("pair")
    return rows["pair"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(np.int64)


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, head: int = HEAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are not read): doc_id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with
    ``keep_groups`` the groups themselves.

    Null and empty texts, and texts whose bytes a tokenizer does not keep, have
    no tokens: zeros and ''.  Equal rows and rows of one id count as documents
    each; of equally frequent partners all are best.  No rows give no rows."""
    spark = docs.sparkSession
    python_stages(spark)
    scratch, tool = Scratch(spark, "alignment"), aligner(path_a, path_b)
    kind, n_b = "<u4" if tool.small else "<u8", tool.n_b
    first = docs.select("doc_id", "text").mapInArrow(
        lambda it: _aligned(it, path_a, path_b, keep_groups),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_NUMBERS}, groups_sha256 string, groups string, keys binary, times binary")
    # Written with their ids: the two later stages read the same rows.
    first.withColumn("_row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(scratch.path("aligned"))
    aligned = spark.read.parquet(scratch.path("aligned"))
    counts = aligned.select("keys").mapInArrow(lambda it: _counted(it, kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts.withColumn("a", F.expr(f"pair div {n_b}")), "counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))     # one row an id of A's vocabulary at most
    pairs = scratch.write(counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "pairs")
    scratch.drop("counts")
    sent = spark.sparkContext.broadcast(_head(pairs, head))
    looked = aligned.select("_row", "keys", "times").mapInArrow(
        lambda it: _looked_up(it, kind, sent), "_row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    looked = scratch.write(looked, "looked")
    rest = (looked.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", "p.pairs", "p.times")
            .join(pairs, F.col("pairs") == F.col("pair"))
            .groupBy("_row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    sums = looked.select("_row", "n_best", "count_sum").join(rest, "_row", "left")
    both = aligned.drop("keys", "times").join(sums, "_row")
    total = [(F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *total, "groups_sha256", *(["groups"] if keep_groups else []))
