"""Document fingerprints from improbable features.

Every 32-byte window of a text has an entropy.  How rare that entropy is over
all windows of all documents is the window's rank; a window that has the
lowest rank in enough runs of 32 windows is a feature.  A document's distinct
features go, in order, into a chain of Bloom filters of ``PER_FILTER`` each.
Two digests are compared filter by filter by their common bits, normalised
between what chance gives and the most that is possible.

Texts of a batch are laid end to end and handled by vector operations; windows
that reach into the next text are masked, so a text's fingerprint does not
depend on its neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_stages, text_or_empty

WINDOW = 32             # bytes of a feature, and windows of a run
POPULARITY = 6          # runs that a feature must win
BITS = 2048             # of a Bloom filter
HASHES = 5
PER_FILTER = 160        # features of a filter
LEVELS = 1024           # entropy levels
NOISE = 0.1             # share of the possible common bits that counts as none
CHUNK = 1 << 16         # positions handled at once, so that work stays in cache
PORTION = 1 << 20       # characters whose windows are held at once (about 60 bytes each)
_SCALE = 1 << 16

_COUNT = np.arange(WINDOW + 1)
_CLOGC = np.zeros(WINDOW + 1)
_CLOGC[1:] = _COUNT[1:] * np.log2(_COUNT[1:])
# Gain of c log c from one more equal byte, in whole units, so that running
# sums are exact.
_GAIN = np.rint(np.diff(np.rint(_CLOGC * _SCALE))).astype(np.int64)
_MOST = int(round(WINDOW * np.log2(WINDOW) * _SCALE))


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes end to end, each text's start, and its number of windows.  A text
    shorter than a window is padded with zero bytes to one; an empty one has
    no window."""
    padded = [t.ljust(WINDOW, b"\0") if t else t for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(padded) + bytes(WINDOW), np.uint8), starts, np.maximum(lengths - WINDOW + 1, 0)


def entropy_levels(flat: np.ndarray) -> np.ndarray:
    """Level of the window that starts at each byte but the last 31.

    Sliding on by a byte takes one occurrence of the first byte away and adds
    one of the new last byte; the change depends only on how often each stands
    among the 31 bytes in between, counted by comparing the text with itself
    shifted by 1 to 31 bytes."""
    n = len(flat) - WINDOW + 1
    before, after = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.uint8)
    for at in range(0, len(flat), CHUNK):
        stop = min(len(flat), at + CHUNK)
        for lag in range(1, WINDOW):
            a = max(at, lag)
            if a < stop:
                same = (flat[a:stop] == flat[a - lag:stop - lag]).view(np.uint8)
                before[a:stop] += same
                after[a - lag:stop - lag] += same
    first = int(_GAIN[before[:WINDOW]].sum())       # of the window at 0
    change = _GAIN[before[WINDOW:WINDOW + n - 1]] - _GAIN[after[:n - 1]]
    clogc = first + np.concatenate([[0], np.cumsum(change)])
    return ((_MOST - clogc) * (LEVELS - 1) // _MOST).astype(np.int64)


def _valid(n: int, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    mark = np.zeros(n + 1, np.int32)
    has = windows > 0
    np.add.at(mark, starts[has], 1)
    np.add.at(mark, starts[has] + windows[has], -1)
    return np.cumsum(mark[:-1]) > 0


def level_counts(texts: list[bytes]) -> np.ndarray:
    flat, starts, windows = lay_out(texts)
    levels = entropy_levels(flat)
    return np.bincount(levels[_valid(len(levels), starts, windows)], minlength=LEVELS)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: rarest first, ties by level.  Levels of almost no
    information (one or two distinct bytes) come last."""
    order = np.lexsort((np.arange(LEVELS), np.where(np.arange(LEVELS) < LEVELS // 6, counts.max() + 1, counts)))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def _window_hashes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of the window at each place, its bytes taken as 4 words."""
    h = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    words = np.lib.stride_tricks.sliding_window_view(flat, 8)
    for k in range(0, WINDOW, 8):
        w = np.ascontiguousarray(words[at + k]).view("<u8")[:, 0]
        h = (h ^ w) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def digests(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """A digest of each text: its Bloom filters end to end; empty for an empty
    text."""
    flat, starts, windows = lay_out(texts)
    levels = entropy_levels(flat)
    n = len(levels)
    valid = _valid(n, starts, windows)
    # The least (rank, place) of each run of 32 places, by doubling.
    key = np.where(valid, rank[levels], LEVELS) << 40 | np.arange(n)
    least = key.copy()
    for step in (1, 2, 4, 8, 16):
        least[:n - step] = np.minimum(least[:n - step], least[step:])
    # A run counts for the text in which it starts; the 31 masked places at
    # each text's end keep it from reaching the next text.
    won = np.bincount((least & ((1 << 40) - 1))[valid], minlength=n)
    places = np.flatnonzero(valid)
    if not len(places):
        return [b""] * len(texts)
    # Short texts need fewer wins, and every text that has windows has a
    # feature: its most popular, if none wins enough runs.
    has = windows[windows > 0]
    most = np.maximum.reduceat(won[places], np.cumsum(has) - has)
    need = np.minimum(np.clip(has // (2 * WINDOW), 1, POPULARITY), most)
    chosen = places[won[places] >= np.repeat(need, has)]
    owner = np.flatnonzero(windows > 0)[np.searchsorted(starts[windows > 0], chosen, side="right") - 1]
    hashes = _window_hashes(flat, chosen)
    out = []
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        own = hashes[bounds[k]:bounds[k + 1]]
        if not len(own):
            out.append(b"")
            continue
        own = own[np.sort(np.unique(own, return_index=True)[1])]
        filters = -(-len(own) // PER_FILTER)
        which = np.arange(len(own)) // PER_FILTER
        bits = np.zeros(filters * BITS, np.uint8)
        for j in range(HASHES):
            bits[which * BITS + ((own >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: each filter of the shorter digest takes its best match in the
    other; the matches' mean.  Equal digests are 1, one without features
    against one with is 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x = np.unpackbits(np.frombuffer(a, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32)
    y = np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32)
    nx, ny = x.sum(1, keepdims=True), y.sum(1)
    best = []
    for at in range(0, len(x), 256):        # bounded blocks of two long chains
        top = np.zeros(len(x[at:at + 256]))
        for to in range(0, len(y), 4096):
            common = x[at:at + 256] @ y[to:to + 4096].T
            chance = nx[at:at + 256] * ny[to:to + 4096] / BITS
            most = np.minimum(nx[at:at + 256], ny[to:to + 4096])
            floor = chance + NOISE * (most - chance)
            top = np.maximum(top, np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(1))
        best.append(top)
    return float(np.concatenate(best).mean())


def _portions(rows: list, size) -> list[list]:
    """Rows in a row of about ``PORTION`` characters; a longer one is alone."""
    out, room = [[]], PORTION
    for r in rows:
        if out[-1] and size(r) > room:
            out.append([])
            room = PORTION
        out[-1].append(r)
        room -= size(r)
    return out


def _level_counts(batches):
    import pyarrow as pa
    total = np.zeros(LEVELS, np.int64)
    for batch in batches:
        for part in _portions(batch.column(0).to_pylist(), len):
            total += level_counts([t.encode() for t in part])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], names=["level", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy levels from all windows of all texts; equal copies
    count each.  Null text is empty."""
    python_stages(docs.sparkSession)
    found = (docs.select(text_or_empty().alias("text")).mapInArrow(_level_counts, "level long, n long")
             .groupBy("level").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(LEVELS, np.int64)
    for r in found:
        counts[r["level"]] = r["n"]
    return ranks(counts)


def _pairs(batches, rank: np.ndarray):
    """Rows in descending order of place, buckets end to end: each row is
    paired with the next row of its bucket; a bucket's guest row (the first of
    the next bucket) closes it."""
    import pyarrow as pa
    held = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        for rows in _portions(list(zip(*[batch.column(k).to_pylist() for k in range(4)])), lambda r: len(r[3])):
            rows = rows if held is None else [held, *rows]      # (bucket, guest, doc_id, text)
            if not rows:
                continue
            held = rows[-1]
            pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
            edited = []
            for k in pairs:
                text, after = rows[k][3], rows[k + 1][3]
                cut = len(text) // 2
                edited.append((text[:len(text) - cut] + after[:cut]).encode())
            made = digests([r[3].encode() for r in rows] + edited, rank)
            out = [(rows[k][2], len(rows[k][3]), hashlib.sha256(e).hexdigest(), made[k].hex(), changed.hex(),
                    likeness(made[k], changed), likeness(made[k], made[k + 1]))
                   for k, e, changed in zip(pairs, edited, made[len(rows):])]
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def fingerprint_pairs(docs: DataFrame, rank: np.ndarray, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each row's text and of its edit with the next row's, in
    descending ``doc_id`` (the first follows the last).

    The rows are dealt once, by ranges of ``doc_id``; a bucket also gets the
    first row of the next one, so no row needs another shuffle.  Null text is
    empty, null ``doc_id`` comes last, rows of equal ``doc_id`` are ordered by
    their text's hash; a table of one row pairs it with itself; other columns
    are not read."""
    spark = docs.sparkSession
    python_stages(spark)
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    # Bounds at even shares of the ids (n numbers), then each bucket's first row.
    ids = docs.select("doc_id")
    bounds = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"] if n > 1 else None
    bounds = sorted(set(bounds or []))
    bucket = F.lit(0)
    if bounds:
        # 0 for the highest ids; binary search in the array of bounds.
        bucket = len(bounds) - F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id")))
        bucket = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(bucket)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    placed = rows.withColumn("bucket", bucket.cast("int"))
    firsts = (placed.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id"), -F.col("h").cast("decimal(20,0)"))).alias("top"))
              .select("bucket", "top.doc_id", (-F.col("top.col2")).cast("long").alias("h")).collect())
    firsts = sorted(((r["bucket"], r["doc_id"], r["h"]) for r in firsts))
    # Guest rows: the first row of each bucket, sent also to the one before it.
    # The table of first rows has a row a bucket.
    first = spark.createDataFrame([(d, h, firsts[k - 1][0]) for k, (_, d, h) in enumerate(firsts)], "f_id long, f_h long, before int")
    placed = placed.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    dealt = placed.select(F.explode(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")),
                                            F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))).alias("to"), "doc_id", "h", "text")
    dealt = (dealt.select("to.bucket", "to.guest", "doc_id", "h", "text").where("bucket IS NOT NULL")
             .repartition(n, "bucket").sortWithinPartitions("bucket", "guest", *order).select("bucket", "guest", "doc_id", "text"))
    shared = spark.sparkContext.broadcast(rank)     # LEVELS numbers
    return dealt.mapInArrow(lambda it: _pairs(it, shared.value),
                            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
