"""Exact copies by an extendible-hash index on shared files.

A text's key is a 64-bit hash.  The index holds one entry a distinct text.
Its directory is grown from the entries' counts: as long as a bucket holds more
than its capacity, it is split by the next bit of the key and the directory
doubles.  Owner tasks each take a range of keys, chain the entries whose keys
collide and write their part of the index to the shared folder.

Texts are compared byte by byte, in the grouping that makes the entries: first
in each map task, so that a text of a third of all rows crosses the network
once a task.  Rows are then looked up by key and digest, never by text.

Only DataFrame functions are used."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

CAPACITY = 4096      # entries of a bucket
KEY_BITS = 64
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(column: str = "text") -> Column:
    """The text with each run of blanks as one space; null is empty."""
    return F.regexp_replace(text_or_empty(column), BLANKS, " ")


def _key(text: Column, bits: int) -> Column:
    """The first ``bits`` bits of a text's hash, left in their place."""
    return F.xxhash64(text) if bits == KEY_BITS else F.xxhash64(text).bitwiseAND(F.lit(-1 << (KEY_BITS - bits)))


def _slot(depth: int) -> Column:
    """A key's first ``depth`` bits as a number."""
    return F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, n: int, scratch: Scratch, capacity: int = CAPACITY, bits: int = KEY_BITS) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of every used slot, and the directory's depth.

    A bucket is known by its first slot.  Splitting starts at the last depth
    at which some bucket must be too full, for all shallower directories
    double anyway; a bucket is split no further than the keys have bits."""
    depth = min(bits, max(0, math.ceil(math.log2(max(1, n) / capacity)) - 1))
    open_, levels = entries.select("key"), []
    while True:
        seen = Observation()
        sizes = open_.groupBy(_slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        sizes = scratch.write(sizes.observe(seen, F.max("n").alias("most")), f"sizes-{depth}")
        last = depth >= bits or (seen.get["most"] or 0) <= capacity
        levels.append((sizes if last else sizes.where(F.col("n") <= capacity), depth))
        if last:
            break
        full = sizes.where(F.col("n") > capacity).select(F.col("slot").alias("full"))
        open_ = open_.join(full, _slot(depth) == F.col("full"), "left_semi")
        depth += 1
    out = None
    for sizes, d in levels:
        wide = 1 << (depth - d)
        slots = sizes.select((F.col("slot") * wide).alias("bucket"), F.lit(d).alias("depth"), F.explode(F.sequence(F.col("slot") * wide, F.col("slot") * wide + (wide - 1))).alias("slot"))
        out = slots if out is None else out.unionByName(slots)
    return out, depth


def build_index(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY, bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows, index) on shared files.  rows: row, doc_id, key, digest of every
    row.  index: bucket, depth, key, place (in the key's chain), digest,
    keep_id, keep_row, n; one entry a distinct text, each owner task's part
    sorted by key."""
    text = docs.select("doc_id", normalised().alias("text"))
    keyed = text.withColumn("key", _key(F.col("text"), bits))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    # Written with their ids: a later plan of the scan could give the ids to other rows.
    rows = scratch.write(keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", digest), "rows")
    same = keyed.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n")).select("key", digest, "n")
    firsts = rows.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    whole = F.when(F.col("n") == F.col("n_rows"), F.col("n")).otherwise(F.raise_error(F.lit("different texts of equal SHA-256")))
    seen = Observation()
    entries = same.join(firsts, ["key", "digest"]).select("key", "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), whole.alias("n"))
    entries = scratch.write(entries.observe(seen, F.count(F.lit(1)).alias("n")), "entries")
    slots, depth = directory(entries, seen.get["n"], scratch, capacity, bits)
    owned = entries.withColumn("slot", _slot(depth)).join(slots, "slot").drop("slot").repartitionByRange("bucket", "key")
    place = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest"))
    return rows, scratch.write(owned.withColumn("place", place), "index")


def mark(docs: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are not read): doc_id,
    keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row of smallest ``doc_id`` stays (a null one
    is smallest), of rows that share it the first in the input.  Null text is
    empty; empty texts are equal.  No rows give no rows."""
    rows, index = build_index(docs, Scratch(docs.sparkSession, "exact-dedup"), capacity, bits)
    found = rows.join(index.select("key", "digest", "keep_id", "keep_row", "n"), ["key", "digest"])
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and whole texts.
    Rows of one id and equal texts that differ elsewhere: one of them stays."""
    stay = mark(docs, capacity).where("kept").select(F.struct("doc_id", "text_sha256").alias("stays"))
    whole = docs.select(F.struct("*").alias("doc"), F.struct("doc_id", F.sha2(normalised().cast("binary"), 256).alias("text_sha256")).alias("stays"))
    return whole.dropDuplicates(["stays"]).join(stay, whole["stays"].eqNullSafe(stay["stays"]), "left_semi").select("doc.*")
