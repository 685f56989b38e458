"""Near-duplicate vectors: random-hyperplane signs in several tables, exact
cosine, connected components.

Equal vectors of a label are one class first, so copies are never paired.
Classes that agree on all signs of a table meet in a bucket; a large bucket is
dealt into blocks and its pairs of blocks go to different tasks.  A pair is
reported by the first table in which it meets, so no pair counts twice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, python_stages
from .components import components

MISSED = 0.01           # chance that a pair just at the threshold meets in no table
BLOCK = 512             # classes of a block
SEED = 20240521


def plan(classes: int, threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """(signs a table, tables).  Signs grow with the logarithm of the classes,
    so that buckets stay small; tables follow from the wanted recall."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(4, math.ceil(math.log2(max(2, classes))) - 6))
    return bits, math.ceil(math.log(missed) / math.log(1 - agree ** bits))


def _signs(batches, bits: int, tables: int):
    import pyarrow as pa
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        out = []
        for raw in batch.column(batch.schema.get_field_index("embedding")).to_pylist():
            x = np.asarray(raw, np.float64)
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng([SEED, len(x)]).standard_normal((len(x), bits * tables))
            scaled = x / np.abs(x).max()
            on = (scaled @ planes[len(x)] > 0).reshape(tables, bits)
            out.append((on @ (1 << np.arange(bits, dtype=np.int64))) ^ (len(x) << bits))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o.tolist() for o in out], pa.list_(pa.int64()))],
                                         names=[*batch.schema.names, "signs"])


def _unit(rows: list) -> np.ndarray:
    x = np.asarray([r[5] for r in rows], np.float64)
    x = x / np.abs(x).max(1, keepdims=True)     # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _meet(rows: list, threshold: float) -> list[tuple[int, int]]:
    """Linked pairs of one pair of blocks that did not meet in an earlier table."""
    table, i, j = rows[0][1], rows[0][3], rows[0][4]
    left = [r for r in rows if r[7] == i]
    right = left if i == j else [r for r in rows if r[7] == j]
    if not left or not right or len(left) + len(right) < 3 and i == j:
        return []
    x = _unit(left)
    y = x if i == j else _unit(right)
    a, b = np.nonzero(x @ y.T >= threshold)
    if i == j:
        a, b = a[a < b], b[a < b]
    sx = np.asarray([r[8][:table] for r in left], np.int64).reshape(len(left), table)
    sy = np.asarray([r[8][:table] for r in right], np.int64).reshape(len(right), table)
    first = ~(sx[a] == sy[b]).any(1)
    return [(left[p][6], right[q][6]) for p, q in zip(a[first], b[first])]


def _pairs(batches, threshold: float):
    """Rows sorted by block pair: (label, table, bucket, i, j, embedding, cid,
    block, signs)."""
    import pyarrow as pa
    held: list = []

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in batches:
        found = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[-1][:5] != row[:5]:
                found += _meet(held, threshold)
                held = []
            held.append(row)
        yield batch_of(found)
    yield batch_of(_meet(held, threshold) if held else [])


def link(vectors: DataFrame, threshold: float = 0.93, missed: float = MISSED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``
    (vec_id, embedding, label).

    A vector that is null, empty, zero or has a null or non-finite component,
    or whose label is null, links with nothing.  Vectors of different lengths
    do not link.  Equal vectors of a label link with each other; repeated rows
    count each.  Other columns are not read; an empty table gives no rows."""
    spark = vectors.sparkSession
    python_stages(spark)
    scratch = Scratch(spark, "embedding-links")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding", "label").withColumn("usable", usable)
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bits, tables = plan(classes.count(), threshold, missed)
    kind = dict(classes.dtypes)
    signed = scratch.write(classes.select("cid", "label", "embedding").mapInArrow(
        lambda it: _signs(it, bits, tables), f"cid long, label {kind['label']}, embedding {kind['embedding']}, signs array<long>"), "signed")
    slim = signed.select("cid", "label", F.posexplode("signs").alias("table", "bucket"))
    crowded = (slim.groupBy("label", "table", "bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
               .select("label", "table", "bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    # A row of block b goes to the block pairs (i, j), i <= j, that hold b.
    met = slim.join(crowded, ["label", "table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("cid", "table", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    dealt = (met.join(signed, "cid")
             .select("label", "table", "bucket", "i", "j", "embedding", "cid", "block", "signs")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "table", "bucket", "i", "j")
             .sortWithinPartitions("label", "table", "bucket", "i", "j"))
    pairs = scratch.write(dealt.mapInArrow(lambda it: _pairs(it, threshold), "a long, b long"), "pairs")
    roots = components(pairs, scratch, "components")
    size = classes.select("cid", "n", "rep")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(size.select(F.col("cid").alias("b"), "n"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    member = size.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    result = (member.join(lowest, "root").join(others, "cid", "left")
              .select("cid", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    known = classes.select("label", "embedding", "cid").join(result, "cid").select("label", "embedding", "component_id", "n_links")
    linked = rows.where("usable").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
