"""Order as data: a global row number over a range-partitioned sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sliced import whole


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """``df`` plus its rows' places, from 1, in ``order``; ties take the order
    of all columns.

    The rows are sorted in ranges; a row's place is its place in its range plus
    the sizes of the ranges before.  Both read the same exchange (``whole``),
    and only one row a range, its size, is brought together, so no task sees
    all rows as it would under a window without partitions."""
    by = [*order, *[F.col(c).asc_nulls_first() for c in df.columns]]
    ranged = whole(df).repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*by)))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.agg(F.map_from_entries(F.collect_list(F.struct("_range", "n")))).scalar()
    own = placed.withColumn("_sizes", before)
    earlier = F.aggregate(F.map_keys("_sizes"), F.lit(0).cast("long"),
                          lambda s, r: s + F.when(r < F.col("_range"), F.element_at("_sizes", r)).otherwise(F.lit(0)))
    return own.select(*df.columns, (earlier + F.col("_at")).alias(name))
