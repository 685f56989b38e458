"""Sinks and table utilities: create/append tables, CSV export, previews,
exact-size samples, column catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def create_table(df: DataFrame, name: str, mode: str = "errorifexists",
                 partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """``SELECT … INTO name`` / ``CREATE TABLE … AS``: a managed table.
    ``mode='ignore'`` gives "create if absent", ``'append'`` appends."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Set-based append (the loader's row-by-row INSERT loop, re-aimed)."""
    if df.sparkSession.catalog.tableExists(name):
        df.write.mode("append").insertInto(name)
    else:
        create_table(df, name)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """CSV export, written in parallel by the executors (one file per
    partition); the pandas index column of the original export is not kept."""
    df.write.mode(mode).option("header", header).csv(path)


def row_text(df: DataFrame) -> Column:
    """A row's columns as one JSON text."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def sample_exact(df: DataFrame, n: int, seed: int = 0, key: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows (``DataFrame.sample`` is only approximately sized),
    the same ones on every run and for every partitioning of ``df``: those
    with the least md5 of the seed and the row (``key``: a text that stands
    for the row; rows equal in it are taken in any order).  Planned as a top-n:
    each task keeps n rows and one final merge picks n, so nothing unbounded
    reaches a single task."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), key if key is not None else row_text(df)))
    return df.withColumn("_r", draw).orderBy("_r").limit(n).drop("_r")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows by all columns in turn, NULL first (``TOP n``
    without ORDER BY is any n; these are the same on every run)."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in df.columns]).limit(n)


def column_catalogue(spark: SparkSession, df: DataFrame) -> DataFrame:
    """column_name, data_type, nullable from the schema (metadata only)."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
