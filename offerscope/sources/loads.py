"""Repeatable loading: appending the same file again adds nothing.

A load is one source file with one content.  Its rows are written to a folder
of their own, ``load=<id>``, and the id is made of the file's name and a
fingerprint of its lines.  So the manifest is the table itself: a load that is
there was loaded, a load that broke off is written anew in place when it is
retried, and a load is in the table once however often it is appended.

``again=True`` appends like a plain INSERT: every call adds the rows once more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD = "load"


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_lines, content) of the text files below ``path``.  The content
    is fingerprinted by two sums over the lines' hashes: one pass, with a
    map-side combine, whatever a file's size."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))

    def total(seed: int):
        return F.sum(F.xxhash64(F.lit(seed), "line").cast("decimal(38,0)")).cast("string")

    sums = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), total(1).alias("a"), total(2).alias("b"))
    return sums.select("file", "n_lines", F.md5(F.concat_ws("|", F.col("n_lines").cast("string"), "a", "b")).alias("content"))


def manifest(spark: SparkSession, table: str) -> DataFrame:
    """(load, n_rows) of the loads in the table; none if there is no table."""
    if not _exists(spark, table):
        return spark.createDataFrame([], f"{LOAD} string, n_rows long")
    return spark.read.parquet(table).groupBy(LOAD).agg(F.count(F.lit(1)).alias("n_rows"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_files(spark: SparkSession, table: str, path: str, read: Callable[[SparkSession, str], DataFrame], again: bool = False) -> int:
    """Append the files below ``path``, read by ``read(spark, file)``, to the
    folder ``table``; the number of loads that were new.

    One job a new file, as loaders run: the list of files, with one
    fingerprint each, is all that reaches the driver."""
    there = set() if again else {r[LOAD] for r in manifest(spark, table).select(LOAD).collect()}
    new = 0
    for r in fingerprints(spark, path).orderBy("file").collect():
        name = r["file"].rsplit("/", 1)[-1]
        load = uuid.uuid4().hex if again else f"{name}-{r['content']}"
        if load not in there:
            read(spark, r["file"]).write.mode("overwrite").parquet(f"{table}/{LOAD}={load}")
            new += 1
    return new


def loaded(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows, without the load they came by."""
    return spark.read.parquet(table).drop(LOAD)
