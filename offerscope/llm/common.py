"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.session import ensure_checkpoint_dir

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Rows and bytes of one Arrow batch handed to a Python worker; whole texts can
# be long, so the default of 10,000 rows would not bound a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_SHIPPED: set[str] = set()


def python_stages(spark: SparkSession) -> None:
    """What this session's Python stages need: bounded Arrow batches, and the
    package's modules on every executor (once an application)."""
    if (app := spark.sparkContext.applicationId) not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="offerscope-")) / "offerscope-modules.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in [root / "__init__.py", root / "session.py", *sorted((root / "llm").glob("*.py"))]:
                z.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables of one run in the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage: an executor lost later costs a re-read,
    not a replay.  ``drop`` deletes a table that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = ensure_checkpoint_dir(spark).rstrip("/")
        self.base = f"{base}/offerscope-llm/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
