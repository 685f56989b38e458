"""Readers for the three newline-delimited JSON inputs.

Schemas are declared, so nothing is inferred by a separate pass over the
files; Spark splits the files across tasks.  Blank lines are skipped by the
JSON source; malformed lines become NULL rows in PERMISSIVE mode (or fail
the job with ``mode='FAILFAST'``).  ``checked_events`` takes the lines one by
one: a line is either a well-formed event or goes, with its file and the
reason, to a second output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import prepare


def read_offers(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return spark.read.schema(schemas.PORTFOLIO).option("mode", mode).json(path)


def read_profiles(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    return spark.read.schema(schemas.PROFILE).option("mode", mode).json(path)


def read_events(spark: SparkSession, path: str, mode: str = "PERMISSIVE",
                corrupt_column: str | None = None) -> DataFrame:
    """Raw events with ``value`` as a VARIANT: every key it has, known or not.

    ``corrupt_column`` keeps the text of malformed lines in that column (NULL
    for good lines) instead of returning them as all-NULL rows."""
    schema = schemas.TRANSCRIPT_JSON
    reader = spark.read.option("mode", mode)
    if corrupt_column:
        schema = T.StructType(schema.fields + [T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.schema(schema).json(path)


# What a well-formed event must have: field and the type it is read as.
REQUIRED = [("person", "string"), ("event", "string"), ("time", "int")]


def _fault(v: Column) -> Column:
    """Why a parsed line is no event, or NULL."""
    kind = F.schema_of_variant(v)
    out = F.when(v.isNull(), F.lit("not JSON")).when(~kind.startswith("OBJECT"), F.lit("not an object"))
    for name, dtype in REQUIRED:
        there = F.try_variant_get(v, f"$.{name}", "variant")
        out = out.when(there.isNull() | F.is_variant_null(there), F.lit(f"{name} is missing"))
        if dtype != "string":
            out = out.when(F.try_variant_get(v, f"$.{name}", dtype).isNull(), F.lit(f"{name} is not an {dtype}"))
    value = F.try_variant_get(v, "$.value", "variant")
    return out.when(value.isNotNull() & ~F.schema_of_variant(value).startswith("OBJECT"), F.lit("value is not an object"))


def checked_events(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, faults) of the lines below ``path``: raw events as
    ``read_events`` gives them, and (file, line, reason) of every line that is
    none.  Each line that is not blank is in one of the two.

    ``strict``: reading the events fails at the first faulty line, naming its
    file and the reason; the faults can still be read."""
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
             .where(F.trim(F.col("line")) != ""))
    parsed = lines.withColumn("_v", F.try_parse_json("line")).withColumn("_fault", _fault(F.col("_v")))
    if strict:
        told = F.raise_error(F.concat(F.lit("malformed event in "), F.col("file"), F.lit(": "), F.col("_fault")))
        good = parsed.where(F.when(F.col("_fault").isNull(), F.lit(True)).otherwise(told.cast("boolean")))
    else:
        good = parsed.where(F.col("_fault").isNull())
    fields = [F.try_variant_get("_v", f"$.{name}", dtype).alias(name) for name, dtype in REQUIRED[:2]]
    events = good.select(*fields, F.try_variant_get("_v", "$.value", "variant").alias("value"), F.try_variant_get("_v", "$.time", "int").alias("time"))
    return events, parsed.where(F.col("_fault").isNotNull()).select("file", "line", F.col("_fault").alias("reason"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Schema inferred from the data (one extra pass); for exploration only."""
    return spark.read.json(path)


def load_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offer rows with channels as JSON text and one flag per channel."""
    return prepare.offers_table(read_offers(spark, path))


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Flattened events keeping the original value object, whole, as JSON text."""
    return prepare.flatten_events(read_events(spark, path), keep_value=True)


def write_events(transcript: DataFrame, path: str) -> None:
    """``transcript`` (value as dict text, possibly single-quoted, or VARIANT)
    as JSON lines, one file a partition."""
    if dict(transcript.dtypes)["value"] == "string":
        transcript = transcript.withColumn("value", F.from_json("value", "variant", {"allowSingleQuotes": "true"}))
    transcript.select("person", "event", "value", "time").write.json(path)
