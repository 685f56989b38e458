"""Incremental ingest of a growing JSON-lines event log.

The batch loader reads a finished file; when event files keep arriving, the
same flattening runs as a Structured Streaming query: a file source with the
declared schema, the stateless flatten, and a parquet sink whose progress is
kept in a checkpoint folder on shared storage, so a restarted or failed
query resumes exactly where it stopped.  De-duplication stays a batch step
over the ingested table (``operators.prepare.dedupe_events``): exact repeats
can arrive arbitrarily late, and a streaming dropDuplicates would need a
watermark that the hour-offset clock of the log does not provide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import prepare


def event_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Flattened events from JSON-lines files as they land in ``source_dir``."""
    reader = spark.readStream.schema(schemas.TRANSCRIPT_JSON).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return prepare.flatten_events(reader.json(source_dir))


def start_ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 available_now: bool = False, interval: str = "1 minute",
                 partition_by: list[str] | None = None) -> StreamingQuery:
    """Append flattened events to a parquet table under ``sink_dir``.

    ``available_now=True`` processes everything present and stops (a batch
    catch-up with streaming bookkeeping); otherwise runs every ``interval``.
    """
    writer = (event_stream(spark, source_dir).writeStream.format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
