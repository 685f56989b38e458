"""Loaders: offers and events from files (lossless, checked, appended once or
again), flattened events, channel dummies, CSV export and an exact sample."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import prepare
from ..session import ensure_checkpoint_dir
from ..sources import jsonl, loads, tables
from .context import Tables
from .registry import analysis


def _folder(t: Tables, name: str) -> str:
    """A new folder beside the checkpoints, where a query's files go."""
    return f"{ensure_checkpoint_dir(t.transcript.sparkSession).rstrip('/')}/offerscope-files/{name}-{uuid.uuid4().hex}"


def _events_file(t: Tables, name: str) -> str:
    """The transcript written as JSON lines."""
    path = _folder(t, name)
    jsonl.write_events(t.transcript, path)
    return path


# The original value object is the text without blanks, its keys in order;
# a whole amount is kept as the number, without a fraction of zero.
_FLAT_WITH_VALUE = """
SELECT person, event, regexp_replace(json(j)::VARCHAR, '([0-9])\\.0}', '\\1}') AS value, time,
       COALESCE(NULLIF(json_extract_string(j, '$.offer_id'), ''), json_extract_string(j, '$."offer id"')) AS offer_id,
       CAST(json_extract(j, '$.amount') AS DOUBLE) AS amount,
       CAST(json_extract(j, '$.reward') AS DOUBLE) AS reward
FROM (SELECT *, replace(value, '''', '"') AS j FROM transcript)"""


@analysis("nb_load_offers", """
SELECT id, reward, difficulty, duration, offer_type, to_json(channels)::VARCHAR AS channels,
       CAST(list_contains(channels, 'web') AS INTEGER) AS web,
       CAST(list_contains(channels, 'email') AS INTEGER) AS email,
       CAST(list_contains(channels, 'mobile') AS INTEGER) AS mobile,
       CAST(list_contains(channels, 'social') AS INTEGER) AS social
FROM portfolio""")
def load_offers(t: Tables):
    return prepare.offers_table(t.portfolio)


@analysis("nb_load_events", _FLAT_WITH_VALUE)
def load_events(t: Tables):
    """Written as JSON lines, read back with every key of the value object."""
    path = _events_file(t, "load-events")
    return jsonl.load_events(t.transcript.sparkSession, path)


# Two kinds of faulty lines are made of the log itself: views of persons whose
# name ends in 7 lose their last character, purchases above 95 their time.
_CUT = "event = 'offer viewed' AND person LIKE '%7'"
_UNTIMED = "event = 'transaction' AND value LIKE '{''amount'': 9_.%' AND value >= '{''amount'': 95'"


@analysis("nb_checked_events", f"""
SELECT coalesce(reason, 'event') AS kind, COUNT(*) AS n FROM (
  SELECT CASE WHEN {_CUT} THEN 'not JSON' WHEN {_UNTIMED} THEN 'time is not an int' END AS reason FROM transcript)
GROUP BY 1""")
def checked_events(t: Tables):
    """Good lines and faults, by reason: together every line that was read."""
    spark, path = t.transcript.sparkSession, _folder(t, "checked-events")
    value = F.from_json("value", "variant", {"allowSingleQuotes": "true"})
    time = F.when(F.expr(_UNTIMED), F.lit("soon")).otherwise(F.col("time").cast("string"))
    line = F.to_json(F.struct("person", "event", value.alias("value"), F.when(F.expr(_UNTIMED), time).alias("_text"), F.when(~F.expr(_UNTIMED), F.col("time")).alias("_int")))
    line = F.regexp_replace(F.regexp_replace(line, '"_text"', '"time"'), '"_int"', '"time"')
    cut = F.when(F.expr(_CUT), F.left(line, F.length(line) - 1)).otherwise(line)
    t.transcript.select(cut.alias("line")).write.text(path)
    events, faults = jsonl.checked_events(spark, path, strict=False)
    kinds = events.select(F.lit("event").alias("kind")).unionByName(faults.select(F.col("reason").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@analysis("nb_append_events", """
SELECT mode, n * times AS n_rows, amount * times AS amount
FROM (SELECT COUNT(*) AS n, SUM(CAST(amount AS DECIMAL(28,10))) AS amount FROM flat),
     (VALUES ('once', 1), ('again', 2)) AS m(mode, times)""")
def append_events(t: Tables):
    """The same files appended twice: by manifest, and as plain inserts."""
    spark, path = t.transcript.sparkSession, _events_file(t, "append-events")
    out = None
    for mode in ("once", "again"):
        table = _folder(t, f"events-{mode}")
        for _ in range(2):
            loads.append_files(spark, table, path, jsonl.load_events, again=mode == "again")
        sums = loads.loaded(spark, table).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("amount").cast("decimal(28,10)")).alias("amount"))
        sums = sums.select(F.lit(mode).alias("mode"), "n_rows", "amount")
        out = sums if out is None else out.unionByName(sums)
    return out


@analysis("nb_export_csv", "SELECT * FROM profile")
def export_csv(t: Tables):
    """Profiles exported as CSV with a header, and read back."""
    path = _folder(t, "profile-csv")
    tables.export_csv(t.profile, path)
    return t.profile.sparkSession.read.schema(t.profile.schema).option("header", True).csv(path)


@analysis("nb_flatten_events", "SELECT person, event, time, amount, offer_id, reward FROM flat")
def flatten_events(t: Tables):
    return t.flat.select("person", "event", "time", "amount", "offer_id", "reward")


@analysis("nb_channel_dummies", """
SELECT id, reward, difficulty, duration, offer_type,
       CAST(list_contains(channels, 'email') AS INTEGER) AS email,
       CAST(list_contains(channels, 'mobile') AS INTEGER) AS mobile,
       CAST(list_contains(channels, 'social') AS INTEGER) AS social,
       CAST(list_contains(channels, 'web') AS INTEGER) AS web
FROM portfolio""")
def channel_dummies(t: Tables):
    return prepare.channel_dummies(t.portfolio, values=["email", "mobile", "social", "web"])


@analysis("nb_channel_flags", """
SELECT p.id, c.channel, CAST(list_contains(p.channels, c.channel) AS INTEGER) AS flag
FROM portfolio p, (SELECT DISTINCT unnest(channels) AS channel FROM portfolio) c""")
def channel_flags(t: Tables):
    """One row per offer and channel that any offer has."""
    return prepare.channel_flags(t.portfolio).select("id", F.explode("flags").alias("channel", "flag"))


@analysis("nb_channels_by_text", "SELECT id, offer_type, reward, difficulty, duration, " + ", ".join(
    f"CAST(array_to_string(channels, '/') LIKE '%{c}%' AS INTEGER) AS {c}" for c in ["email", "mobile", "social", "web"]) + " FROM portfolio")
def channels_by_text(t: Tables):
    """The flags by substring, from the channels' JSON text."""
    return prepare.onehot_channels(t.portfolio.withColumn("channels", F.to_json("channels")))


_SAMPLE_KEY = ["person", "event", "CAST(time AS STRING)", "offer_id", "CAST(CAST(amount AS DECIMAL(28,10)) AS STRING)", "CAST(CAST(reward AS DECIMAL(28,10)) AS STRING)"]


@analysis("nb_sample_events", f"""
SELECT * FROM flat ORDER BY md5('42|' || concat_ws('|', {', '.join(_SAMPLE_KEY)})) LIMIT 100""")
def sample_events(t: Tables):
    """100 events, chosen by hash: the same on every run."""
    return tables.sample_exact(t.flat, 100, seed=42, key=F.expr(f"concat_ws('|', {', '.join(_SAMPLE_KEY)})"))
