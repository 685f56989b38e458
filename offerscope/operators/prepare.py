"""Preparation: one-hot channels, event flattening, typed views, dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed


# --------------------------------------------------------------------------
# offers
# --------------------------------------------------------------------------

def onehot_channels(portfolio: DataFrame, channels: Sequence[str] = fixed.CHANNELS,
                    source: str = "channels") -> DataFrame:
    """Offer columns plus one 0/1 int flag per channel.

    ``source`` may be an array of channel names or its JSON/text rendering;
    arrays use membership, text uses substring match (``LIKE '%x%'``).
    """
    dtype = dict(portfolio.dtypes)[source]
    flags = []
    for ch in channels:
        hit = F.array_contains(F.col(source), ch) if dtype.startswith("array") else F.col(source).contains(ch)
        flags.append(F.coalesce(hit, F.lit(False)).cast("int").alias(ch))
    return portfolio.select("id", "offer_type", "reward", "difficulty", "duration", *flags)


def channel_dummies(portfolio: DataFrame, values: Sequence[str], source: str = "channels") -> DataFrame:
    """Offer columns (minus ``source``) plus a 0/1 column per channel of
    ``values``.  Where the channels are not known beforehand: ``channel_flags``."""
    keep = [c for c in portfolio.columns if c != source]
    flags = [F.coalesce(F.array_contains(source, v), F.lit(False)).cast("int").alias(v) for v in sorted(values)]
    return portfolio.select(*keep, *flags)


def channel_flags(portfolio: DataFrame, source: str = "channels", name: str = "flags") -> DataFrame:
    """Offer columns (minus ``source``) plus ``name``: a map from every
    channel that any offer has, in order, to 0 or 1.

    The channels are found by an aggregate that is part of the plan, so no job
    runs while it is built, a channel never seen before gets its flag, and the
    schema stays what it is.  Their set is one small row (channel names)."""
    found = portfolio.select(F.explode(source).alias("channel")).agg(F.array_sort(F.collect_set("channel"))).scalar()
    keep = [c for c in portfolio.columns if c != source]
    own = F.coalesce(F.col(source), F.array().cast("array<string>"))
    flagged = portfolio.withColumn("_found", found).withColumn("_own", own)
    return flagged.select(*keep, F.map_from_arrays("_found", F.transform("_found", lambda c: F.array_contains("_own", c).cast("int"))).alias(name))


def offers_table(portfolio: DataFrame, channels: Sequence[str] = ("web", "email", "mobile", "social")) -> DataFrame:
    """The loader's offer table: channels rendered as JSON text plus flags."""
    flags = [F.coalesce(F.array_contains("channels", ch), F.lit(False)).cast("int").alias(ch) for ch in channels]
    return portfolio.select("id", "reward", "difficulty", "duration", "offer_type",
                            F.to_json("channels").alias("channels"), *flags)


# --------------------------------------------------------------------------
# events
# --------------------------------------------------------------------------

def parse_value(value: Column) -> Column:
    """The ``value`` dict text as a struct (JSON or single-quoted dict text)."""
    return F.from_json(value, schemas.EVENT_VALUE, {"allowSingleQuotes": "true"})


_VALUE_KEYS = ["offer id", "offer_id", "amount", "reward"]


def flatten_events(transcript: DataFrame, keep_value: bool = False) -> DataFrame:
    """person, event, time, offer_id, amount, reward from the raw log.

    ``value`` may be a VARIANT (JSON-lines reader), a struct or dict text (table
    form, possibly single-quoted).  ``keep_value`` keeps it: text as it is,
    the others as JSON text with every key they have.  Text is parsed once per row with
    ``json_tuple``: being a generator, its outputs are not substituted back
    into pushed-down filters, so a filter on ``offer_id`` never re-parses.
    The offer id is the first non-empty of the two spellings ``offer_id`` and
    ``offer id``; parsing by key keeps ids that contain ``_`` or spaces intact.
    Numbers that do not parse become NULL (``try_cast``).
    """
    types = dict(transcript.dtypes)
    dtype = types["value"]
    # Passed through as they are where they can be: Spark keeps or removes an
    # alias of the same name by what else a plan holds, and two readings of the
    # log that differ in that would not share one exchange.
    base = [F.col(c) if types[c] == t else F.col(c).cast(t).alias(c) for c, t in (("person", "string"), ("event", "string"), ("time", "int"))]
    if dtype == "variant":
        keys = [F.try_variant_get("value", f"$['{k}']", "string").alias(f"_k{i}") for i, k in enumerate(_VALUE_KEYS)]
        parsed = transcript.select(*base, F.to_json("value").alias("value"), *keys)
    elif dtype.startswith("struct"):
        parsed = transcript.select(*base, F.col("value.`offer id`").alias("_k0"), F.col("value.offer_id").alias("_k1"),
                                   F.col("value.amount").alias("_k2"), F.col("value.reward").alias("_k3"),
                                   F.to_json("value").alias("value"))
    else:
        parsed = transcript.select(*base, F.col("value").cast("string").alias("value"),
                                   F.json_tuple(F.col("value"), *_VALUE_KEYS).alias("_k0", "_k1", "_k2", "_k3"))
    offer_id = F.coalesce(F.nullif(F.col("_k1"), F.lit("")), F.col("_k0"))
    cols = ["person", "event", "time", offer_id.alias("offer_id"),
            F.col("_k2").try_cast("double").alias("amount"), F.col("_k3").try_cast("double").alias("reward")]
    if keep_value:
        cols.insert(2, "value")
    return parsed.select(*cols)


def dedupe_events(events: DataFrame, keys: Sequence[str] = tuple(schemas.EVENT_COLUMNS)) -> DataFrame:
    """Keep one row per key (NULLs compare equal).  One hash shuffle on the
    key with a map-side partial aggregate, so repeated rows are collapsed
    before they cross the network."""
    return events.dropDuplicates(list(keys))


def event_view(events: DataFrame, event: str) -> DataFrame:
    """The per-event-type views with their documented columns."""
    columns = {
        fixed.OFFER_RECEIVED: ["person", "offer_id", "event", "time"],
        fixed.OFFER_VIEWED: ["person", "offer_id", "event", "time"],
        fixed.TRANSACTION: ["person", "event", "amount", "time"],
        fixed.OFFER_COMPLETED: ["person", "offer_id", "event", "reward", "time"],
    }[event]
    return events.filter(F.col("event") == event).select(*columns)


def received(events: DataFrame) -> DataFrame:
    return event_view(events, fixed.OFFER_RECEIVED)


def viewed(events: DataFrame) -> DataFrame:
    return event_view(events, fixed.OFFER_VIEWED)


def transactions(events: DataFrame) -> DataFrame:
    return event_view(events, fixed.TRANSACTION)


def completed(events: DataFrame) -> DataFrame:
    return event_view(events, fixed.OFFER_COMPLETED)


# --------------------------------------------------------------------------
# profiles
# --------------------------------------------------------------------------

def profile_with_date(profile: DataFrame, column: str = "became_member_on") -> DataFrame:
    """yyyymmdd integer → DATE (NULL for text that is not a date)."""
    dtype = dict(profile.dtypes)[column]
    if dtype == "date":
        return profile
    as_date = F.try_to_date(F.col(column).cast("string"), "yyyyMMdd")
    return profile.withColumn(column, as_date)
