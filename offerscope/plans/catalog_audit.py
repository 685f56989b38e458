"""Audit: flatten and profile the raw inputs (one-hot offers, distinct
values, ranges, null counts, histograms, event subsets and views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, fixed, text
from ..operators import prepare, profiling
from .context import Tables
from .registry import analysis, rupee_sql

# ---------------------------------------------------------------- offers


@analysis("aud_channels_onehot", "SELECT * FROM portfolio_cleaned")
def channels_onehot(t: Tables):
    return t.offers


_OFFER_ATTRS = ["id", "offer_type", "reward", "difficulty", "duration"]


@analysis("aud_offer_distincts", " UNION ".join(
    f"SELECT DISTINCT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM portfolio_cleaned" for c in _OFFER_ATTRS))
def offer_distincts(t: Tables):
    return profiling.distinct_values(t.offers, _OFFER_ATTRS)


@analysis("aud_offer_ranges", f"""
SELECT {rupee_sql('MIN(reward)')} AS min_reward, {rupee_sql('MAX(reward)')} AS max_reward,
       {rupee_sql('MIN(difficulty)')} AS min_difficulty, {rupee_sql('MAX(difficulty)')} AS max_difficulty,
       MIN(duration) AS min_duration, MAX(duration) AS maximum_duration
FROM portfolio_cleaned""")
def offer_ranges(t: Tables):
    o = t.offers
    return o.agg(text.rupee(F.min("reward")).alias("min_reward"), text.rupee(F.max("reward")).alias("max_reward"),
                 text.rupee(F.min("difficulty")).alias("min_difficulty"),
                 text.rupee(F.max("difficulty")).alias("max_difficulty"),
                 F.min("duration").alias("min_duration"), F.max("duration").alias("maximum_duration"))


# ---------------------------------------------------------------- profiles

@analysis("aud_profile_counts", """
SELECT COUNT(DISTINCT id) AS distinct_ids,
       COUNT(DISTINCT CASE WHEN gender IS NULL THEN id END) AS ids_missing_gender,
       COUNT(DISTINCT CASE WHEN income IS NULL THEN id END) AS ids_missing_income
FROM profile""")
def profile_counts(t: Tables):
    p = t.profile
    return p.agg(F.count_distinct("id").alias("distinct_ids"),
                 F.count_distinct(F.when(F.col("gender").isNull(), F.col("id"))).alias("ids_missing_gender"),
                 F.count_distinct(F.when(F.col("income").isNull(), F.col("id"))).alias("ids_missing_income"))


@analysis("aud_gender_distinct", "SELECT DISTINCT gender FROM profile")
def gender_distinct(t: Tables):
    return t.profile.select("gender").distinct()


@analysis("aud_gender_counts", "SELECT gender, COUNT(*) AS gender_count FROM profile GROUP BY gender")
def gender_counts(t: Tables):
    return profiling.frequency(t.profile, "gender", "gender_count").orderBy(F.col("gender_count").desc())


@analysis("aud_profile_nulls_ranges", f"""
SELECT CAST(SUM(CASE WHEN gender IS NULL THEN 1 END) AS BIGINT) AS missing_gender,
       CAST(SUM(CASE WHEN age IS NULL THEN 1 END) AS BIGINT) AS missing_age,
       CAST(SUM(CASE WHEN id IS NULL THEN 1 END) AS BIGINT) AS missing_id,
       CAST(SUM(CASE WHEN became_member_on IS NULL THEN 1 END) AS BIGINT) AS missing_date,
       CAST(SUM(CASE WHEN income IS NULL THEN 1 END) AS BIGINT) AS missing_income,
       MIN(age) AS min_age, MAX(age) AS max_age,
       {rupee_sql('MIN(income)')} AS min_income, {rupee_sql('MAX(income)')} AS max_income,
       MIN(became_member_on) AS min_joining_date, MAX(became_member_on) AS max_joining_date
FROM profile_dated""")
def profile_nulls_ranges(t: Tables):
    p = t.profile_dated
    nulls = profiling.null_counts(p, ["gender", "age", "id", "became_member_on", "income"],
                                  ["missing_gender", "missing_age", "missing_id", "missing_date", "missing_income"])
    return p.agg(*nulls, F.min("age").alias("min_age"), F.max("age").alias("max_age"),
                 text.rupee(F.min("income")).alias("min_income"), text.rupee(F.max("income")).alias("max_income"),
                 F.min("became_member_on").alias("min_joining_date"),
                 F.max("became_member_on").alias("max_joining_date"))


@analysis("aud_salary_histogram", f"""
SELECT salary_bin, {rupee_sql('salary_bin')} AS salary_range, frequency
FROM (SELECT CAST(floor(income / 10000.0) * 10000 AS DOUBLE) AS salary_bin, COUNT(*) AS frequency
      FROM profile GROUP BY 1)""")
def salary_histogram(t: Tables):
    binned = t.profile.groupBy(bands.fixed_width_bin("income").alias("salary_bin")).agg(
        F.count(F.lit(1)).alias("frequency"))
    return binned.select("salary_bin", text.rupee("salary_bin").alias("salary_range"), "frequency") \
        .orderBy(F.col("frequency").desc())


# ---------------------------------------------------------------- events

@analysis("aud_flatten_events", "SELECT * FROM flat")
def flatten_events(t: Tables):
    return t.flat


@analysis("aud_distinct_event_keys", "SELECT DISTINCT person, event, offer_id, time FROM flat")
def distinct_event_keys(t: Tables):
    return t.flat.select("person", "event", "offer_id", "time").distinct()


_EVENT_ATTRS = ["event", "person", "offer_id"]


@analysis("aud_event_distincts", " UNION ".join(
    f"SELECT DISTINCT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value FROM flat" for c in _EVENT_ATTRS))
def event_distincts(t: Tables):
    return profiling.distinct_values(t.flat, _EVENT_ATTRS)


@analysis("aud_event_nulls_ranges", f"""
SELECT CAST(SUM(CASE WHEN person IS NULL THEN 1 END) AS BIGINT) AS missing_person,
       CAST(SUM(CASE WHEN event IS NULL THEN 1 END) AS BIGINT) AS missing_event,
       CAST(SUM(CASE WHEN offer_id IS NULL THEN 1 END) AS BIGINT) AS missing_offer_id,
       CAST(SUM(CASE WHEN time IS NULL THEN 1 END) AS BIGINT) AS missing_time,
       CAST(SUM(CASE WHEN amount IS NULL THEN 1 END) AS BIGINT) AS missing_amount,
       CAST(SUM(CASE WHEN reward IS NULL THEN 1 END) AS BIGINT) AS missing_reward,
       MIN(time) AS min_time, MAX(time) AS max_time,
       {rupee_sql('MIN(amount)', 2)} AS min_amount, {rupee_sql('MAX(amount)', 2)} AS max_amount,
       {rupee_sql('MIN(reward)', 2)} AS min_reward, {rupee_sql('MAX(reward)', 2)} AS max_reward
FROM flat""")
def event_nulls_ranges(t: Tables):
    e = t.flat
    nulls = profiling.null_counts(e, ["person", "event", "offer_id", "time", "amount", "reward"])
    return e.agg(*nulls, F.min("time").alias("min_time"), F.max("time").alias("max_time"),
                 text.rupee(F.min("amount"), 2).alias("min_amount"), text.rupee(F.max("amount"), 2).alias("max_amount"),
                 text.rupee(F.min("reward"), 2).alias("min_reward"), text.rupee(F.max("reward"), 2).alias("max_reward"))


@analysis("aud_subset_offer_events", "SELECT * FROM flat WHERE event IN ('offer received', 'offer viewed')")
def subset_offer_events(t: Tables):
    return t.flat.filter(F.col("event").isin(fixed.OFFER_RECEIVED, fixed.OFFER_VIEWED))


@analysis("aud_subset_transactions", "SELECT * FROM flat WHERE event = 'transaction'")
def subset_transactions(t: Tables):
    return t.flat.filter(F.col("event") == fixed.TRANSACTION)


@analysis("aud_subset_completions", "SELECT * FROM flat WHERE event = 'offer completed'")
def subset_completions(t: Tables):
    return t.flat.filter(F.col("event") == fixed.OFFER_COMPLETED)


@analysis("aud_reward_frequency", "SELECT reward, COUNT(*) AS cnt FROM flat GROUP BY reward")
def reward_frequency(t: Tables):
    return profiling.frequency(t.flat, "reward")


@analysis("aud_schema", """
SELECT 'person' AS column_name, 'string' AS data_type, CAST(MAX(length(person)) AS INTEGER) AS max_length FROM flat
UNION ALL SELECT 'event', 'string', CAST(MAX(length(event)) AS INTEGER) FROM flat
UNION ALL SELECT 'time', 'int', MAX(CAST(NULL AS INTEGER)) FROM flat
UNION ALL SELECT 'offer_id', 'string', CAST(MAX(length(offer_id)) AS INTEGER) FROM flat
UNION ALL SELECT 'amount', 'double', MAX(CAST(NULL AS INTEGER)) FROM flat
UNION ALL SELECT 'reward', 'double', MAX(CAST(NULL AS INTEGER)) FROM flat""")
def schema_listing(t: Tables):
    """Column catalogue of the flattened log: name, type and the longest
    value of each text column, measured in one aggregate over the data."""
    e = t.flat
    fields = e.schema.fields
    lengths = [(F.max(F.length(f.name)) if f.dataType.simpleString() == "string"
                else F.lit(None).cast("int")).cast("int").alias(f"_len{i}") for i, f in enumerate(fields)]
    agg = e.agg(*lengths)
    rows = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', _len{i}" for i, f in enumerate(fields))
    return agg.selectExpr(f"stack({len(fields)}, {rows}) AS (column_name, data_type, max_length)")


# ---------------------------------------------------------------- event views

for _name, _event in [("aud_view_offer_received", fixed.OFFER_RECEIVED),
                      ("aud_view_offer_viewed", fixed.OFFER_VIEWED),
                      ("aud_view_transaction_done", fixed.TRANSACTION),
                      ("aud_view_offer_completed", fixed.OFFER_COMPLETED)]:
    _cols = {fixed.TRANSACTION: "person, event, amount, time",
             fixed.OFFER_COMPLETED: "person, offer_id, event, reward, time"}.get(_event, "person, offer_id, event, time")
    analysis(_name, f"SELECT {_cols} FROM flat WHERE event = '{_event}'")(
        lambda t, _e=_event: prepare.event_view(t.flat, _e))
