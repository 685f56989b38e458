"""Adapter from the generated test tables to the three raw inputs.

The test data ships an ``events`` stream (event_id, ts, user_id, event_type,
value, props) and a ``customer`` table.  This module re-expresses them, with
Spark column expressions only, as

* ``transcript``: person, event, value (single-quoted dict text), time;
* ``profile``: gender, age, id, became_member_on (yyyymmdd int), income;
* ``portfolio``: the offers the event log refers to, with attributes from a
  fixed ten-offer catalogue.

The mapping rules are fixed values documented in FIXTURES.md §2; the DuckDB
oracle builds the same three relations in SQL (``plans.oracle``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed

# --- fixed values: the fixture's offer catalogue -------------------------
# (id, reward, difficulty, duration in days, offer_type, channels)
OFFER_CATALOGUE = [
    ("offer_0", 10, 10, 7.0, "bogo", ["email", "mobile", "social"]),
    ("offer_1", 10, 10, 5.0, "bogo", ["web", "email", "mobile", "social"]),
    ("offer_2", 0, 0, 4.0, "informational", ["web", "email", "mobile"]),
    ("offer_3", 5, 5, 7.0, "bogo", ["web", "email", "mobile"]),
    ("offer_4", 5, 20, 10.0, "discount", ["web", "email"]),
    ("offer_5", 3, 7, 7.0, "discount", ["web", "email", "mobile", "social"]),
    ("offer_6", 2, 10, 10.0, "discount", ["web", "email", "mobile", "social"]),
    ("offer_7", 0, 0, 3.0, "informational", ["email", "mobile", "social"]),
    ("offer_8", 5, 5, 5.0, "bogo", ["web", "email", "mobile", "social"]),
    ("offer_9", 2, 10, 7.0, "discount", ["web", "email", "mobile"]),
]

# --- fixed values: mapping rules (FIXTURES.md §2) ------------------------
EPOCH = "2024-01-01 00:00:00"   # hour 0 of the event clock
TIME_GRAIN_HOURS = 6            # event times are whole multiples of 6 hours
ORPHAN_OFFER_MIN_K = 98         # k >= 98 names an offer missing from the catalogue
BAD_REWARD_EVERY = 97           # every 97th completion carries a wrong reward
BAD_REWARD = 99
ORPHAN_PERSON_EVERY = 50        # events with user_id % 50 = 49 are of a person without a profile


@dataclass(frozen=True)
class RawTables:
    portfolio: DataFrame
    profile: DataFrame
    transcript: DataFrame


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def portfolio_from(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Offers of the fixed catalogue that the event log refers to.

    A left-semi join of a ten-row relation: the result can never exceed the
    catalogue, which is what lets downstream joins broadcast it.
    """
    referenced = events.select(F.concat(F.lit("offer_"), (_k() % 10).cast("string")).alias("id")).distinct()
    return catalogue(spark).join(referenced, "id", "left_semi")


def catalogue(spark: SparkSession) -> DataFrame:
    """The fixed catalogue as a JVM-side local relation (one VALUES clause,
    no Python RDD), so Catalyst knows its size and broadcasts it in joins."""
    def row(i, r, d, dur, t, ch):
        channels = ", ".join(f"'{c}'" for c in ch)
        return f"('{i}', {r}, {d}, CAST({float(dur)} AS DOUBLE), '{t}', array({channels}))"
    values = ",\n".join(row(*o) for o in OFFER_CATALOGUE)
    cols = ", ".join(f.name for f in schemas.PORTFOLIO.fields)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS catalogue({cols})")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PORTFOLIO.fields])


def profile_from(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    unknown = key % 8 == 0
    w = (key * 37) % 84
    u = (key * 53) % 91
    gender = (F.when(unknown, F.lit(None).cast("string"))
              .when(key % 64 == 63, F.lit("O"))
              .when(key % 7 < 4, F.lit("M"))
              .otherwise(F.lit("F")))
    age = F.when(unknown, F.lit(fixed.AGE_PLACEHOLDER)).otherwise(
        F.lit(18) + F.floor((w * w * w * w).cast("double") / F.lit(592704.0)).cast("int"))
    income = F.when(unknown, F.lit(None).cast("double")).otherwise(
        (F.lit(30000) + F.lit(1000) * F.floor((u * u * u * u).cast("double") / F.lit(729000.0))).cast("double"))
    joined = ((F.lit(2013) + key % 6) * 10000 + (F.lit(1) + key % 12) * 100 + F.lit(1) + key % 28).cast("int")
    return (customer.select(gender.alias("gender"), age.cast("int").alias("age"),
                             F.concat(F.lit("person_"), key.cast("string")).alias("id"),
                             joined.alias("became_member_on"), income.alias("income")))


def transcript_from(events: DataFrame) -> DataFrame:
    uid = F.col("user_id")
    etype = F.col("event_type")
    event = (F.when((etype == "purchase") & (uid % 20 != 17), F.lit(fixed.TRANSACTION))
             .when((etype == "view") & (uid % 20 != 18), F.lit(fixed.OFFER_VIEWED))
             .when((etype == "click") & (uid % 20 != 19), F.lit(fixed.OFFER_COMPLETED))
             .otherwise(F.lit(fixed.OFFER_RECEIVED)))
    # Whole hours since the epoch, computed on the wall-clock value (no
    # session time zone involved): days since the epoch date * 24 + hour.
    ts = F.col("ts").cast("timestamp_ntz")
    hours = F.datediff(F.to_date(ts), F.to_date(F.lit(EPOCH))) * 24 + F.hour(ts)
    time = (hours - hours % TIME_GRAIN_HOURS).cast("int")
    k = _k()
    offer_no = F.when(k >= ORPHAN_OFFER_MIN_K, k).otherwise(k % 10)
    offer_id = F.concat(F.lit("offer_"), offer_no.cast("string"))
    catalogue_reward = F.array(*[F.lit(o[1]) for o in OFFER_CATALOGUE])[k % 10]
    reward = F.when(F.col("event_id") % BAD_REWARD_EVERY == 0, F.lit(BAD_REWARD)).otherwise(catalogue_reward)
    value = (F.when(event == fixed.TRANSACTION,
                    F.concat(F.lit("{'amount': "), F.col("value").cast("string"), F.lit("}")))
             .when(event == fixed.OFFER_COMPLETED,
                   F.concat(F.lit("{'offer_id': '"), offer_id, F.lit("', 'reward': "),
                            reward.cast("string"), F.lit("}")))
             .otherwise(F.concat(F.lit("{'offer id': '"), offer_id, F.lit("'}"))))
    stranger = uid % ORPHAN_PERSON_EVERY == ORPHAN_PERSON_EVERY - 1
    person = F.concat(F.when(stranger, "stranger_").otherwise("person_"), uid.cast("string"))
    return events.select(person.alias("person"),
                         event.alias("event"), value.alias("value"), time.alias("time"))


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """Lazily derive (portfolio, profile, transcript) from ``sf_dir``'s parquet."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return raw_tables_from(spark, events, customer)


def raw_tables_from(spark: SparkSession, events: DataFrame, customer: DataFrame) -> RawTables:
    """Same mapping over already loaded (or derived) events/customer frames."""
    return RawTables(portfolio=portfolio_from(spark, events),
                     profile=profile_from(customer),
                     transcript=transcript_from(events))
