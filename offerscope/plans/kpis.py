"""Descriptive KPIs as DataFrame functions.

Spend KPIs pre-aggregate transactions to one row per person (map-side
partial aggregate) before joining profiles, so a heavy person reaches the
join as a single row; the per-band average is then
``SUM(person totals) / COUNT(persons)``, which equals
``SUM(amount) / COUNT(DISTINCT person)`` over the joined rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, fixed, ratio
from ..operators import lifecycle as lc
from ..operators import prepare
from ..operators.spend import money


def offer_average(offers: DataFrame, col: str, name: str) -> DataFrame:
    return offers.agg(F.avg(F.col(col).cast("double")).alias(name))


def spend_per_person(txns: DataFrame) -> DataFrame:
    """person, total (exact money sum), n_txn."""
    return txns.groupBy("person").agg(F.sum(money(F.col("amount"))).alias("total"),
                                      F.count(F.lit(1)).alias("n_txn"))


# Purchases without a person count as purchases, but NULL is no customer.
def spend_per_customer(txns: DataFrame) -> DataFrame:
    per = spend_per_person(txns)
    return per.agg(ratio(F.sum("total"), F.count("person")).alias("avg_order_value"))


def txn_per_customer(txns: DataFrame) -> DataFrame:
    per = spend_per_person(txns)
    return per.agg(ratio(F.sum("n_txn"), F.count("person")).alias("avg_trans_per_cust"))


def repeat_rate(txns: DataFrame) -> DataFrame:
    per = spend_per_person(txns)
    return per.agg(ratio(F.count_if((F.col("n_txn") > 1) & F.col("person").isNotNull()), F.count("person")).alias("repeat_cust_rate"))


def persons_without(events: DataFrame, have: str, lack: str) -> DataFrame:
    """Distinct persons with a ``have`` event and no ``lack`` event at all."""
    a = events.filter(F.col("event") == have).select("person").distinct()
    b = events.filter(F.col("event") == lack).select("person").distinct()
    return a.join(b, "person", "left_anti")


def view_completion_rate(events: DataFrame) -> DataFrame:
    ev = F.col("event")
    rec = F.count_if(ev == fixed.OFFER_RECEIVED)
    return events.agg(ratio(F.count_if(ev == fixed.OFFER_VIEWED), rec).alias("view_rate"),
                      ratio(F.count_if(ev == fixed.OFFER_COMPLETED), rec).alias("completion_rate"))


def avg_hours_since_receipt(frame: DataFrame, flag: str, name: str) -> DataFrame:
    """Mean of (event time − latest receipt at or before it) over distinct
    event keys that have such a receipt."""
    rows = frame.filter(F.col(flag) & F.col("last_received").isNotNull())
    return rows.agg(F.avg((F.col("time") - F.col("last_received")).cast("double")).alias(name))


def expired_share(frame: DataFrame, offers: DataFrame) -> DataFrame:
    """Share of distinct receipts with no completion inside their window."""
    rec = lc.with_offer_terms(frame.filter(F.col("is_received")), offers, "time")
    done = F.col("next_completed") <= F.col("expiry_time")
    n = F.count(F.lit(1))
    return rec.agg(ratio(F.count_if(~F.coalesce(done, F.lit(False))), n).alias("expired_pct"),
                   ratio(F.count_if(F.coalesce(done, F.lit(False))), n).alias("completed_pct"))


def expired_share_simple(events: DataFrame) -> DataFrame:
    ev = F.col("event")
    share = ratio(F.count_if(ev == fixed.OFFER_COMPLETED), F.count_if(ev == fixed.OFFER_RECEIVED))
    return events.agg((F.lit(1.0) - share).alias("expired_pct"), share.alias("completed_pct"))


def spend_by(txns: DataFrame, profile: DataFrame, group: Column, name: str) -> DataFrame:
    """Average spend per transacting person by a profile attribute."""
    per = spend_per_person(txns)
    people = profile.select(F.col("id").alias("person"), group.alias(name))
    joined = per.join(people, "person")
    return (joined.groupBy(name).agg(ratio(F.sum("total"), F.count(F.lit(1))).alias("average_spend"))
            .orderBy("average_spend"))


def completion_by_viewer_speed(frame: DataFrame) -> DataFrame:
    """Per distinct receipt: hours to the first view and whether any
    completion followed; grouped by viewing speed."""
    rec = frame.filter(F.col("is_received")).select(
        (F.col("next_viewed") - F.col("time")).alias("time_to_view"),
        F.col("next_completed").isNotNull().cast("int").alias("completed_flag"))
    viewed = rec.filter(F.col("time_to_view").isNotNull())
    return (viewed.groupBy(bands.viewer_band("time_to_view").alias("view_group"))
            .agg(F.count(F.lit(1)).alias("total"), F.sum("completed_flag").alias("completed"),
                 ratio(F.sum("completed_flag"), F.count(F.lit(1))).alias("completion_rate")))


def multi_offer_completers(events: DataFrame) -> DataFrame:
    comp = prepare.completed(events)
    return (comp.groupBy("person")
            .agg(F.count("offer_id").alias("offers_completed"), F.count_distinct("offer_id").alias("_n"))
            .filter(F.col("_n") > 1).drop("_n"))


def offer_event_counts(events: DataFrame, by: Sequence[str] = ("person", "offer_id")) -> DataFrame:
    """Per (person, offer): counts of receipts, views and completions — the
    compact input of every rate analysis."""
    ev = F.col("event")
    return (events.filter(F.col("offer_id").isNotNull()
                          & ev.isin(fixed.OFFER_RECEIVED, fixed.OFFER_VIEWED, fixed.OFFER_COMPLETED))
            .groupBy(*by)
            .agg(F.count_if(ev == fixed.OFFER_RECEIVED).alias("n_received"),
                 F.count_if(ev == fixed.OFFER_VIEWED).alias("n_viewed"),
                 F.count_if(ev == fixed.OFFER_COMPLETED).alias("n_completed")))
