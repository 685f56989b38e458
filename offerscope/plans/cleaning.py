"""Cleaning: profile imputation and the ordered event-deletion rules.

The original ran UPDATEs and DELETEs in script order, each seeing the result
of the previous one; here every step is a new DataFrame and the order is
kept explicitly.  Each delete rule is also available alone ("flagged"
frames).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands, fixed
from ..operators import impute, prepare
from ..operators import lifecycle as lc
from ..operators.sliced import SLICE_HOURS, whole
from ..operators.spend import TXN_POINT, money, spends
from . import quality


# ---------------------------------------------------------------- profiles

def impute_age(profile: DataFrame) -> DataFrame:
    """Placeholder age 118 → truncated mean of the other ages."""
    return impute.impute_int_mean(profile, "age", fixed.AGE_PLACEHOLDER)


def impute_gender(profile: DataFrame) -> DataFrame:
    """NULL gender → deterministic draw F (<= 0.41), M (<= 0.98), else O."""
    return impute.impute_by_draw(profile, "gender")


def impute_income(profile: DataFrame) -> DataFrame:
    """NULL income → exact median income of its (gender, age band), computed
    on the already imputed ages and genders."""
    return impute.impute_by_group_median(profile, "income", ["gender", "age_group"],
                                         {"age_group": bands.age_band("age")})


def clean_profile(profile: DataFrame) -> DataFrame:
    """date conversion → age → gender → income, in that order."""
    p = prepare.profile_with_date(profile)
    return impute_income(impute_gender(impute_age(p))).select(
        "gender", "age", "id", "became_member_on", "income")


# ---------------------------------------------------------------- events

def superseded_receipts(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None,
                        points: DataFrame | None = None) -> DataFrame:
    """Receipts whose *next* receipt of the same offer arrives strictly before
    they ended (first completion inside the window, else expiry)."""
    frame = frame if frame is not None else lc.lifecycle(events)
    w = quality.receipt_windows(frame, offers)
    valid_until = F.coalesce(F.col("completed_in_window").cast("double"), F.col("expiry_time"))
    return (w.filter(F.col("next_received").isNotNull() & (F.col("next_received") < valid_until))
            .select("person", "offer_id", F.col("received_time").alias("first_received")))


def underspend_window_flagged(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None,
                              points: DataFrame | None = None) -> DataFrame:
    """Completions inside their latest receipt's window whose spend over the
    whole window is below difficulty (no spend → NULL → not flagged)."""
    out = quality.underspend(events, offers, until="expiry", require_in_window=True, frame=frame, points=points)
    return out.select("person", "offer_id", "completed_time", "received_time", "expiry_time", "difficulty",
                      F.col("total_spent").alias("total_spend"))


def underspend_completion_flagged(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None,
                                  points: DataFrame | None = None) -> DataFrame:
    """Spend from latest receipt to completion, rounded to 0 decimals."""
    return quality.underspend_rownum(events, offers, frame=frame, points=points)


def underspend_lateral_flagged(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None,
                               points: DataFrame | None = None) -> DataFrame:
    """Per completion event, latest receipt at or before it; spend to
    completion with no spend counted as 0."""
    out = quality.underspend(events, offers, until="completion", multiplicity="rows",
                             missing_spend_as_zero=True, frame=frame, points=points)
    return out.select("person", "offer_id", "received_time", "completed_time", "difficulty", "total_spent")


RULES = [superseded_receipts, underspend_window_flagged, underspend_completion_flagged, underspend_lateral_flagged]


def chain_cells(events: DataFrame) -> DataFrame:
    """One row per (person, offer_id, time) of the de-duplicated log: the
    lifecycle flags and the transactions' sum and number.  One aggregate feeds
    both the key frame and the transaction points, so the log is read once for
    the two of them."""
    ev = F.col("event")
    of_offer = F.col("offer_id").isNotNull()
    bought = (ev == fixed.TRANSACTION) & F.col("amount").isNotNull()
    return events.groupBy("person", "offer_id", "time").agg(
        F.bool_or(of_offer & (ev == fixed.OFFER_RECEIVED)).alias("is_received"),
        F.bool_or(of_offer & (ev == fixed.OFFER_VIEWED)).alias("is_viewed"),
        F.bool_or(of_offer & (ev == fixed.OFFER_COMPLETED)).alias("is_completed"),
        F.count_if(ev == fixed.OFFER_COMPLETED).alias("n_completed_rows"),
        F.sum(F.when(bought, money(F.col("amount")))).alias("amt"), F.count_if(bought).alias("n_txn"))


def flagged_keys(events: DataFrame, offers: DataFrame, steps: int = len(RULES), slice_hours: float = SLICE_HOURS) -> DataFrame:
    """(person, offer_id, time, event) of every row that the first ``steps`` of
    the ordered rules delete.  ``events`` is the de-duplicated log.

    One linear plan, no job while it is built.  The rules only delete receipts
    or completions at whole keys, and all that a later rule could see of an
    earlier one's deletes is which receipt a completion belongs to.  The first
    rule never takes that one away: let r be the latest receipt at or before a
    completion c, and s > c the next receipt.  r would go if s came before r's
    first completion (which is at c or earlier) or, if that one is past r's
    expiry, before the expiry (which is then before c); s > c excludes both.
    So one key frame serves all rules: the first one marks receipts on it, the
    others flag completions after one spend pass for both of their ends, and a
    completion goes if any of them flags it."""
    cells = whole(chain_cells(events))
    keys = cells.filter("is_received OR is_viewed OR is_completed").drop("amt", "n_txn", "is_viewed")
    frame = lc.lifecycle_from_keys(keys.withColumn("is_viewed", F.lit(False)), slice_hours)
    terms = lc.with_offer_terms(frame, offers, "time", how="left")
    valid_until = F.coalesce(F.when(F.col("next_completed") <= F.col("expiry_time"), F.col("next_completed").cast("double")), F.col("expiry_time"))
    superseded = F.col("is_received") & (F.col("next_received") < valid_until)
    receipts = terms.filter(superseded if steps else F.lit(False)).select("person", "offer_id", "time", F.lit(fixed.OFFER_RECEIVED).alias("event"))
    if steps < 2:
        return receipts
    done = (terms.filter(F.col("is_completed") & F.col("last_received").isNotNull() & F.col("duration").isNotNull())
            .select("person", "offer_id", F.col("time").alias("completed_time"), F.col("last_received").alias("received_time"),
                    (F.col("last_received") + F.col("duration") * F.lit(fixed.HOURS_PER_DAY)).alias("expiry_time"), "difficulty", "n_completed_rows"))
    points = (cells.filter("n_txn > 0").groupBy(F.col("person").alias("_p"), F.col("time").cast("double").alias("_t"))
              .agg(F.sum("amt").alias("_amt"), F.sum("n_txn").alias("_n")).withColumn("_kind", F.lit(TXN_POINT)))
    spent = spends(done, points, "received_time", ["completed_time", "expiry_time"], slice_hours=slice_hours)
    short = [
        (F.col("completed_time") <= F.col("expiry_time")) & (F.col("spend_1").cast("double") < F.col("difficulty")),
        F.round(F.col("spend_0").cast("double"), 0) < F.col("difficulty"),
        F.coalesce((F.col("spend_0") * F.col("n_completed_rows")).cast("double"), F.lit(0.0)) < F.col("difficulty"),
    ]
    flagged = F.lit(False)
    for rule in short[:steps - 1]:
        flagged = flagged | F.coalesce(rule, F.lit(False))
    completions = spent.filter(flagged).select("person", "offer_id", F.col("completed_time").alias("time"), F.lit(fixed.OFFER_COMPLETED).alias("event"))
    return receipts.unionByName(completions)


def clean_events(events: DataFrame, offers: DataFrame, steps: int = len(RULES), slice_hours: float = SLICE_HOURS) -> DataFrame:
    """Ordered deletes: superseded receipts, then the three under-spend rules,
    each evaluated on the previous step's result.  Returns the surviving log
    (a left-anti join of the log with the deleted keys)."""
    removed = flagged_keys(events, offers, steps, slice_hours)
    return events.join(removed, ["person", "offer_id", "time", "event"], "left_anti").select(*events.columns)
