"""Offer lifecycle attribution: the one as-of operator behind every
"latest receipt at or before", "first completion after" and "next receipt"
question.

Instead of self-joining receipts to completions (which emits every pair of a
person's events for the same offer), the event log is first collapsed to one
row per distinct ``(person, offer_id, time)`` with a flag per event type.
That aggregate runs with a map-side partial step, so even a person that owns
a third of all rows contributes at most one row per offer and hour: the size
of every later group is bounded by the time domain, not by the data volume.
One window pass per direction over that compact frame then answers all
as-of questions:

=================  ============================================
column             meaning at this (person, offer_id, time)
=================  ============================================
last_received      latest receipt time <= time
prev_received      latest receipt time <  time
next_received      earliest receipt time > time
last_viewed        latest view time <= time
next_viewed        earliest view time >= time
next_completed     earliest completion time >= time
=================  ============================================

The windows are two-level (``operators.sliced``): the frame is dealt by
(person, offer_id, time slice), so the rows of one person and offer are spread
over as many tasks as they have slices.  That costs one shuffle of the
compacted keys and two of one row a slice; backward-looking questions are
answered by a descending window with a growing frame rather than an
``unboundedFollowing`` frame (which Spark re-evaluates per row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .sliced import AFTER, BEFORE, FROM, SLICE_HOURS, UPTO, Running, deal, running

KEYS = ["person", "offer_id"]

LIFECYCLE_EVENTS = [fixed.OFFER_RECEIVED, fixed.OFFER_VIEWED, fixed.OFFER_COMPLETED]


COUNTS = ("n_received_rows", "n_completed_rows", "reward_groups")


def event_keys(events: DataFrame, deduplicated: bool = False, counts: Sequence[str] = COUNTS) -> DataFrame:
    """Distinct (person, offer_id, time) with is_received / is_viewed /
    is_completed flags and, as asked by ``counts``, the number of distinct
    receipt rows, of distinct completion rows and of distinct rewards of
    completions (NULL counting as one) at that key.  Ask only for those that
    are used: the frame is exchanged whole.

    ``deduplicated=True`` (the input has no exact repeats) counts rows with
    ``count_if``: a plain hash aggregate.  Otherwise the counts are sizes of
    per-key sets of (amount, reward) payloads, which makes every output
    insensitive to exact repeats, so the frame can be built from the raw log
    without a de-duplication shuffle; a set holds at most the distinct
    payloads seen at one key and hour.
    """
    ev = F.col("event")

    def distinct_rows(event: str) -> Column:
        if deduplicated:
            return F.count_if(ev == event).cast("int")
        return F.size(F.collect_set(F.when(ev == event, F.struct("amount", "reward"))))

    counted = {"n_received_rows": distinct_rows(fixed.OFFER_RECEIVED), "n_completed_rows": distinct_rows(fixed.OFFER_COMPLETED),
               "reward_groups": F.size(F.collect_set(F.when(ev == fixed.OFFER_COMPLETED, F.struct("reward"))))}
    return (events
            .filter(F.col("offer_id").isNotNull() & ev.isin(*LIFECYCLE_EVENTS))
            .groupBy("person", "offer_id", "time")
            .agg(F.bool_or(ev == fixed.OFFER_RECEIVED).alias("is_received"),
                 F.bool_or(ev == fixed.OFFER_VIEWED).alias("is_viewed"),
                 F.bool_or(ev == fixed.OFFER_COMPLETED).alias("is_completed"),
                 *[counted[c].alias(c) for c in counts]))


def lifecycle(events: DataFrame, deduplicated: bool = False, counts: Sequence[str] = COUNTS) -> DataFrame:
    """The as-of frame described in the module docstring."""
    return lifecycle_from_keys(event_keys(events, deduplicated, counts))


def _at(flag: str) -> Column:
    return F.when(F.col(flag), F.col("time"))


def lifecycle_from_keys(keys: DataFrame, slice_hours: float = SLICE_HOURS) -> DataFrame:
    """The as-of columns over an ``event_keys`` frame (possibly edited)."""
    asked = [
        Running("last_received", "max", _at("is_received"), UPTO),
        Running("prev_received", "max", _at("is_received"), BEFORE),
        Running("last_viewed", "max", _at("is_viewed"), UPTO),
        Running("next_received", "min", _at("is_received"), AFTER),
        Running("next_viewed", "min", _at("is_viewed"), FROM),
        Running("next_completed", "min", _at("is_completed"), FROM),
    ]
    frame = running(deal(keys, KEYS, "time", slice_hours), ["time"], asked)
    # NULL persons form one window partition but match nobody in a join.
    known = [F.when(F.col("person").isNotNull(), F.col(r.name)).alias(r.name) for r in asked]
    return frame.select(*keys.columns, *known)


def with_offer_terms(frame: DataFrame, offers: DataFrame, receipt_col: str = "last_received",
                     how: str = "inner") -> DataFrame:
    """Attach duration, difficulty, offer_type and the validity window of the
    receipt in ``receipt_col``: expiry = receipt + duration * 24 (a double,
    because duration is).  The offer catalogue is a dimension table; Catalyst
    broadcasts it when its size estimate is under the broadcast threshold and
    falls back to a sort-merge join otherwise."""
    terms = offers.select(F.col("id").alias("offer_id"), "duration", "difficulty", "offer_type",
                          F.col("reward").alias("offer_reward"))
    out = frame.join(terms, "offer_id", how)
    return out.withColumn("expiry_time", F.col(receipt_col) + F.col("duration") * F.lit(fixed.HOURS_PER_DAY))

