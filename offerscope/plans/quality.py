"""Data-quality rules over offer lifecycles.  Each returns the violating rows.

All lifecycle rules are projections of one as-of frame
(``operators.lifecycle``); spend rules use prefix sums
(``operators.spend``).  Rows are replicated with ``explode(array_repeat)``
where the rule's SQL returns one row per duplicate event rather than per
distinct key, so no join back to the raw log is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import lifecycle as lc
from ..operators import prepare
from ..operators.sliced import SLICE, SLICE_HOURS, Running, deal, running
from ..operators.spend import window_spend

KEY = ["person", "offer_id", "time"]


def _offer_ids(offers: DataFrame) -> DataFrame:
    return offers.select(F.col("id").alias("offer_id"))


def _repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times (a per-key multiplicity, bounded by the
    number of duplicate events at that key)."""
    return df.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop("_rep")


# ---------------------------------------------------------------- referential

def orphan_offer(events: DataFrame, offers: DataFrame) -> DataFrame:
    """Non-transaction events whose offer is not in the catalogue."""
    return events.filter(F.col("event") != fixed.TRANSACTION).join(_offer_ids(offers), "offer_id", "left_anti") \
        .select(*events.columns)


def orphan_person(events: DataFrame, profile: DataFrame) -> DataFrame:
    """Events whose person has no profile.

    The anti-join runs on the distinct persons of the log (a map-side
    de-duplicated, compact set), not on the raw events; the raw events are
    then filtered against the (usually small) set of orphan persons: adaptive
    execution broadcasts that set if its measured size is small, else it
    splits the join's skewed partitions."""
    people = profile.select(F.col("id").alias("person"))
    orphans = events.select("person").distinct().join(people, "person", "left_anti")
    orphans = orphans.withColumnRenamed("person", "_orphan")
    # Null-safe: an event without a person has no profile either.
    return events.join(orphans, events["person"].eqNullSafe(orphans["_orphan"]), "left_semi") \
        .select(*events.columns)


def informational_completed(events: DataFrame, offers: DataFrame) -> DataFrame:
    info = offers.filter(F.col("offer_type") == fixed.INFORMATIONAL) \
        .select(F.col("id").alias("offer_id"), "offer_type")
    return prepare.completed(events).join(info, "offer_id") \
        .select("person", "offer_id", "event", "reward", "time", "offer_type")


def reward_mismatch(events: DataFrame, offers: DataFrame) -> DataFrame:
    terms = offers.select(F.col("id").alias("offer_id"), F.col("reward").alias("offer_reward"))
    return (prepare.completed(events).join(terms, "offer_id")
            .filter(F.col("reward") != F.col("offer_reward"))
            .select("person", "offer_id", "event", "reward", "time", "offer_reward"))


# ---------------------------------------------------------------- lifecycle

def _completion_terms(frame: DataFrame, offers: DataFrame, how: str = "inner") -> DataFrame:
    comp = frame.filter(F.col("is_completed"))
    return lc.with_offer_terms(comp, offers, "last_received", how)


def completed_without_receipt(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Completions (of catalogue offers) that no receipt window contains.

    With a fixed duration per offer, some receipt's window holds the
    completion iff the latest receipt at or before it does."""
    frame = frame if frame is not None else lc.lifecycle(events)
    comp = _completion_terms(frame, offers)
    covered = F.col("last_received").isNotNull() & (F.col("time") <= F.col("expiry_time"))
    bad = comp.filter(~F.coalesce(covered, F.lit(False)))
    return _repeat(bad, F.col("n_completed_rows")).select("offer_id", "person")


def completed_after_expiry(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Completions whose latest prior receipt had already expired."""
    frame = frame if frame is not None else lc.lifecycle(events)
    comp = _completion_terms(frame, offers)
    return (comp.filter(F.col("last_received").isNotNull() & (F.col("time") > F.col("expiry_time")))
            .select("person", "offer_id", F.col("time").alias("completed_time"),
                    F.col("last_received").alias("received_time"), "expiry_time"))


def completed_after_expiry_context(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Every completion key with no eligible receipt window, with the last
    prior receipt of a catalogue offer for context (NULL if none)."""
    frame = frame if frame is not None else lc.lifecycle(events)
    comp = _completion_terms(frame, offers, how="left")
    known = F.col("duration").isNotNull()
    eligible = known & F.col("last_received").isNotNull() & (F.col("time") <= F.col("expiry_time"))
    return (comp.filter(~F.coalesce(eligible, F.lit(False)))
            .select("person", "offer_id",
                    F.when(known, F.col("last_received")).alias("last_received_time"),
                    F.when(known & F.col("last_received").isNotNull(), F.col("expiry_time")).alias("last_expiry_time"),
                    F.col("time").alias("completed_time")))


_PARTNERS, _ASKING = 0, 1


def _pairs_within(roles: DataFrame, cell: list[str], partner: str) -> DataFrame:
    """The asking rows of ``roles`` with ``_partners``: the array of
    ``partner`` of the partner rows in their cell.  One exchange, no join: a
    window per cell gathers the partners first (``_role`` order), then passes
    the asking rows by them."""
    order = Window.partitionBy(*cell).orderBy("_role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gathered = F.collect_list(F.when(F.col("_role") == _PARTNERS, F.col(partner))).over(order)
    return roles.withColumn("_partners", gathered).filter(F.col("_role") == _ASKING)


def completed_unviewed_pairs(events: DataFrame, frame: DataFrame | None = None,
                             slice_hours: float = SLICE_HOURS) -> DataFrame:
    """(completion, each receipt at or before it) for completions with no
    view at or before them.

    A time-bucketed range join: receipts lie in the cell of their time slice;
    a completion is sent to the slices that hold a receipt of its person and
    offer up to its own (a running array, so empty slices cost nothing).  Only
    in its own slice can a receipt be later than the completion, so no
    (person, offer) group is compared all to all.  Both sides come out of one
    key frame, dealt into cells once."""
    frame = frame if frame is not None else lc.lifecycle(events)
    indexed = running(deal(frame, lc.KEYS, "time", slice_hours), ["time"], [Running("_with_receipts", "slices", F.col("is_received"))])
    receipt = F.struct("time", F.col("n_received_rows").alias("n"))
    unviewed = F.col("is_completed") & F.col("last_viewed").isNull()
    none = F.array().cast("array<struct<_cell:bigint,_role:int>>")
    as_partner = F.when(F.col("is_received"), F.array(F.struct(F.col(SLICE).alias("_cell"), F.lit(_PARTNERS).alias("_role")))).otherwise(none)
    as_asking = F.when(unviewed, F.transform("_with_receipts", lambda s: F.struct(s.alias("_cell"), F.lit(_ASKING).alias("_role")))).otherwise(none)
    roles = (indexed.filter(F.col("person").isNotNull() & (F.col("is_received") | unviewed))
             .select("person", "offer_id", "time", "n_completed_rows", receipt.alias("_receipt"), F.explode(F.concat(as_partner, as_asking)).alias("_r"))
             .select("person", "offer_id", "time", "n_completed_rows", "_receipt", "_r._cell", "_r._role"))
    asked = _pairs_within(roles, ["person", "offer_id", "_cell"], "_receipt")
    pairs = asked.select("person", "offer_id", F.col("time").alias("completed_time"), "n_completed_rows",
                         F.explode(F.filter("_partners", lambda r: r["time"] <= F.col("time"))).alias("_r"))
    return _repeat(pairs, F.col("n_completed_rows") * F.col("_r.n")) \
        .select("person", "offer_id", F.col("_r.time").alias("received_time"), "completed_time")


def completed_unviewed(events: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """One row per completion event with no view at or before it."""
    frame = frame if frame is not None else lc.lifecycle(events)
    comp = frame.filter(F.col("is_completed") & F.col("last_viewed").isNull())
    return _repeat(comp, F.col("n_completed_rows")).select(
        "person", "offer_id", F.col("time").alias("completed_time"))


# ---------------------------------------------------------------- spend

def underspend(events: DataFrame, offers: DataFrame, *, until: str = "completion",
               require_in_window: bool = False, multiplicity: str | None = None,
               missing_spend_as_zero: bool = False, spend_scale: int | None = None,
               frame: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """Completions whose spend since the latest receipt is below difficulty.

    ``until``: ``'completion'`` sums transactions in [receipt, completion],
    ``'expiry'`` in [receipt, receipt + duration*24].
    ``require_in_window``: only completions inside the latest receipt's window.
    ``multiplicity``: ``None`` (one sum per key), ``'rows'`` (each duplicate
    completion event adds the sum again) or ``'rewards'`` (once per distinct
    reward), reproducing how the SQL variants join before grouping.
    ``missing_spend_as_zero``: a window with no transaction spends 0 instead
    of NULL (a NULL never compares below the difficulty).
    ``spend_scale``: round the spend to that many decimals before comparing.
    """
    frame = frame if frame is not None else lc.lifecycle(events)
    comp = _completion_terms(frame, offers).filter(F.col("last_received").isNotNull())
    if require_in_window:
        comp = comp.filter(F.col("time") <= F.col("expiry_time"))
    comp = comp.withColumnRenamed("last_received", "received_time").withColumnRenamed("time", "completed_time")
    if multiplicity == "rewards":
        comp = comp.withColumn("_m", F.col("reward_groups"))
    elif multiplicity == "rows":
        comp = comp.withColumn("_m", F.col("n_completed_rows"))
    else:
        comp = comp.withColumn("_m", F.lit(1))
    end = "completed_time" if until == "completion" else "expiry_time"
    # Only what the rules report travels through the spend shuffles.
    comp = comp.select("person", "offer_id", "completed_time", "received_time", "expiry_time", "difficulty", "_m")
    txns = prepare.transactions(events) if points is None else None
    spent = window_spend(comp, txns, "received_time", end, points=points)
    total = (F.col("spend") * F.col("_m")).cast("double")
    if missing_spend_as_zero:
        total = F.coalesce(total, F.lit(0.0))
    if spend_scale is not None:
        total = F.round(total, spend_scale)
    return spent.withColumn("total_spent", total).filter(F.col("total_spent") < F.col("difficulty"))


def underspend_max(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Spend from latest receipt to completion, rounded to 2 decimals."""
    return underspend(events, offers, until="completion", multiplicity="rewards", spend_scale=2, frame=frame) \
        .select("person", "offer_id", "received_time", "completed_time", "difficulty", "total_spent")


def underspend_rownum(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None,
                      points: DataFrame | None = None) -> DataFrame:
    """Same rule with one latest receipt per completion key, rounded to 0 decimals."""
    return underspend(events, offers, until="completion", spend_scale=0, frame=frame, points=points) \
        .select("person", "offer_id", "received_time", "completed_time", "difficulty", "total_spent")


UNDERSPEND_ORDER = ["person", "offer_id", "received_time"]


def underspend_window(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Spend over the whole validity window (missing spend = 0) with the
    shortfall, in ``UNDERSPEND_ORDER``."""
    out = underspend(events, offers, until="expiry", require_in_window=True, multiplicity="rows",
                     missing_spend_as_zero=True, frame=frame)
    return out.select("person", "offer_id", "received_time", "expiry_time", "difficulty", "completed_time",
                      F.col("total_spent").alias("total_spend"),
                      (F.col("difficulty") - F.col("total_spent")).alias("shortfall")).orderBy(*UNDERSPEND_ORDER)


# ---------------------------------------------------------------- receipts

def receipt_windows(frame: DataFrame, offers: DataFrame) -> DataFrame:
    """Distinct receipts of catalogue offers with expiry, window length, the
    first completion inside the window (or NULL), the first completion at or
    after the receipt, and the next receipt of the same offer."""
    rec = lc.with_offer_terms(frame.filter(F.col("is_received")), offers, "time")
    in_window = F.when(F.col("next_completed") <= F.col("expiry_time"), F.col("next_completed"))
    return rec.select("person", "offer_id", F.col("time").alias("received_time"), "expiry_time",
                      (F.col("duration") * F.lit(fixed.HOURS_PER_DAY)).alias("window_hours"),
                      in_window.alias("completed_in_window"), F.col("next_completed").alias("first_completed"),
                      "next_received")


def _bucket(t: Column, width: Column) -> Column:
    return F.floor(F.try_divide(t.cast("double"), width))


def _later_receipts(windows: DataFrame, start: str, end: str) -> DataFrame:
    """``windows`` (one row a receipt) with ``_later``: the times of the same
    person's later receipts of the offer with ``start < time < end``, where
    ``end - start`` never exceeds the offer's window length.

    Time is cut into buckets of that length.  A receipt is a partner in the
    bucket of its time and asks in the one or two buckets its window touches,
    so only receipts less than one window apart are ever compared, never every
    pair of a busy group; both roles come out of one key frame."""
    w = F.col("window_hours")
    mine, last = _bucket(F.col(start), w).cast("long"), _bucket(F.col(end), w).cast("long")
    none = F.array().cast("array<struct<_cell:bigint,_role:int>>")
    partner = F.when(mine.isNotNull(), F.array(F.struct(mine.alias("_cell"), F.lit(_PARTNERS).alias("_role")))).otherwise(none)
    asking = F.when(mine <= last, F.transform(F.sequence(mine, last), lambda c: F.struct(c.alias("_cell"), F.lit(_ASKING).alias("_role")))).otherwise(none)
    roles = (windows.filter(F.col("person").isNotNull()).withColumn("_r", F.explode(F.concat(partner, asking)))
             .select("*", "_r._cell", "_r._role").drop("_r"))
    # A cell holds a receipt an hour at most, over two windows' length: it is one row.
    rest = [c for c in windows.columns if c not in ("person", "offer_id")]
    cells = roles.groupBy("person", "offer_id", "_cell").agg(
        F.collect_list(F.when(F.col("_role") == _PARTNERS, F.col(start))).alias("_partners"),
        F.collect_list(F.when(F.col("_role") == _ASKING, F.struct(*rest))).alias("_asking"))
    asked = cells.select("person", "offer_id", "_partners", F.explode("_asking").alias("_a")).select("person", "offer_id", "_partners", "_a.*")
    inside = F.filter("_partners", lambda t: (t > F.col(start)) & (t < F.col(end)))
    return asked.withColumn("_later", F.explode(inside)).drop("_partners")


OVERLAP_ORDER = ["person", "offer_id", "first_received"]


def overlapping_receipts(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Receipt pairs where the second arrives before the first one ended
    (completion inside its window, else expiry), in ``OVERLAP_ORDER``."""
    frame = frame if frame is not None else lc.lifecycle(events)
    w = receipt_windows(frame, offers).withColumn(
        "end_time", F.coalesce(F.col("completed_in_window").cast("double"), F.col("expiry_time")))
    return (_later_receipts(w, "received_time", "end_time")
            .select("person", "offer_id", F.col("received_time").alias("first_received"),
                    F.col("end_time").alias("first_end"), F.col("_later").alias("overlapping_received"))
            .orderBy(*OVERLAP_ORDER))


def overlapping_receipts_alt(events: DataFrame, offers: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Same question using the first completion after the receipt (unbounded)."""
    frame = frame if frame is not None else lc.lifecycle(events)
    pairs = _later_receipts(receipt_windows(frame, offers), "received_time", "expiry_time")
    cond = F.col("first_completed").isNull() | (F.col("_later") < F.col("first_completed"))
    return pairs.filter(cond).select("person", "offer_id", F.col("received_time").alias("first_received"),
                                     F.col("_later").alias("second_received"), "expiry_time",
                                     F.col("first_completed").alias("completed_time"))
