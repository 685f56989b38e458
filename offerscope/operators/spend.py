"""Spend inside a time interval, per person, without a range join.

``SUM(t.amount) … JOIN transactions t ON t.person = x.person AND t.time
BETWEEN x.start AND x.end`` pairs every interval of a person with every
transaction of that person; with one heavy person that is a quadratic task.
Here the same sums come from running totals:

1. transactions are pre-aggregated to one row per (person, time) (map-side
   partial aggregate, so a heavy person is collapsed before the shuffle);
2. every interval row is exploded into its query points, one "before" its
   start and one "through" each of its ends;
3. points and queries are unioned, dealt by (person, time slice) and get a
   running sum ordered by (time, kind) in two levels (``operators.sliced``), so
   one person's rows are spread over many tasks: a "before" query sorts ahead
   of a transaction at the same hour (strict ``<``), a "through" query after it
   (inclusive ``<=``);
4. one aggregate per interval brings its running sums back together:
   spend = through(end) − before(start), likewise the count.  Its points lie in
   different slices, so this is a second exchange, of the queries alone.

The interval frame is consumed exactly once (no self-join, no re-computation
of its lineage).  Money is summed as DECIMAL at ``money_scale`` digits, so
totals are exact and independent of partitioning and summation order;
``spend`` is NULL when no transaction falls inside the interval (SQL ``SUM``
over no rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sliced import SLICE_HOURS, Running, deal, running

_BEFORE, TXN_POINT, _THROUGH = 0, 1, 2


MONEY_SCALE = 10


def money(col, money_scale: int = MONEY_SCALE):
    """An amount as DECIMAL for exact sums.  The scale is far below a cent, so
    no amount is rounded to money before it is summed."""
    return col.cast(f"decimal(28,{money_scale})")


def txn_points(txns: DataFrame, person: str = "person", money_scale: int = MONEY_SCALE) -> DataFrame:
    """Transactions pre-aggregated to one row per (person, hour): the running
    sums only ever need these totals.  Reusable across several spend rules."""
    return (txns.filter(F.col("amount").isNotNull())
            .groupBy(F.col(person).alias("_p"), F.col("time").cast("double").alias("_t"))
            .agg(F.sum(money(F.col("amount"), money_scale)).alias("_amt"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_kind", F.lit(TXN_POINT)))


def spends(intervals: DataFrame, points: DataFrame, start: str, ends: Sequence[str], person: str = "person",
           slice_hours: float = SLICE_HOURS) -> DataFrame:
    """``intervals`` plus ``spend_<k>`` (decimal, NULL if no transaction) and
    ``n_txn_<k>`` for the transactions of the same person with start <= time <=
    the k-th of ``ends``: one pass for all ends.

    Rows of ``intervals`` must be distinct (they are grouped back by all their
    columns)."""
    cols = intervals.columns
    at = [(_BEFORE, start), *[(_THROUGH, e) for e in ends]]
    bounds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col(c).cast("double").alias("t")) for i, (k, c) in enumerate(at)])
    queries = (intervals.select(*cols, F.col(person).alias("_p"), F.explode(bounds).alias("_b"))
               .select(*cols, "_p", F.col("_b.t").alias("_t"), F.col("_b.k").alias("_kind"), F.col("_b.i").alias("_i")))
    # One digit less than the most, so that adding two keeps every decimal.
    exact = f"decimal(37,{points.schema['_amt'].dataType.scale})"
    dealt = deal(queries.unionByName(points, allowMissingColumns=True), ["_p"], "_t", slice_hours)
    swept = running(dealt, ["_t", "_kind"], [Running("_cum_amt", "sum", F.col("_amt"), addend=exact), Running("_cum_n", "sum", F.col("_n"))])
    queried = swept.filter(F.col("_kind") != TXN_POINT)

    def value(c: str, i: int) -> Column:
        return F.max(F.when(F.col("_i") == i, F.coalesce(F.col(c), F.lit(0)))).alias(f"{c}_{i}")

    paired = queried.groupBy(*cols).agg(*[value(c, i) for i in range(len(at)) for c in ("_cum_amt", "_cum_n")])
    out = [F.col(c) for c in cols]
    lo_t = F.col(start).cast("double")
    for k, end in enumerate(ends):
        hi_t = F.col(end).cast("double")
        # An empty or unbounded interval, or one of no person, matches nothing.
        nothing = F.col(person).isNull() | lo_t.isNull() | hi_t.isNull() | (hi_t < lo_t)
        n = F.when(nothing, F.lit(0)).otherwise(F.col(f"_cum_n_{k + 1}") - F.col("_cum_n_0"))
        out += [F.when(n > 0, F.col(f"_cum_amt_{k + 1}").cast(exact) - F.col("_cum_amt_0").cast(exact)).alias(f"spend_{k}"), n.alias(f"n_txn_{k}")]
    return paired.select(*out)


def window_spend(intervals: DataFrame, txns: DataFrame | None, start: str, end: str,
                 person: str = "person", money_scale: int = MONEY_SCALE,
                 points: DataFrame | None = None, slice_hours: float = SLICE_HOURS) -> DataFrame:
    """``intervals`` plus ``spend`` and ``n_txn`` of one end (see ``spends``).

    Pass ``points`` (from ``txn_points``) to reuse one pre-aggregation for
    several interval sets."""
    if points is None:
        points = txn_points(txns, person, money_scale)
    out = spends(intervals, points, start, [end], person, slice_hours)
    return out.withColumnsRenamed({"spend_0": "spend", "n_txn_0": "n_txn"})
