"""Exact quantiles by distributed rank selection.

No task ever holds all distinct values.  The values are counted first (one
row a distinct value, with a map-side combine); then each asked rank is closed
in on: a histogram of bounded size says which bin holds the rank and how many
values lie below, and the next histogram is of that bin alone.  The first
bins grow with the value's size (quarter octaves), those of the two rounds after
it split the bin's own range evenly.  After three rounds a bracket is
2^-34 of its values' size, so it holds at most 2^18 different doubles whatever the
data; the rank's value is read off there.

The plan is fixed: no job runs while it is built.  Every round's brackets are
one row, which the next round takes as a scalar subquery; the counted values
are exchanged once and reused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 2           # even splits after the first histogram
BINS = 1 << 16       # of an even split


def _first_bin(v: Column) -> Column:
    """A number that never falls as ``v`` grows: quarter octaves of its size,
    at most 2^14 of them; zero, infinities and NaN have their own."""
    octave = F.floor(F.log2(F.abs(v)) * 4).cast("long")
    size = F.when(v == 0, F.lit(0)).otherwise(octave + 10_000)
    size = F.when(F.abs(v) == float("inf"), F.lit(1 << 20)).otherwise(size)
    return F.when(F.isnan(v), F.lit(1 << 21)).otherwise(F.when(v < 0, -size).otherwise(size)).cast("long")


def _even_bin(v: Column, lo: Column, hi: Column) -> Column:
    """A number that never falls as ``v`` grows from ``lo`` to ``hi``."""
    part = F.try_divide(v - lo, hi - lo)
    return F.coalesce(F.floor(F.when(F.isnan(part), F.lit(0.0)).otherwise(part) * (BINS - 1)).cast("long"), F.lit(0).cast("long"))


def _place(bins: Column, rank: Column, below: Column) -> Column:
    """Which of the sorted ``bins`` (lo, hi, n) holds the value of ``rank``,
    ``below`` values lying before the first one: (rank, lo, hi, below)."""
    none = F.lit(None)
    start = F.struct(below.cast("long").alias("sum"), F.lit(False).alias("done"), none.cast("double").alias("lo"), none.cast("double").alias("hi"), none.cast("long").alias("below"))

    def step(s: Column, b: Column) -> Column:
        here = ~s["done"] & (rank < s["sum"] + b["n"])
        return F.struct(F.when(s["done"], s["sum"]).otherwise(s["sum"] + b["n"]).alias("sum"), (s["done"] | here).alias("done"),
                        F.when(here, b["lo"]).otherwise(s["lo"]).alias("lo"), F.when(here, b["hi"]).otherwise(s["hi"]).alias("hi"),
                        F.when(here, s["sum"]).otherwise(s["below"]).alias("below"))

    return F.aggregate(bins, start, step, lambda s: F.struct(rank.cast("long").alias("rank"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["below"].alias("below")))


def _brackets(places: str) -> Column:
    """The places (rank, lo, hi, below) by bracket: (lo, hi, below, total, ranks).
    A bracket takes all that a later round has to know along as a group's key,
    so that every round refers to the one before it once."""
    def bracket(p: Column) -> Column:
        mine = F.filter(places, lambda q: (q["lo"] == p["lo"]) & (q["hi"] == p["hi"]))
        return F.struct(p["lo"].alias("lo"), p["hi"].alias("hi"), p["below"].alias("below"), F.col("total"),
                        F.array_sort(F.transform(mine, lambda q: q["rank"])).alias("ranks"))
    return F.array_distinct(F.transform(places, bracket))


def within(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """The values inside one of ``brackets`` (one row, an array), once for each
    they lie in, with the bracket as ``_b``."""
    inside = F.filter("_all", lambda b: (F.col("_v") >= b["lo"]) & (F.col("_v") <= b["hi"]))
    return values.withColumn("_all", brackets.scalar()).select("_v", "_f", F.explode(inside).alias("_b"))


def _placed(bins: DataFrame) -> DataFrame:
    """One row (total, places) of the bins (_b, lo, hi, n): where each rank of
    each bracket lies."""
    listed = bins.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "n"))).alias("bins"))
    found = listed.select("_b.total", F.transform("_b.ranks", lambda r: _place(F.col("bins"), r, F.col("_b.below"))).alias("found"))
    return found.agg(F.max("total").alias("total"), F.flatten(F.collect_list("found")).alias("places"))


def counted_values(df: DataFrame, col: str) -> DataFrame:
    """(_v, _f): the distinct values of ``col`` as doubles, counted."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_f")))


def _histogram(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy(*by, "_bin").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_f").alias("n"))


def narrow(values: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row, an array: the last brackets of the ranks that ``probs`` ask for."""
    first = _histogram(values.withColumn("_bin", _first_bin(F.col("_v")))).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "n"))).alias("bins"))
    first = first.withColumn("total", F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + b["n"]))
    places = F.array(*[F.lit(float(p)) * (F.col("total") - 1) for p in probs])
    wanted = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    none = F.array().cast("array<bigint>")
    first = first.withColumn("wanted", F.when(F.col("total") > 0, wanted).otherwise(none))
    placed = first.select("total", F.transform("wanted", lambda r: _place(F.col("bins"), r, F.lit(0))).alias("places"))
    for _ in range(ROUNDS):
        inside = within(values, placed.select(_brackets("places")))
        split = inside.withColumn("_bin", _even_bin(F.col("_v"), F.col("_b.lo"), F.col("_b.hi")))
        placed = _placed(_histogram(split, "_b"))
    return placed.select(_brackets("places"))


def select_quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row: the continuous-interpolation percentiles (``PERCENTILE_CONT``)
    of ``col`` at ``probs``; NULLs are left out, and all NULL if no value is."""
    values = counted_values(df, col)
    last = within(values, narrow(values, probs)).select("_b", F.col("_v").alias("lo"), F.col("_v").alias("hi"), F.col("_f").alias("n"))
    found = _placed(last).withColumn("at", F.map_from_entries(F.transform("places", lambda p: F.struct(p["rank"], p["lo"]))))
    out = []
    for p, name in zip(probs, names):
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.element_at("at", low), F.element_at("at", high)
        mixed = (high.cast("double") - place) * a + (place - low.cast("double")) * b
        out.append(F.when((low == high) | (a == b), a).otherwise(mixed).alias(name))
    return found.select(*out)
