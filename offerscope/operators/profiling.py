"""Profiling statistics as DataFrame → DataFrame functions.

All are aggregates that Spark computes with a partial (map-side) step.  Exact
percentiles of a column with few distinct values (an age, an income in
thousands) merge one entry a distinct value; ``wide=True`` selects them by rank
(``operators.selection``) where distinct values are unbounded, and
``approx=True`` swaps in ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, fixed
from .selection import select_quantiles

FIVE_NUMBER = (0.0, 0.25, 0.5, 0.75, 1.0)


def quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str],
              by: Sequence[str] = (), approx: bool = False, accuracy: int = 100000, wide: bool = False) -> DataFrame:
    """Continuous-interpolation percentiles (``PERCENTILE_CONT``) as columns.

    Written as a (grouped) aggregate, not as a window over all rows: a
    window with an empty PARTITION BY would move every row to one task.
    Exact mode first counts each distinct value (a distributed aggregate with
    a map-side combine), then runs ``percentile`` with those counts as
    frequencies: the final merge sees every distinct value once, instead of
    one value map per input task.  ``wide`` (without ``by``): distributed rank
    selection, no task holds all distinct values.
    """
    if wide and not approx:
        if by:
            raise ValueError("rank selection is over all rows; group few distinct values instead")
        return select_quantiles(df, col, probs, names)
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    if approx:
        agg_expr = F.percentile_approx(F.col(col).cast("double"), list(probs), accuracy).alias("_q")
        source = df
    else:
        source = (df.filter(F.col(col).isNotNull())
                  .groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_f")))
        agg_expr = F.percentile(F.col("_v"), probs_arr, F.col("_f")).alias("_q")
    agg = source.groupBy(*by).agg(agg_expr) if by else source.agg(agg_expr)
    return agg.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def five_number(df: DataFrame, col: str, names: Sequence[str] | None = None,
                by: Sequence[str] = (), approx: bool = False, wide: bool = False) -> DataFrame:
    names = names or [f"min_{col}", "q1", f"median_{col}", "q3", f"max_{col}"]
    return quantiles(df, col, FIVE_NUMBER, names, by, approx, wide=wide)


def median(df: DataFrame, col: str, name: str | None = None, by: Sequence[str] = (),
           approx: bool = False) -> DataFrame:
    return quantiles(df, col, [0.5], [name or f"median_{col}"], by, approx)


def iqr_outliers(df: DataFrame, col: str, keep: Sequence[str], k: float = fixed.IQR_FACTOR,
                 label: str = "outlier_category", approx: bool = False,
                 only_outliers: bool = True, wide: bool = False) -> DataFrame:
    """Rows of ``df`` classed Low/High Outlier by Tukey fences.

    The quartiles are one row used as a scalar subquery: Spark evaluates it
    once and inlines the two numbers, so the row-level pass is a plain
    filter/project with no join and no shuffle of ``df``.
    """
    stats = quantiles(df, col, [0.25, 0.75], ["q1", "q3"], approx=approx, wide=wide)
    if wide and not approx:
        # A deep subquery: referred to once, as the fences that the rows are held against.
        iqr = F.col("q3") - F.col("q1")
        fences = stats.select(F.struct((F.col("q1") - F.lit(k) * iqr).alias("low"), (F.col("q3") + F.lit(k) * iqr).alias("high"))).scalar()
        x = F.col(col)
        classed = F.transform("_fences", lambda f: bands.band(x, [(x < f["low"], fixed.LOW_OUTLIER), (x > f["high"], fixed.HIGH_OUTLIER)], else_=fixed.NORMAL))
        out = df.withColumn("_fences", F.array(fences)).select(*keep, F.get(classed, F.lit(0)).alias(label))
    else:
        out = df.select(*keep, bands.outlier_class(col, stats.select("q1").scalar(), stats.select("q3").scalar(), k).alias(label))
    if only_outliers:
        out = out.filter(F.col(label).isin(fixed.HIGH_OUTLIER, fixed.LOW_OUTLIER))
    return out


def mean_int(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Integer mean: ``AVG`` over an INT column truncates toward zero."""
    return df.agg(F.avg(col).cast("int").alias(name or f"avg_{col}"))


def mean(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return df.agg(F.avg(F.col(col).cast("double")).alias(name or f"avg_{col}"))


def frequency(df: DataFrame, cols: str | Sequence[str], name: str = "cnt") -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def mode(df: DataFrame, col: str, name: str = "cnt", drop_nulls: bool = False) -> DataFrame:
    """Most frequent value and its count; ties go to the smallest value
    (NULL first).  ``groupBy`` then a top-1 (``TakeOrderedAndProject``):
    only one row per partition reaches the final merge."""
    src = df.filter(F.col(col).isNotNull()) if drop_nulls else df
    return (frequency(src, col, name)
            .orderBy(F.col(name).desc(), F.col(col).asc_nulls_first()).limit(1))


def share_of_total(counts: DataFrame, count_col: str = "cnt", name: str = "share",
                   scale: float = 1.0, decimals: int | None = None) -> DataFrame:
    """``scale * n / SUM(n) OVER ()`` on an already aggregated (small) frame."""
    total = counts.agg(F.sum(count_col)).scalar()
    share = F.try_divide(F.col(count_col).cast("double") * F.lit(scale), total.cast("double"))
    if decimals is not None:
        share = F.round(share, decimals)
    return counts.withColumn(name, share)


def null_counts(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None) -> list[Column]:
    """``SUM(CASE WHEN c IS NULL THEN 1 END)``: NULL (not 0) when nothing is missing."""
    names = names or [f"missing_{c}" for c in cols]
    return [F.sum(F.when(F.col(c).isNull(), F.lit(1))).alias(n) for c, n in zip(cols, names)]


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form (attribute, value) of each column's distinct values, as text.

    One pass: the columns are unpivoted with ``stack`` and de-duplicated in a
    single aggregate instead of one scan per column.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (attribute, value)").distinct()
