"""Imputation: replace a placeholder or NULL by a statistic, a draw or a
group median.  Each returns a new DataFrame; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, fixed
from . import profiling


def replace_with_scalar(df: DataFrame, col: str, stat: Column, where: Column) -> DataFrame:
    """``UPDATE … SET col = (scalar subquery) WHERE …``.  ``stat`` is a scalar
    subquery column (``DataFrame.scalar()``): computed once, no join."""
    return df.withColumn(col, F.when(where, stat.cast(dict(df.dtypes)[col])).otherwise(F.col(col)))


def impute_int_mean(df: DataFrame, col: str, placeholder: int) -> DataFrame:
    """Replace ``placeholder`` by the truncated integer mean of the other values."""
    valid = df.filter(F.col(col) != placeholder)
    stat = valid.agg(F.avg(col).cast("int")).scalar()
    return replace_with_scalar(df, col, stat, F.col(col) == placeholder)


def impute_by_draw(df: DataFrame, col: str, id_col: str = "id",
                   thresholds=fixed.GENDER_DRAW, otherwise: str = fixed.GENDER_OTHER) -> DataFrame:
    """Fill NULLs of a categorical column by a deterministic draw per id."""
    drawn = draw.categorical_draw(draw.uniform_from_id(id_col), thresholds, otherwise)
    return df.withColumn(col, F.coalesce(F.col(col), drawn))


def impute_by_group_median(df: DataFrame, col: str, by: Sequence[str],
                           group_exprs: dict[str, Column] | None = None) -> DataFrame:
    """Fill NULLs of ``col`` with the exact median of its group.

    The medians are one grouped aggregate with one row per group.  The join
    carries no hint: adaptive execution knows the medians' measured size and
    broadcasts them when they are small, else it splits skewed groups.  A
    group with no known value leaves the NULL in place.
    """
    group_exprs = group_exprs or {}
    keyed = df
    for name, expr in group_exprs.items():
        keyed = keyed.withColumn(name, expr)
    medians = profiling.median(keyed, col, "_median", by=list(by))
    # A NULL gender or band is a group of its own in the medians but never
    # matches in an equi-join, exactly like ``c.g = m.g``.
    joined = keyed.join(medians, list(by), "left")
    out = joined.withColumn(col, F.coalesce(F.col(col), F.col("_median").cast(dict(df.dtypes)[col])))
    return out.select(*df.columns)
