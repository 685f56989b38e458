"""Banding and binning expressions (pure JVM-side column expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(c: str | Column, cases: Sequence[tuple[Column, str]], else_: str | None = None) -> Column:
    """First matching ``(predicate, label)`` wins; ``else_`` otherwise (NULL if None)."""
    expr = None
    for predicate, label in cases:
        expr = F.when(predicate, F.lit(label)) if expr is None else expr.when(predicate, F.lit(label))
    if expr is None:
        return F.lit(else_)
    return expr.otherwise(F.lit(else_)) if else_ is not None else expr


def age_band(c: str | Column = "age") -> Column:
    """Five age groups; a NULL age falls through to the last one, as in CASE … ELSE."""
    age = _col(c)
    return band(age, [
        (age < 30, fixed.AGE_UNDER_30),
        (age.between(30, 45), fixed.AGE_30_45),
        (age.between(46, 60), fixed.AGE_46_60),
        (age.between(61, 75), fixed.AGE_61_75),
    ], else_=fixed.AGE_76_PLUS)


def income_band(c: str | Column = "income") -> Column:
    """Four income groups; no ELSE, so a NULL income has a NULL band."""
    inc = _col(c)
    lo, mid, hi = fixed.INCOME_EDGES
    return band(inc, [
        (inc < lo, fixed.INCOME_LOW),
        ((inc >= lo) & (inc < mid), fixed.INCOME_LOWER_MIDDLE),
        ((inc >= mid) & (inc < hi), fixed.INCOME_UPPER_MIDDLE),
        (inc >= hi, fixed.INCOME_HIGH),
    ])


def viewer_band(c: str | Column = "time_to_view") -> Column:
    hours = _col(c)
    quick, moderate = fixed.VIEW_EDGES
    return band(hours, [(hours <= quick, fixed.VIEW_QUICK),
                        (hours <= moderate, fixed.VIEW_MODERATE)], else_=fixed.VIEW_LATE)


def outlier_class(c: str | Column, q1: Column, q3: Column, k: float = fixed.IQR_FACTOR) -> Column:
    """Tukey fences ``q1 - k*IQR`` / ``q3 + k*IQR`` (strict comparisons)."""
    x = _col(c)
    iqr = q3 - q1
    return band(x, [(x < q1 - F.lit(k) * iqr, fixed.LOW_OUTLIER),
                    (x > q3 + F.lit(k) * iqr, fixed.HIGH_OUTLIER)], else_=fixed.NORMAL)


def fixed_width_bin(c: str | Column, width: int = fixed.SALARY_BIN) -> Column:
    """``FLOOR(x / width) * width`` with a double division, as a double."""
    return (F.floor(_col(c).cast("double") / F.lit(float(width))) * F.lit(width)).cast("double")
