"""Deterministic pseudo-random draws keyed by an id.

The original imputation drew from ``NEWID()``, which is not reproducible.
A draw from the md5 of the id is uniform enough, identical on every engine
and every re-run, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def uniform_from_id(c: str | Column, resolution: int = 10000) -> Column:
    """Value in [0, 1) with ``resolution`` steps, from the first 32 bits of md5(id)."""
    key = F.col(c) if isinstance(c, str) else c
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (bits % F.lit(resolution)).cast("double") / F.lit(float(resolution))


def categorical_draw(u: Column, thresholds: Sequence[tuple[str, float]] = fixed.GENDER_DRAW,
                     otherwise: str = fixed.GENDER_OTHER) -> Column:
    """Map a uniform draw to a category by cumulative thresholds (``u <= t``)."""
    expr = None
    for label, upper in thresholds:
        expr = F.when(u <= F.lit(upper), F.lit(label)) if expr is None else expr.when(u <= F.lit(upper), F.lit(label))
    return expr.otherwise(F.lit(otherwise)) if expr is not None else F.lit(otherwise)
