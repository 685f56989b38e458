"""Column expressions used across the analyses (all built-in Spark functions)."""

from . import bands, draw, fixed, text  # noqa: F401
from .bands import age_band, band, fixed_width_bin, income_band, outlier_class, viewer_band  # noqa: F401
from .draw import categorical_draw, uniform_from_id  # noqa: F401
from .text import month_name, rupee, thousands  # noqa: F401


def ratio(numerator, denominator):
    """``1.0 * n / d`` as a double; NULL instead of an error when ``d`` is 0."""
    from pyspark.sql import functions as F
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
