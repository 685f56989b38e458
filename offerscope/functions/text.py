"""Number and date formatting expressions.

Only the four culture-specific formats the analyses use are covered:
currency with no or two decimals in Indian (lakh) digit grouping, an integer
with thousands separators, and the full month name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Lakh grouping: a comma after every digit that is followed by an odd number
# of digits ending the string, i.e. the last 3 digits then groups of 2.
_LAKH_PATTERN = r"(\d)(?=(\d\d)+\d$)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lakh_digits(digits: Column) -> Column:
    """Insert lakh separators into a string of digits (no sign)."""
    return F.regexp_replace(digits, _LAKH_PATTERN, "$1,")


def rupee(c: str | Column, decimals: int = 0) -> Column:
    """Currency text: ``₹12,34,568`` (C0) or ``₹12,34,567.50`` (C2).

    Rounds half away from zero at the requested scale; the minus sign goes
    before the symbol; NULL stays NULL.
    """
    x = _col(c)
    fixed_point = F.abs(x.cast(f"decimal(38,{decimals})")).cast("string")
    if decimals:
        int_part = F.substring_index(fixed_point, ".", 1)
        frac_part = F.substring_index(fixed_point, ".", -1)
        body = F.concat(lakh_digits(int_part), F.lit("."), frac_part)
    else:
        body = lakh_digits(fixed_point)
    sign = F.when(x.cast(f"decimal(38,{decimals})") < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(sign, F.lit(fixed.CURRENCY_SYMBOL), body))


def thousands(c: str | Column) -> Column:
    """Integer text with thousands separators (``FORMAT(n, 'N0')``)."""
    return F.format_number(_col(c), 0)


def month_name(c: str | Column) -> Column:
    return F.date_format(_col(c), "MMMM")
