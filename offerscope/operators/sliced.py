"""Running aggregates in two levels: within time slices, and over the slices.

A window over all rows of a key is one task's work; a key that owns a third of
the log would pin it.  Here a key's rows are dealt by (key, time slice): every
slice is scanned on its own, each slice's totals (one row a slice) are scanned
over the key, and the carry so found is added to the slice's own running
values.  A key with many rows is thus spread over as many tasks as it has
slices; the only rows of a key that meet are its slices' totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
SLICE_HOURS = 240

UPTO, BEFORE, FROM, AFTER = "upto", "before", "from", "after"


@dataclass(frozen=True)
class Running:
    """``how`` ('sum', 'max' or 'min') of ``value`` over the rows of the key
    that come up to this one or before it, or from this one on or after it.

    ``how='slices'``: the slices that hold a row with ``value`` true, as an
    array: an index with which a row finds the earlier ones slice by slice."""

    name: str
    how: str
    value: Column
    side: str = UPTO
    addend: str | None = None   # type in which a sum and its carry are added, if not their own

    @property
    def backward(self) -> bool:
        return self.side in (FROM, AFTER)

    def aggregate(self, value: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min, "slices": F.max}[self.how](value)

    def carry(self, total: Column, over: Window) -> Column:
        if self.how == "slices":
            return F.collect_list(F.when(total, F.col(SLICE))).over(over)
        return self.aggregate(total).over(over)

    def combine(self, inner: Column, carry: Column) -> Column:
        if self.how == "sum":
            if self.addend:
                inner, carry = inner.cast(self.addend), carry.cast(self.addend)
            return F.coalesce(inner + carry, inner, carry)
        if self.how == "slices":
            none = F.array().cast("array<long>")
            return F.concat(F.coalesce(carry, none), F.when(inner, F.array(SLICE)).otherwise(none))
        return F.greatest(inner, carry) if self.how == "max" else F.least(inner, carry)


def slice_of(time: str | Column, width: float = SLICE_HOURS) -> Column:
    t = F.col(time) if isinstance(time, str) else time
    return F.floor(t.cast("double") / F.lit(float(width))).cast("long")


KEY = "_key"


def whole(frame: DataFrame) -> DataFrame:
    """``frame``, read whole whatever of it is used.

    The filter is always true; as it names every column, two uses of the frame
    that need different columns still ask for the same exchange below it, and
    Spark runs that once instead of computing the frame for each."""
    return frame.filter(F.xxhash64(*frame.columns) >= F.lit(-(1 << 63)))


def deal(frame: DataFrame, keys: Sequence[str], time: str, width: float = SLICE_HOURS) -> DataFrame:
    """``frame`` with its key and slice, dealt by them.

    The rows are read twice from here, for their own values and for the
    slices' totals, hence ``whole``.  The key is one struct, which is never
    NULL: a join on it adds no filter to one of its sides alone."""
    sliced = frame.withColumns({KEY: F.struct(*keys), SLICE: slice_of(time, width)})
    return whole(sliced).repartition(KEY, SLICE)


def running(dealt: DataFrame, order: Sequence[str], columns: Sequence[Running]) -> DataFrame:
    """``dealt`` (from ``deal``) plus one column for each of ``columns``.

    ``order`` begins with the time that the slices are of; rows that tie in it
    take each other's place in any order.  NULL keys are a key."""
    inside = Window.partitionBy(KEY, SLICE)
    over = Window.partitionBy(KEY)
    asc, desc = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]

    def frame_of(r: Running):
        last = Window.currentRow if r.side in (UPTO, FROM) else -1
        return inside.orderBy(*(desc if r.backward else asc)).rowsBetween(Window.unboundedPreceding, last)

    def slices_before(r: Running):
        return over.orderBy(F.col(SLICE).desc() if r.backward else F.col(SLICE).asc()).rowsBetween(Window.unboundedPreceding, -1)

    # Neither grouping by (key, slice) nor the windows inside a slice shuffle again.
    totals = dealt.groupBy(KEY, SLICE).agg(*[r.aggregate(r.value).alias(r.name) for r in columns])
    carry = totals.select(F.col(KEY).alias("_of_key"), F.col(SLICE).alias("_of_slice"), *[r.carry(F.col(r.name), slices_before(r)).alias(f"_{r.name}") for r in columns])
    inner = dealt.select(*dealt.columns, *[r.aggregate(r.value).over(frame_of(r)).alias(r.name) for r in columns])
    out = inner.join(carry, [inner[KEY] == carry["_of_key"], inner[SLICE] == carry["_of_slice"]], "left")
    kept = [c for c in dealt.columns if c != KEY]
    return out.select(*kept, *[r.combine(F.col(r.name), F.col(f"_{r.name}")).alias(r.name) for r in columns])
