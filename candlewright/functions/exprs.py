"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def holds(predicate: Column) -> Column:
    """The predicate, false where it is unknown."""
    return F.coalesce(predicate, F.lit(False))


def full(agg: Callable[[Column], Column], column: Column, n: int, w: WindowSpec, before: int = 0) -> Column:
    """``agg`` over the last ``n`` rows (ending ``before`` rows ago), NULL unless all ``n`` values are known."""
    frame = w.rowsBetween(-(n - 1) - before, -before)
    return F.when(F.count(column).over(frame) == n, agg(column).over(frame))


def row_median(*columns: Column) -> Column:
    """Median of the known values of a row."""
    a = F.array_sort(F.array_compact(F.array(*columns)))
    n = F.size(a)
    mid = (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, mid)


def flag(predicate: Column) -> Column:
    """1.0 where the predicate holds, else 0.0 (also where it is unknown)."""
    return F.when(predicate, 1.0).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def no_nan(column: Column) -> Column:
    """NULL instead of NaN."""
    return F.when(~F.isnan(column), column)
