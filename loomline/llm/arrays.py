"""Running values over long arrays in SQL functions, in time that grows with their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(array: Column, size: int = CHUNK) -> Column:
    """The array cut into arrays of a size; none of an empty one."""

    def cut(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.slice(a, at, size))

    return let(array, cut)


def running(array: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """array<int> of an associative operation over the elements (int) so far.

    Appending to an array copies it, so this runs inside chunks, then over the
    chunks' last values.
    """

    def scan(values: Column) -> Column:
        step = lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(combine(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), x)))
        return F.aggregate(values, F.array().cast("array<int>"), step)

    def join(parts: Column) -> Column:
        after = lambda p, top: F.transform(p, lambda x: combine(top, x))
        whole = lambda tops: F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(let(F.get(tops, k - 1), lambda top: after(p, top))))
        return F.flatten(let(let(F.transform(parts, lambda p: F.element_at(p, -1)), scan), whole))

    return let(array, lambda a: let(F.transform(chunks(a), scan), join))
