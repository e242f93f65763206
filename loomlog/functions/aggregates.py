"""Aggregates of queries as column expressions over already distinct rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _least(n: int, x: Column) -> Column:
    return F.slice(F.array_sort(F.collect_list(x)), 1, n)


def _greatest(n: int, x: Column) -> Column:
    return F.reverse(F.slice(F.sort_array(F.collect_list(x), asc=False), 1, n))


def _distinct_count(x: Column) -> Column:
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))


def _draws(n: int, x: Column) -> Column:
    own = F.collect_list(x)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(own, (F.floor(F.rand() * F.size(own)) + 1).cast("int")))


PLAIN: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "median": F.median, "variance": F.var_pop, "stddev": F.stddev_pop,
    "distinct": lambda x: F.array_sort(F.collect_set(x)), "min": F.min, "max": F.max,
    "count": lambda x: F.count(F.lit(1)), "count-distinct": _distinct_count, "rand": lambda x: F.element_at(F.shuffle(F.collect_list(x)), 1),
}
WITH_NUMBER: dict[str, Callable[[Any, Column], Column]] = {
    "min": _least, "max": _greatest, "rand": _draws, "sample": lambda n, x: F.slice(F.shuffle(F.collect_list(x)), 1, n),
}
