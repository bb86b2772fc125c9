"""Aggregates that Spark's grammar lacks, as columns for agg()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def hypothetical_rank(x: Column, v) -> Column:
    return F.count_if(x < v) + 1


def hypothetical_dense_rank(x: Column, v) -> Column:
    return F.count_distinct(F.when(x < v, x)) + 1


def hypothetical_percent_rank(x: Column, v) -> Column:
    return F.coalesce(F.try_divide(F.count_if(x < v), F.count(x)), F.lit(0.0))


def hypothetical_cume_dist(x: Column, v) -> Column:
    return (F.count_if(x <= v) + 1) / (F.count(x) + 1)


def fold(x: Column, start: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column] | None = None) -> Column:
    """A user-defined aggregate: step over a group's values in ascending order. It gathers the group's values, so it is for groups of bounded size."""
    return F.aggregate(F.array_sort(F.collect_list(x)), start, step, final) if final else F.aggregate(F.array_sort(F.collect_list(x)), start, step)
