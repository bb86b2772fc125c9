"""Recursive queries whose levels are made distinct: Spark has UNION ALL alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import written

#: Levels before an error is raised.
LIMIT = 1000
#: Levels that are read one by one until they are written together.
COMPACT = 16


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = LIMIT) -> DataFrame:
    """start and all that step makes of new rows, each row once. step gets the rows that the last level added."""
    seen = new = written(start.distinct(), "recursion")
    for level in range(1, limit + 1):
        new = step(new).toDF(*start.columns)
        new = written(new.select(*[new[c].cast(start.schema[c].dataType) for c in start.columns]).distinct().subtract(seen), "recursion")
        if new.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(new)
        if level % COMPACT == 0:  # so that a plan never reads more levels than that
            seen = written(seen, "recursion")
    raise RuntimeError(f"the recursion did not end within {limit} levels")
