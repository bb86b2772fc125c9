"""Window operators that Spark's grammar lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, value: Column, name: str, partition: list[str], order: list[str], start: int, end: int) -> DataFrame:
    """value over GROUPS BETWEEN start AND end: peer groups are numbered by dense_rank, the frame is a range of those numbers."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("__group", F.dense_rank().over(w)).withColumn(name, value.over(Window.partitionBy(*partition).orderBy("__group").rangeBetween(start, end))).drop("__group")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in that order (a lateral subquery with a limit); Spark stops each key early by WindowGroupLimit."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
