"""Structured Streaming over event tables: windows, sessions and duplicates with watermarks. Beyond the batch operators; each also runs to completion on a bounded source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of each window, tumbling without a slide."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    timed = events.withColumn(time, F.col(time).cast("timestamp_ltz")).withWatermark(time, late)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp_ltz")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def without_duplicates(events: DataFrame, keys: list[str], late: str = "1 hour", time: str = "ts") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp_ltz")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream run over what its source has now, its rows as a table in the shared folder; append and complete modes."""
    import uuid

    folder = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        out.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    else:
        out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
