"""COPY: text and CSV in and out, by Spark's readers and writers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CopyOptions:
    format: str = "text"
    delimiter: str | None = None
    null: str | None = None
    header: bool = False
    quote: str = '"'
    escape: str = '"'

    def __post_init__(self):
        if self.format not in ("text", "csv"):
            raise ValueError(f"COPY format {self.format} is not known")

    @property
    def sep(self) -> str:
        return self.delimiter or ("\t" if self.format == "text" else ",")

    @property
    def null_text(self) -> str:
        return self.null if self.null is not None else ("\\N" if self.format == "text" else "")

    def spark(self) -> dict[str, str]:
        own = {"sep": self.sep, "nullValue": self.null_text, "header": str(self.header).lower(), "emptyValue": "" if self.null_text else '""'}
        return own | ({"quote": self.quote, "escape": self.escape, "multiLine": "true"} if self.format == "csv" else {"quote": "\u0000"})


def read(spark: SparkSession, path: str, schema: T.StructType, options: CopyOptions) -> DataFrame:
    """Each field in its column; a text that isn't of the column's type is an error."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return _typed(spark.read.options(**options.spark()).schema(texts).csv(path), schema, options)


def read_lines(spark: SparkSession, lines: list[str], schema: T.StructType, options: CopyOptions) -> DataFrame:
    """The same of lines that a client sent; an end mark "\\\\." ends them."""
    if "\\." in lines:
        lines = lines[: lines.index("\\.")]
    lines = lines[1:] if options.header else lines
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    own = options.spark() | {"header": "false"}
    df = spark.createDataFrame([(x,) for x in lines], "line string").select(F.from_csv("line", texts.simpleString()[7:-1].replace(":", " "), own).alias("r")).select("r.*")
    return _typed(df, schema, options)


def _typed(df: DataFrame, schema: T.StructType, options: CopyOptions) -> DataFrame:
    if options.format == "text":
        marks = {"\\\\t": "\t", "\\\\n": "\n", "\\\\r": "\r", "\\\\\\\\": "\\\\"}
        for c in df.columns:
            x = F.col(f"`{c}`")
            for a, b in marks.items():
                x = F.regexp_replace(x, a, b)
            df = df.withColumn(c, x)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write(df: DataFrame, path: str, options: CopyOptions) -> None:
    df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema]).write.mode("overwrite").options(**options.spark()).csv(path)


def lines(df: DataFrame, options: CopyOptions) -> DataFrame:
    """A line of text for each row, for a client."""
    def cell(c: str):
        x = F.col(f"`{c}`").cast("string")
        if options.format == "text":
            for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                x = F.replace(x, F.lit(a), F.lit(b))
        else:
            odd = "[" + re.escape(options.sep + options.quote) + "\\r\\n]"
            x = F.when(x.rlike(odd) | (x == ""), F.concat(F.lit(options.quote), F.replace(x, F.lit(options.quote), F.lit(options.escape + options.quote)), F.lit(options.quote))).otherwise(x)
        return F.coalesce(x, F.lit(options.null_text))

    return df.select(F.concat_ws(options.sep, *map(cell, df.columns)).alias("line"))
