"""What the operators of this package share: reading documents, Arrow maps, shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cleaned, shared, ship, table, written  # noqa: F401  those that the operators use

#: Of one Arrow batch.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
#: ASCII white space, as the word and line contracts of this package have it.
BLANKS = " \t\n\x0b\x0c\r"


def tidy(df: DataFrame) -> DataFrame:
    """Columns whose names differ in case alone get a suffix, the first keeps its name; else Spark can't resolve them."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        n = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        names.append(name if n == 1 else f"{name}__{n}")
    return df if names == df.columns else df.toDF(*names)


def documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text, a null text as the empty one; other columns are dropped."""
    df = tidy(df)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, so that a worker's memory doesn't follow the length of texts. Smaller settings stay."""
    ship(spark)
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = str(spark.conf.get(f"spark.sql.execution.arrow.{key}")).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


_caches: dict[str, Callable[[], None]] = {}


def caches(owner: str, clear: Callable[[], None]) -> None:
    """Says how to empty what a module keeps in a worker from task to task; that is done when the worker gets a task of another module."""
    _caches[owner] = clear


def begin(owner: str) -> None:
    for name, clear in _caches.items():
        if name != owner:
            clear()


def release() -> None:
    """Gives a worker's free memory back to the system at the end of a task: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have least_bytes; none has more than that and one batch more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str | T.StructType, least_bytes: int = 0) -> DataFrame:
    """mapInArrow for functions of one batch. make() runs once a task and returns the function; this returns columns by name. least_bytes: of a batch, by putting Arrow's together."""
    small_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    owner = make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        f = make()
        for batch in gathered(batches, least_bytes) if least_bytes else batches:
            if batch.num_rows:
                columns = f(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[n.name], pa.Array) else pa.array(x, n.type) for n in arrow], schema=arrow)
        del f
        release()

    return df.mapInArrow(run, kind)


def extend(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], new: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with new columns from map_arrow; they replace columns of the same name, in any case. drop: columns that the function reads and the result lacks."""
    added = T.StructType.fromDDL(new)
    gone = {f.name.lower() for f in added} | {x.lower() for x in drop}
    kept = [f for f in df.schema if f.name.lower() not in gone]

    def both() -> Callable[[pa.RecordBatch], dict[str, list]]:
        f = make()
        return lambda batch: {k.name: batch.column(batch.schema.get_field_index(k.name)) for k in kept} | f(batch)

    both.__module__ = make.__module__
    return map_arrow(df, both, T.StructType(kept + added.fields))


def digest(data: bytes) -> bytes:
    """128 bits: equal digests count as equal texts."""
    return hashlib.blake2b(data, digest_size=16).digest()


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
