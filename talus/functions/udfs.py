"""The few functions that Catalyst can't express, as Arrow-batched functions on JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def _parsed(text: str | None):
    return None if text is None else json.loads(text)


def contains(x, y) -> bool:
    """Objects by keys, arrays as sets, scalars by type and value; an array holds a scalar."""
    if isinstance(x, dict) and isinstance(y, dict):
        return all(k in x and contains(x[k], v) for k, v in y.items())
    if isinstance(x, list):
        return all(any(contains(a, b) for a in x) for b in y) if isinstance(y, list) else any(type(a) is not list and a == y and isinstance(a, bool) == isinstance(y, bool) for a in x)
    return isinstance(x, bool) == isinstance(y, bool) and type(x) in (int, float, str, bool, type(None)) and x == y


def deleted(x, key: str):
    if isinstance(x, dict):
        return {k: v for k, v in x.items() if k != key}
    if isinstance(x, list):
        if re.fullmatch(r"-?\d+", key):
            i = int(key)
            return [v for k, v in enumerate(x) if k != (i if i >= 0 else len(x) + i)]
        return [v for v in x if v != key]
    return x


def deleted_path(x, path: list[str]):
    if not path:
        return x
    if len(path) == 1:
        return deleted(x, path[0]) if isinstance(x, dict) or re.fullmatch(r"-?\d+", path[0]) else x
    if isinstance(x, dict) and path[0] in x:
        return x | {path[0]: deleted_path(x[path[0]], path[1:])}
    if isinstance(x, list) and re.fullmatch(r"-?\d+", path[0]) and -len(x) <= int(path[0]) < len(x):
        i = int(path[0]) % len(x)
        return [deleted_path(v, path[1:]) if k == i else v for k, v in enumerate(x)]
    return x


def _text(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def register(spark: SparkSession) -> None:
    """Once for each session."""
    if spark.catalog.functionExists("talus_json_delete_path"):
        return

    @pandas_udf("boolean")
    def talus_json_contains(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else contains(json.loads(a), json.loads(b)) for a, b in zip(x, y, strict=True)], dtype=object)

    @pandas_udf("string")
    def talus_json_delete(x: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _text(deleted(json.loads(a), b)) for a, b in zip(x, key, strict=True)], dtype=object)

    @pandas_udf("string")
    def talus_json_delete_path(x: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _text(deleted_path(json.loads(a), [*b])) for a, b in zip(x, path, strict=True)], dtype=object)

    for f in (talus_json_contains, talus_json_delete, talus_json_delete_path):
        spark.udf.register(f.__name__, f)
