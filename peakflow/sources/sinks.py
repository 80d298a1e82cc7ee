"""Result writers."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import json_number
from ..plans.tolerance import Tolerance


def enveloped(results: DataFrame, groups: DataFrame) -> DataFrame:
    """(elution_group, result) joined by id; groups without results keep a null result."""
    g = groups.select(F.col("id").alias("_id"), F.struct("*").alias("elution_group"))
    r = results.select(F.col("eg_id").alias("_eg"), F.struct("*").alias("result"))
    return g.join(r, F.col("_id") == F.col("_eg"), "left").select("elution_group", "result")


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return json_number(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """All floats, however deep in structs, arrays and maps, with NaN and infinities as null."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as tasks."""
    json_safe(df).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """The binary form."""
    df.write.mode("overwrite").parquet(path)


def _plain(x):
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def write_report(df: DataFrame, path: str, pretty: bool = True) -> None:
    """One JSON array in one local file: for results meant to be read by people. Rows are streamed, not collected."""
    with open(path, "w") as f:
        f.write("[")
        for k, row in enumerate(df.toLocalIterator()):
            f.write(("," if k else "") + ("\n" if pretty else "") + json.dumps(_plain(row.asDict(True)), indent=2 if pretty else None))
        f.write("\n]\n" if pretty else "]")


def write_msgpack(df: DataFrame, path: str) -> None:
    """The same rows as MessagePack maps, where that library is installed."""
    import msgpack

    with open(path, "wb") as f:
        for row in df.toLocalIterator():
            f.write(msgpack.packb(_plain(row.asDict(True))))


def write_template(groups: DataFrame, folder: str, tol: Tolerance | None = None) -> None:
    """``elution_groups.json`` and ``tolerance_settings.json`` in a local folder."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    write_report(groups, str(out / "elution_groups.json"))
    (out / "tolerance_settings.json").write_text((tol or Tolerance.template()).to_json())
