"""Nearest-time alignment: values at their own times, combined at reference times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Reducer = Callable[[Column], Column]


def largest(v: Column) -> Column:
    """Largest value, NaN left out; minus infinity without any."""
    return F.coalesce(F.max(F.nanvl(v, F.lit(None).cast("double"))), F.lit(float("-inf")))


def total(v: Column) -> Column:
    """Sum of values; 0 without any."""
    return F.coalesce(F.sum(v), F.lit(0.0))


def product(v: Column) -> Column:
    """Product of values; 1 without any."""
    return F.coalesce(F.product(v), F.lit(1.0))


def nearest(refs: DataFrame, values: DataFrame, by: list[str], time: str = "x") -> DataFrame:
    """``values`` with ``ref``: the reference time nearest to each, ties to the right.

    Before the first and after the last reference the end one is taken. One
    sort over the union of both sides by group: no pairs are made.
    """
    side = values.select(*by, F.col(time).alias("_t"), F.lit(None).cast("double").alias("_r"), F.struct("*").alias("_row"))
    kind = side.schema["_row"].dataType
    both = side.unionByName(refs.select(*by, F.col(time).alias("_t"), F.col(time).cast("double").alias("_r"), F.lit(None).cast(kind).alias("_row")))
    w = Window.partitionBy(*by).orderBy("_t", F.col("_r").isNull())
    low = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first("_r", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = both.withColumns({"_lo": low, "_hi": high}).filter("_row is not null")
    x, lo, hi = F.col("_t").cast("double"), F.col("_lo"), F.col("_hi")
    pick = F.when(lo.isNull(), hi).when(hi.isNull() | (x - lo < hi - x), lo).otherwise(hi)
    return both.select(pick.alias("ref"), "_row.*")


def align(refs: DataFrame, values: DataFrame, by: list[str], reduce: Reducer = largest, time: str = "x", value: str = "v") -> DataFrame:
    """(by, time, value) at every reference time: values combined at their nearest reference.

    References without values keep the reducer's start: it must give that for nulls alone.
    """
    at = nearest(refs.select(*by, time), values.select(*by, time, value), by, time).select(*by, F.col("ref").alias("_ref"), F.col(value).cast("double").alias("_v"))
    on = [refs[c].eqNullSafe(at[c]) for c in by] + [refs[time].cast("double") == at["_ref"]]
    joined = refs.select(*by, time).join(at, on, "left").select(*[refs[c] for c in by], refs[time], "_v")
    return joined.groupBy(*by, time).agg(reduce(F.col("_v")).alias(value))


def align_arrays(refs: Column, times: Column, values: Column, kind: str = "max") -> Column:
    """The same within one row: arrays of reference times, times and values to an array along the references.

    ``kind`` is ``max`` (minus infinity in gaps) or ``sum`` (0 in gaps).
    """
    n = F.size(refs)

    def place(x):
        below = F.size(F.filter(refs, lambda r: r <= x))
        lo, hi = F.get(refs, below - 1), F.get(refs, below)
        return F.when(below == 0, 0).when(below == n, n - 1).when(x - lo < hi - x, below - 1).otherwise(below)

    placed = F.zip_with(times, values, lambda x, v: F.struct(place(x.cast("double")).alias("k"), v.cast("double").alias("v")))
    start = F.lit(float("-inf")) if kind == "max" else F.lit(0.0)
    step = (lambda s, x: F.when(F.isnan(x["v"]), s).otherwise(F.greatest(s, x["v"]))) if kind == "max" else (lambda s, x: s + x["v"])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.filter(placed, lambda p: p["k"] == k), start, step))
