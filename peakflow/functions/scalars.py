"""Scalar and array expressions. All stay in the JVM; none is a Python function at run time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def sat_uint(c: Column) -> Column:
    """Float to unsigned whole number: truncates toward zero; negative and NaN give 0; too large saturates."""
    return F.when(F.isnan(c) | (c < 0), F.lit(0)).when(c >= 9.2e18, F.lit(2**63 - 1)).otherwise(c.cast("bigint"))


def rt_ms(rt: Column) -> Column:
    """Seconds to whole milliseconds, truncated; the product is in single precision."""
    return (rt.cast("float") * F.lit(1000.0).cast("float")).cast("bigint")


def json_number(c: Column) -> Column:
    """NaN and infinities as null, as JSON writers need it."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def lnfact(n: Column) -> Column:
    """The score's ln-factorial of whole numbers: 1.0 at 0, n ln n - n + ln(n)/2 + ln(2 pi n)/2 above."""
    x = n.cast("double")
    safe = F.when(x > 0, x).otherwise(F.lit(1.0))
    return F.when(x <= 0, F.lit(1.0)).otherwise(x * F.ln(safe) - x + F.ln(safe) / 2 + F.ln(2 * math.pi * safe) / 2)


def lnfact_float(x: Column) -> Column:
    """The same for floats, 0.0 below 1."""
    safe = F.when(x >= 1, x).otherwise(F.lit(1.0))
    return F.when(x < 1, F.lit(0.0)).otherwise(safe * F.ln(safe) - safe + F.ln(safe) / 2 + F.ln(2 * math.pi * safe) / 2)


def hyperscore(npeaks: Column, summed: Column) -> Column:
    """lnfact(peaks) + 2 ln(intensity + 1)."""
    return lnfact(npeaks) + 2 * F.ln(summed.cast("double") + 1)


def lazyerscore(log_sum: Column) -> Column:
    """lnfact_float of the summed ln intensities."""
    return lnfact_float(log_sum)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NaN if either has no length; raises on empty or unequal arrays."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(norm == 0, F.lit(NAN)).otherwise(_dot(a, b) / F.when(norm != 0, norm))
    bad = (F.size(a) != F.size(b)) | (F.size(a) == 0)
    return F.when(bad, F.raise_error(F.lit("cosine needs two arrays of one length above zero")).cast("double")).otherwise(value)


def geometric_mean(values: Column) -> Column:
    """Aggregate: exp of the mean logarithm."""
    return F.exp(F.avg(F.ln(values)))


def upper_median(values: Column) -> Column:
    """Aggregate: the upper-middle element of the sorted values."""
    all_ = F.sort_array(F.collect_list(values))
    return F.get(all_, F.floor(F.size(all_) / 2).cast("int"))


# --- arrays


def _held(array: Column, made) -> Column:
    """``made`` of an array that is worked out once, not once for each element that ``made`` looks up."""
    return F.get(F.transform(F.array(array), made), F.lit(0))


def csr_explode(offsets: Column) -> Column:
    """Offsets to ids: id i once for each step from offsets[i] to offsets[i+1]."""

    def made(o):
        ids = F.transform(F.sequence(F.lit(0), F.size(o) - 2), lambda i: F.array_repeat(i.cast("bigint"), (F.get(o, i + 1) - F.get(o, i)).cast("int")))
        return F.when(F.size(o) < 2, F.array().cast("array<bigint>")).otherwise(F.flatten(ids))

    return _held(offsets, made)


def csr_compress(ids: Column) -> Column:
    """Sorted ids to offsets: 0, then for each v up to the largest the ids at most v; raises if unsorted.

    Where one id gives way to the next, the place is an offset: once for each value between them.
    """

    def made(a):
        n = F.size(a)
        steps = lambda x, i: F.when(i == n - 1, F.lit(1)).otherwise(F.get(a, i + 1) - x).cast("int")
        ends = F.flatten(F.transform(a, lambda x, i: F.array_repeat((i + 1).cast("bigint"), steps(x, i))))
        lead = F.array_repeat(F.lit(0).cast("bigint"), (F.get(a, F.lit(0)) + 1).cast("int"))
        ordered = ~F.exists(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.coalesce(F.get(a, i) > F.get(a, i + 1), F.lit(False)))
        out = F.when(ordered, F.concat(lead, ends)).otherwise(F.raise_error(F.lit("ids are not sorted")).cast("array<bigint>"))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(out)

    return _held(ids, made)


def sort_by_first(*arrays: Column) -> Column:
    """Parallel arrays, zipped and sorted by the first."""
    return F.array_sort(F.arrays_zip(*arrays))


def top_n(values: Column, n: int) -> Column:
    """(value, index) of the n largest; of equal values the earlier comes first."""
    keyed = F.transform(values, lambda v, i: F.struct((-v).alias("k"), i.alias("index"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: F.struct(s["value"].alias("value"), s["index"].alias("index")))


def rolling_median(values: Column, window: Column | int, pad: float = NAN) -> Column:
    """Centred rolling median over an array (upper-middle element); ``pad`` where the window is cut off."""
    w = F.lit(window).cast("int") if isinstance(window, int) else window.cast("int")
    right = F.floor(w / 2).cast("int")
    left = w - 1 - right
    n = F.size(values)
    return F.transform(
        values,
        lambda v, i: F.when((i >= left) & (i + right < n), F.get(F.array_sort(F.slice(values, i - left + 1, w)), right)).otherwise(F.lit(pad)),
    )


def vs_baseline(values: Column, window: Column | int) -> Column:
    """Value less its rolling median; NaN at the edges."""
    return F.zip_with(values, rolling_median(values, window), lambda v, m: v - m)


def baseline_window(n: Column) -> Column:
    """The scores' window: 1 + n/20 in whole numbers."""
    return 1 + F.floor(n / 20).cast("int")


def nan_to_zero(values: Column) -> Column:
    """Array with NaN as 0."""
    return F.transform(values, lambda v: F.nanvl(v, F.lit(0.0)))


_STATE = "struct<w:double,m:double,d:double,lo:double,hi:double>"


def _fold(pairs: Column, start: Column) -> Column:
    """The order-dependent weighted mean and deviation: see :func:`running_stats`."""

    def add(s, p):
        v, w = p["v"].cast("double"), p["w"].cast("double")
        lo, hi = F.least(s["lo"], v), F.greatest(s["hi"], v)
        m = s["m"] + (v - s["m"]) * (w / s["w"])
        d = s["d"] + w * (v - m) * (v - s["m"])
        return F.struct((s["w"] + w).alias("w"), F.greatest(F.least(m, hi), lo).alias("m"), d.alias("d"), lo.alias("lo"), hi.alias("hi")).cast(_STATE)

    return F.aggregate(pairs, start, add)


def _start(v: Column, w: Column) -> Column:
    v = v.cast("double")
    return F.struct(w.cast("double").alias("w"), v.alias("m"), F.lit(1.0).alias("d"), v.alias("lo"), v.alias("hi")).cast(_STATE)


def running_stats(pairs: Column) -> Column:
    """(mean, sd, weight) of an array of (v, w), folded in its order.

    Each value moves the mean by its weight over the weight before it; the mean
    is held within the values seen and the deviation starts at 1.
    """
    first = F.get(pairs, 0)
    rest = F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0)))
    s = _fold(rest, _start(first["v"], first["w"]))
    return F.transform(F.array(s), lambda x: F.struct(x["m"].alias("mean"), F.sqrt(F.abs(x["d"]) / x["w"]).alias("sd"), x["w"].alias("weight")))[0]


def seeded_sd(values: Column) -> Column:
    """The scores' deviation: the fold over values of weight 1, begun at value 0 of weight 1."""
    pairs = F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(1).alias("w")))
    return F.transform(F.array(_fold(pairs, _start(F.lit(0.0), F.lit(1)))), lambda x: F.sqrt(F.abs(x["d"]) / x["w"]))[0]


def rolling_cosine(a: Column, b: Column, window: int, mode: str = "exact") -> Column:
    """Rolling cosine of two arrays, NaN at the edges, 0.0 where a side has no length.

    ``exact`` takes the window's own elements. ``compat`` reproduces running sums
    that gain the centre and lose the element ``window // 2`` places behind it.
    """
    off = window // 2
    n = F.size(a)

    def total(x, y, i):
        part = lambda lo, count: _dot(F.slice(x, lo + 1, count), F.slice(y, lo + 1, count))
        if mode == "exact":
            return part(i - off, F.lit(window))
        moved = i - off
        return part(F.lit(0), F.lit(window)) - part(F.lit(1), moved) + part(F.lit(off + 1), moved)

    def at(i):
        norm = F.sqrt(F.greatest(total(a, a, i), F.lit(0.0))) * F.sqrt(F.greatest(total(b, b, i), F.lit(0.0)))
        return F.when(norm == 0, F.lit(0.0)).otherwise(total(a, b, i) / F.when(norm != 0, norm))

    inside = lambda i: (i >= off) & (i + off < n)
    out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(inside(i), at(i)).otherwise(F.lit(NAN)))
    bad = (F.size(a) != F.size(b)) | (n < window)
    return F.when(bad, F.raise_error(F.lit("rolling cosine needs arrays of one length, at least the window")).cast("array<double>")).otherwise(out)


def first_argmax(scores: Column) -> Column:
    """Index of the first score above all before it and above 0; 0 if none is."""
    best = F.aggregate(
        F.transform(scores, lambda v, i: F.struct(v.cast("double").alias("v"), i.cast("int").alias("i"))),
        F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("i")).cast("struct<v:double,i:int>"),
        lambda s, x: F.when(x["v"] > s["v"], x).otherwise(s).cast("struct<v:double,i:int>"),
    )
    return F.transform(F.array(best), lambda s: s["i"])[0]


def last_argmax(scores: Column) -> Column:
    """Index of the largest score, the last of equal ones; raises on empty arrays and on NaN or infinities."""
    bad = (F.size(scores) == 0) | F.exists(scores, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    keyed = F.transform(scores, lambda v, i: F.struct(v.alias("v"), i.cast("int").alias("i")))
    return F.when(bad, F.raise_error(F.lit("no finite scores")).cast("int")).otherwise(F.array_max(keyed)["i"])


def index_before(times: Column, at: Column) -> Column:
    """Index of the last time strictly before ``at``, at least 0."""
    return F.greatest(F.size(F.filter(times, lambda t: t < at)) - 1, F.lit(0))


def isotope_ladder(mz: Column, charge: Column, n: int = 4, spacing: float = 1.00335) -> Column:
    """m/z of the first n isotopes at a charge."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: mz + i * F.lit(spacing) / charge)


def mz_of(mass: Column, charge: Column, proton: float = 1.00727646688) -> Column:
    """m/z of a neutral mass at a charge."""
    return (mass + charge * F.lit(proton)) / charge
