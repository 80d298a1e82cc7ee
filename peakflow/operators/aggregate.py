"""Aggregations of extracted matches: sums, vectors, chromatograms and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import NAN, rt_ms, running_stats, upper_median
from .runs import join_on, keys, with_runs

#: Intensities above which a transition counts as a peak, adds its logarithm, and is ranked.
PEAK_ABOVE, LOG_ABOVE, RANKED_FROM = 100, 10, 10
#: Rows of input for each task of groups: some 100 bytes each in memory, a few times over.
TASK_ROWS = 500_000


def field(array: str, name: str) -> Column:
    """One field of an array of structs, as an array of that name."""
    return F.transform(array, lambda x: x[name]).alias(name)


def intensity_sum(hits: DataFrame) -> DataFrame:
    """(eg_id, intensity) of the groups that have matches, both MS levels together."""
    return hits.groupBy(*keys(hits, "eg_id")).agg(F.sum("intensity").alias("intensity"))


def zero_filled(sums: DataFrame, groups: DataFrame, key: str = "eg_id") -> DataFrame:
    """Every group's intensity, 0 without matches; ``groups`` has the key. In every run that has any, if ``sums`` have runs."""
    return join_on(with_runs(groups.select(*keys(groups, key)).distinct(), sums), sums, [key], "left").select(*keys(sums, key), F.coalesce("intensity", F.lit(0).cast("bigint")).alias("intensity"))


def peak_vectors(hits: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Parallel arrays of each group's matches, in order of (rt, scan, tof); empty without matches."""
    row = F.struct("rt", "scan_index", "tof_index", "intensity")
    own = keys(hits, "eg_id")
    out = hits.groupBy(*own).agg(F.sort_array(F.collect_list(row)).alias("p"))
    if groups is not None:
        out = join_on(with_runs(groups.select(*keys(groups, "eg_id")).distinct(), out), out, ["eg_id"], "left").withColumn("p", F.coalesce("p", F.array().cast(out.schema["p"].dataType)))
    field = lambda k: F.transform("p", lambda x: x[k])
    return out.select(*own, field("scan_index").alias("scans"), field("tof_index").alias("tofs"), field("intensity").alias("intensities"), field("rt").alias("retention_times"))


def _mean_sd(x: str, w: str = "intensity"):
    total = F.sum(F.col(w).cast("double"))
    mean = F.try_divide(F.sum(F.col(x) * F.col(w).cast("double")), total)
    square = F.try_divide(F.sum(F.col(x).cast("double") * F.col(x) * F.col(w).cast("double")), total)
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def chromatograms(hits: DataFrame, mode: str = "exact", by: tuple[str, ...] = ("eg_id", "ms_level", "transition_key"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Per transition and millisecond: intensity, weighted mean and deviation of scan and tof, and in ``carry`` what matches have from their target.

    ``exact`` sums are mergeable before the shuffle. ``compat`` folds each
    group's peaks in the order (quad, tof, scan) with the order-dependent rule.
    """
    keyed = hits.withColumn("rt_ms", rt_ms(F.col("rt")))
    own = keys(hits, *by, "rt_ms")
    more = [F.max(c).alias(c) for c in carry]
    if mode == "exact":
        sm, ss = _mean_sd("scan_index")
        tm, ts = _mean_sd("tof_index")
        return keyed.groupBy(*own).agg(F.sum("intensity").alias("intensity"), sm.alias("scan_mean"), ss.alias("scan_sd"), tm.alias("tof_mean"), ts.alias("tof_sd"), *more)
    held = keyed.groupBy(*own).agg(F.sum("intensity").alias("intensity"), F.sort_array(F.collect_list(F.struct("quad_major", "tof_index", "scan_index", "intensity"))).alias("p"), *more)
    fold = lambda c: running_stats(F.transform("p", lambda x: F.struct(x[c].cast("double").alias("v"), x["intensity"].cast("double").alias("w"))))
    held = held.withColumns({"s": fold("scan_index"), "t": fold("tof_index")})
    return held.select(*own, "intensity", F.col("s.mean").alias("scan_mean"), F.col("s.sd").alias("scan_sd"), F.col("t.mean").alias("tof_mean"), F.col("t.sd").alias("tof_sd"), *carry)


def rt_summary(cmg: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per group, MS level and millisecond: intensity, peaks, summed ln intensity, weighted scan mean, cosine.

    The cosine is of observed and expected intensities over the transitions
    that have any peak in the group; ``expected`` has (eg_id, ms_level,
    transition_key, expected_intensity), or ``cmg`` has expected_intensity.
    """
    own = keys(cmg, "eg_id", "ms_level", "rt_ms")
    i = F.col("intensity").cast("double")
    aggs = [
        F.sum("intensity").alias("summed_intensity"),
        F.sum(F.when(F.col("intensity") > PEAK_ABOVE, 1).otherwise(0)).cast("int").alias("npeaks"),
        F.sum(F.when(F.col("intensity") > LOG_ABOVE, F.ln(i)).otherwise(0.0)).alias("log_intensity"),
        F.try_divide(F.sum(F.col("scan_mean") * i), F.sum(i)).alias("scan_mean"),
    ]
    if expected is None and "expected_intensity" not in cmg.columns:
        return cmg.groupBy(*own).agg(*aggs)
    e = F.coalesce(F.col("expected_intensity").cast("double"), F.lit(0.0))
    if expected is not None:
        # A merge join: expected values are as many as targets, and the size of a compressed file says little of what a broadcast would hold.
        cmg = join_on(cmg.drop("expected_intensity"), expected.hint("merge"), ["eg_id", "ms_level", "transition_key"], "left")
    # One shuffle by group: each transition's first row has its part of the expected length.
    group = Window.partitionBy(*own[:-1])
    first = F.row_number().over(group.orderBy("transition_key", "rt_ms")) == 1
    first = first | (F.lag("transition_key").over(group.orderBy("transition_key", "rt_ms")) != F.col("transition_key"))
    full = cmg.withColumn("own", F.when(first, e * e)).withColumn("ee", F.sum("own").over(group))
    out = full.groupBy(*own).agg(*aggs, F.sum(i * e).alias("oe"), F.sum(i * i).alias("oo"), F.first("ee").alias("ee"))
    norm = F.sqrt(F.col("oo")) * F.sqrt(F.col("ee"))
    cosine = F.when(norm == 0, F.lit(NAN)).otherwise(F.col("oe") / F.when(norm != 0, norm))
    return out.select(*own, "summed_intensity", "npeaks", "log_intensity", "scan_mean", cosine.alias("cosine"))


def group_summary(hits: DataFrame, rows: int) -> DataFrame:
    """``rt_summary`` of ``hits`` with the expected values of their own targets; they were made of about ``rows`` rows of peaks and targets.

    Matches are dealt out by group once, to as many tasks as ``rows`` need, so
    what a task holds does not grow with the run. All sums and windows by group
    that follow stay in these tasks, and no expected value is joined.
    """
    tasks = max(hits.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return rt_summary(chromatograms(hits.repartition(tasks, "eg_id"), carry=("expected_intensity",)))


def densified(cmg: DataFrame) -> DataFrame:
    """Every transition with peaks at every millisecond of its group: NaN means and 0 intensity where missing.

    One group's chromatogram is one row on the way: transitions times cycles at most.
    """
    group = keys(cmg, "eg_id", "ms_level")
    row = "struct<rt_ms:bigint,intensity:bigint,scan_mean:double,tof_mean:double>"
    values = ("rt_ms", "intensity", "scan_mean", "tof_mean")
    held = cmg.groupBy(*group).agg(F.collect_list(F.struct("transition_key", *values)).alias("p"))
    held = held.withColumns({"t": F.array_distinct(field("p", "transition_key")), "all": F.array_distinct(field("p", "rt_ms"))})
    each = held.select(*group, "all", "p", F.explode("t").alias("transition_key"))
    own = F.transform(F.filter("p", lambda x: x["transition_key"] == F.col("transition_key")), lambda x: F.struct(*[x[v].alias(v) for v in values]).cast(row))
    each = each.select(*group, "transition_key", "all", own.alias("own"))
    gap = lambda t: F.struct(t.alias("rt_ms"), F.lit(0).cast("bigint").alias("intensity"), F.lit(NAN).alias("scan_mean"), F.lit(NAN).alias("tof_mean")).cast(row)
    full = F.concat(F.col("own"), F.transform(F.array_except("all", field("own", "rt_ms")), gap))
    out = each.select(*group, "transition_key", F.explode(full).alias("x"))
    return out.select(*group, "transition_key", *[F.coalesce(F.col(f"x.{v}"), F.lit(NAN)).alias(v) if v.endswith("mean") else F.col(f"x.{v}") for v in values])


def chromatogram_arrays(cmg: DataFrame) -> DataFrame:
    """Per transition: arrays over time, ordered."""
    p = F.sort_array(F.collect_list(F.struct("rt_ms", "intensity", "scan_mean", "scan_sd", "tof_mean", "tof_sd")))
    own = keys(cmg, "eg_id", "ms_level", "transition_key")
    out = cmg.groupBy(*own).agg(p.alias("p"))
    return out.select(*own, *[field("p", k) for k in ("rt_ms", "intensity", "scan_mean", "scan_sd", "tof_mean", "tof_sd")])


def cycle_time(frames: DataFrame, by: str = "quad_major") -> DataFrame:
    """Mean step in time of each quad's frames: the sum of steps over the number of frames."""
    step = F.col("rt") - F.lag("rt").over(Window.partitionBy(*keys(frames, by)).orderBy("rt"))
    return frames.withColumn("step", step).groupBy(*keys(frames, by)).agg((F.coalesce(F.sum("step"), F.lit(0.0)) / F.count(F.lit(1))).alias("cycle_time"), F.count(F.lit(1)).alias("n_frames"))


def top_per_group(df: DataFrame, by: str | list[str], value: str, tie: str, n: int = 1) -> DataFrame:
    """The n rows of each group with the largest value; of equal ones the least ``tie``."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc(value), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def width_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Upper-middle element of each group."""
    return df.groupBy(by).agg(upper_median(F.col(value)).alias("median"), F.count(F.lit(1)).alias("n"))


def sample_per_group(df: DataFrame, by: str, most: int = 100, seed: int = 1) -> DataFrame:
    """At most so many random rows of each group: a sampling operator."""
    w = Window.partitionBy(by).orderBy("_draw")
    return df.withColumn("_draw", F.rand(seed)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_draw", "_n")
