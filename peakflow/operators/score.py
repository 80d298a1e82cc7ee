"""Chromatogram scores, cross scores between MS levels, and the apex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..plans.tolerance import Calibration
from .aggregate import field
from .align import align_arrays
from .runs import join_on, keys

_FIELDS = ("rt_ms", "summed_intensity", "npeaks", "log_intensity", "scan_mean", "cosine")


def scored(summary: DataFrame) -> DataFrame:
    """Per group and MS level: arrays over time and the eight score arrays.

    ``summary`` is :func:`~peakflow.operators.aggregate.rt_summary` with cosine.
    A group's arrays are as long as its chromatogram.
    """
    p = F.sort_array(F.collect_list(F.struct(*_FIELDS)))
    own = keys(summary, "eg_id", "ms_level")
    out = summary.groupBy(*own).agg(p.alias("p")).select(*own, *[field("p", k) for k in _FIELDS])
    out = out.withColumns(
        {
            "lazy_hyperscore": F.zip_with("npeaks", "summed_intensity", s.hyperscore),
            "lazyerscore": F.transform("log_intensity", s.lazyerscore),
            "w": s.baseline_window(F.size("rt_ms")),
        }
    )
    out = out.withColumns({f"{k}_vs_baseline": s.nan_to_zero(s.vs_baseline(F.col(k), F.col("w"))) for k in ("lazy_hyperscore", "lazyerscore")})
    out = out.withColumns({"sd_h": s.seeded_sd(F.col("lazy_hyperscore_vs_baseline")), "sd_l": s.seeded_sd(F.col("lazyerscore_vs_baseline"))})
    over = lambda c, sd: F.transform(c, lambda v: v / F.col(sd))
    out = out.withColumns({"norm_hyperscore_vs_baseline": over("lazy_hyperscore_vs_baseline", "sd_h"), "norm_lazyerscore_vs_baseline": over("lazyerscore_vs_baseline", "sd_l")})
    return out.withColumn("apex", s.first_argmax(F.col("norm_lazyerscore_vs_baseline"))).drop("w", "sd_h", "sd_l")


def transition_maps(dense: DataFrame, cal: Calibration, times: bool = False) -> DataFrame:
    """Per group and MS level: maps from transition to arrays along the level's times, in physical units.

    ``dense`` is :func:`~peakflow.operators.aggregate.densified`; gaps stay NaN
    and 0. With ``times`` the level's times come too, as ``rt_ms``.
    """
    p = F.sort_array(F.collect_list(F.struct("rt_ms", "intensity", "scan_mean", "tof_mean")))
    each = dense.groupBy(*keys(dense, "eg_id", "ms_level", "transition_key")).agg(p.alias("p"))
    named = lambda values, name: F.map_from_entries(F.sort_array(F.collect_list(F.struct("transition_key", values.alias("v"))))).alias(name)
    return each.groupBy(*keys(dense, "eg_id", "ms_level")).agg(
        *([F.first(field("p", "rt_ms")).alias("rt_ms")] if times else []),
        named(F.transform("p", lambda x: x["intensity"]), "transition_intensities"),
        named(F.transform("p", lambda x: cal.mobility(x["scan_mean"])), "transition_mobilities"),
        named(F.transform("p", lambda x: cal.mz(x["tof_mean"])), "transition_mzs"),
    )


def expected_values(targets: DataFrame, cal: Calibration) -> DataFrame:
    """Per group and MS level: expected m/z by transition and expected mobility."""
    mz = F.map_from_entries(F.sort_array(F.collect_list(F.struct("transition_key", cal.mz(F.col("expected_tof").cast("double")).alias("v")))))
    return targets.groupBy(*keys(targets, "eg_id", "ms_level")).agg(mz.alias("expected_mzs"), F.first(cal.mobility(F.col("expected_scan").cast("double"))).alias("expected_mobility"))


def with_transitions(scores: DataFrame, dense: DataFrame, targets: DataFrame, cal: Calibration) -> DataFrame:
    """Scores with transition maps, expected values and the average mobility by time."""
    on = ["eg_id", "ms_level"]
    out = join_on(join_on(scores, transition_maps(dense, cal), on, "left"), expected_values(targets, cal), on, "left")
    return out.withColumn("average_mobility", F.transform("scan_mean", cal.mobility))


def errors_at(side: str, index: Column) -> Column:
    """Struct of a level's errors at one of its times: expected less observed m/z and mobility, and intensities, by transition."""
    at = lambda m: F.transform_values(F.col(f"{side}.{m}"), lambda _, v: F.get(v, index))
    mz = F.map_zip_with(F.map_filter(F.col(f"{side}.expected_mzs"), lambda k, _: F.map_contains_key(F.col(f"{side}.transition_mzs"), k)), at("transition_mzs"), lambda _, e, o: e - o)
    im = F.transform_values(at("transition_mobilities"), lambda _, o: F.col(f"{side}.expected_mobility") - o)
    return F.struct(mz.alias("mz_errors"), im.alias("mobility_errors"), at("transition_intensities").alias("transition_intensities"), F.get(F.col(f"{side}.average_mobility"), index).alias("average_mobility"))


def cross(own: str, other: str) -> Column:
    """Own cosine times the other's cosine and baseline-free lazyerscore, projected to own times; not finite gives 0."""
    ms = lambda side, c: F.col(f"{side}.{c}")
    cos = align_arrays(F.transform(ms(own, "rt_ms"), lambda x: x.cast("double")), ms(other, "rt_ms"), ms(other, "cosine"))
    lzb = align_arrays(F.transform(ms(own, "rt_ms"), lambda x: x.cast("double")), ms(other, "rt_ms"), ms(other, "lazyerscore_vs_baseline"))
    product = F.zip_with(ms(own, "cosine"), F.zip_with(cos, lzb, lambda a, b: a * b), lambda a, b: a * b)
    return F.transform(product, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v))


def cross_scores(scores: DataFrame) -> DataFrame:
    """Per group: structs ms1 and ms2 (null where a level has no matches), cross_ms1 and cross_ms2 ([] then)."""
    pack = lambda level, name: F.first(F.when(F.col("ms_level") == level, F.struct("*")), True).alias(name)
    own = keys(scores, "eg_id")
    both = scores.groupBy(*own).agg(pack(1, "ms1"), pack(2, "ms2"))
    ok = F.col("ms1").isNotNull() & F.col("ms2").isNotNull()
    none = F.array().cast("array<double>")
    return both.select(*own, "ms1", "ms2", F.when(ok, cross("ms1", "ms2")).otherwise(none).alias("cross_ms1"), F.when(ok, cross("ms2", "ms1")).otherwise(none).alias("cross_ms2"))


def at_time(side: str, time: Column) -> Column:
    """Struct of a level's scores at the last time strictly before ``time`` (its first without one)."""
    i = s.index_before(F.col(f"{side}.rt_ms"), time)
    names = ("rt_ms", "summed_intensity", "npeaks", "scan_mean", "cosine", "lazyerscore", "lazyerscore_vs_baseline", "norm_lazyerscore_vs_baseline")
    return F.struct(*[F.get(F.col(f"{side}.{c}"), i).alias(c) for c in names])


def apex_scores(crossed: DataFrame) -> DataFrame:
    """Per group with both levels: the last best cross score of MS2 and both levels' scores at its time."""
    has = crossed.filter(F.size("cross_ms2") > 0)
    best = has.withColumn("apex", s.last_argmax(F.col("cross_ms2")))
    best = best.withColumn("apex_rt_ms", F.get(F.col("ms2.rt_ms"), F.col("apex")))
    more = []
    if "transition_mzs" in crossed.schema["ms1"].dataType.fieldNames():
        more = ["ms1_errors", "ms2_errors"]
        best = best.withColumns({f"{side}_errors": errors_at(side, s.index_before(F.col(f"{side}.rt_ms"), F.col("apex_rt_ms"))) for side in ("ms1", "ms2")})
    levels = [at_time(side, F.col("apex_rt_ms")).alias(side) for side in ("ms1", "ms2")]
    return best.select(*keys(crossed, "eg_id"), "apex_rt_ms", F.get("cross_ms2", F.col("apex")).alias("cross_score"), *levels, *more)


def ranked_transitions(intensities: Column, errors: Column) -> Column:
    """(intensity, error) of transitions from 10 up, largest first."""
    pairs = F.zip_with(intensities, errors, lambda i, e: F.struct(i.alias("intensity"), e.alias("error")))
    return F.reverse(F.array_sort(F.filter(pairs, lambda p: p["intensity"] >= 10)))
