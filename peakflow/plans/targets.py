"""Elution groups to targets: one row for each transition, with ranges in index space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import sat_uint
from .tolerance import Calibration, Tolerance, included

#: Columns that every extraction needs.
COLUMNS = ("eg_id", "ms_level", "transition_key", "tof_lo", "tof_hi", "scan_lo", "scan_hi", "frame_lo", "frame_hi", "rt_lo", "rt_hi", "iso_lo", "iso_hi")


def precursor_limits(groups: DataFrame) -> DataFrame:
    """(id, low, high): least and greatest precursor m/z."""
    return groups.select("id", F.array_min("precursor_mzs").alias("low"), F.array_max("precursor_mzs").alias("high"))


def transitions(groups: DataFrame) -> DataFrame:
    """(ms_level, transition_key, mz, expected_intensity) of each group, MS1 keyed by position.

    All other columns of the group are kept; MS1 and MS2 come from one pass.
    """
    lone = lambda x: F.struct(F.lit(1).alias("ms_level"), x["i"].cast("string").alias("transition_key"), x["mz"].alias("mz"), x["e"].cast("double").alias("expected_intensity"))
    first = F.transform(F.transform(F.col("precursor_mzs"), lambda mz, i: F.struct(i.alias("i"), mz.alias("mz"), F.get(F.coalesce(F.col("expected_precursor_intensity"), F.array().cast("array<float>")), i).alias("e"))), lone)
    second = F.transform(
        F.map_entries("fragment_mzs"),
        lambda x: F.struct(
            F.lit(2).alias("ms_level"), x["key"].alias("transition_key"), x["value"].alias("mz"), F.coalesce(F.try_element_at(F.col("expected_fragment_intensity"), x["key"]).cast("double"), F.lit(0.0)).alias("expected_intensity")
        ),
    )
    kind = "array<struct<ms_level:int,transition_key:string,mz:double,expected_intensity:double>>"
    return groups.select("*", F.explode(F.concat(first.cast(kind), second.cast(kind))).alias("t")).select(*groups.columns, "t.*")


def resolve(groups: DataFrame, tol: Tolerance, cal: Calibration, rounded: bool = False) -> DataFrame:
    """Targets of ``groups``: physical ranges inverted to indices.

    Indices are truncated (``rounded``: rounded); unbounded ranges fall back to
    the run's bounds; scan ends are put in order, as scans fall with mobility.
    """
    whole = (lambda c: sat_uint(F.round(c))) if rounded else sat_uint
    rt_lo, rt_hi = tol.rt_range(F.col("rt_seconds"))
    im_lo, im_hi = tol.mobility_range(F.col("mobility"))
    iso_lo, iso_hi = tol.quad_range(F.array_min("precursor_mzs"), F.array_max("precursor_mzs"))
    bound = lambda c, v: F.coalesce(c, F.lit(v).cast("float"))
    rt_lo, rt_hi = included(bound(rt_lo, cal.lower_rt), bound(rt_hi, cal.upper_rt))
    scan = included(*(whole(cal.scan_of(x)) for x in (bound(im_lo, cal.lower_im), bound(im_hi, cal.upper_im))))
    iso = included(iso_lo, iso_hi)
    mz = tol.mz_range(F.col("mz"))
    tof = included(*(whole(cal.tof_of(x)) for x in mz))
    return transitions(groups).select(
        F.col("id").alias("eg_id"), "ms_level", "transition_key",
        tof[0].alias("tof_lo"), tof[1].alias("tof_hi"), scan[0].alias("scan_lo"), scan[1].alias("scan_hi"),
        whole(cal.frame_of(rt_lo)).alias("frame_lo"), whole(cal.frame_of(rt_hi)).alias("frame_hi"), rt_lo.alias("rt_lo"), rt_hi.alias("rt_hi"),
        iso[0].alias("iso_lo"), iso[1].alias("iso_hi"),
        whole(cal.tof_of(F.col("mz"))).alias("expected_tof"), whole(cal.scan_of(F.col("mobility"))).alias("expected_scan"), "expected_intensity",
    )


def template_groups(spark: SparkSession, n: int) -> DataFrame:
    """n-1 groups on straight ramps: times 66 to 660 s, mobilities 0.6 to 0.8, m/z 400 to 900, ten fragments each."""
    at = F.col("id") / F.lit(float(n))
    ramp = lambda a, b: F.lit(a) + at * (b - a)
    steps = F.sequence(F.lit(0), F.lit(9))
    mz = ramp(400.0, 900.0)
    return spark.range(1, n).select(
        "id", ramp(0.6, 0.8).cast("float").alias("mobility"), ramp(66.0, 660.0).cast("float").alias("rt_seconds"), F.array(mz).alias("precursor_mzs"),
        F.map_from_arrays(F.transform(steps, lambda i: i.cast("string")), F.transform(steps, lambda i: mz + i)).alias("fragment_mzs"),
        F.map_from_arrays(F.transform(steps, lambda i: i.cast("string")), F.array_repeat(F.lit(1.0).cast("float"), 10)).alias("expected_fragment_intensity"),
        F.array(F.lit(1.0).cast("float")).alias("expected_precursor_intensity"),
    )


def random_groups(spark: SparkSession, n: int = 1000, seed: int = 43, max_rt: float = 1320.0) -> DataFrame:
    """n-1 groups with one precursor and ten fragments, drawn evenly over time, mobility 0.5 to 1.5 and m/z 300 to 1000."""
    steps = range(10)
    return spark.range(1, n).select(
        "id", (0.5 + F.rand(seed)).cast("float").alias("mobility"), (F.rand(seed + 1) * max_rt).cast("float").alias("rt_seconds"), F.array(300 + 700 * F.rand(seed + 2)).alias("precursor_mzs"),
        F.create_map(*[x for i in steps for x in (F.lit(str(i)), 300 + 700 * F.rand(seed + 3 + i))]).alias("fragment_mzs"),
        F.lit(None).cast("map<string,float>").alias("expected_fragment_intensity"), F.lit(None).cast("array<float>").alias("expected_precursor_intensity"),
    )
