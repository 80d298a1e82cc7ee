"""Frames to peaks: CSR expansion, isolation windows, edge trimming, layout checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedDataError
from ..functions.scalars import csr_compress, csr_explode
from .runs import keys, same_run

#: The part of a window's scans that is cut at each end, and the most that is.
TRIM_PART, TRIM_MOST = 10, 20
#: Windows (a few dozen bytes each) that may be broadcast.
WINDOW_ROWS = 100_000


def quad_windows(settings: DataFrame) -> DataFrame:
    """Isolation settings (parallel arrays per quad_major) to one row a window, low and high from middle and width."""
    zipped = F.arrays_zip("scan_starts", "scan_ends", "isolation_mz", "isolation_width", "collision_energy")
    own = keys(settings, "quad_major")
    each = settings.select(*own, F.posexplode(zipped).alias("quad_sub", "w"))
    return each.select(
        *own, "quad_sub", F.col("w.scan_starts").alias("scan_start"), F.col("w.scan_ends").alias("scan_end"), "w.isolation_mz", "w.isolation_width",
        (F.col("w.isolation_mz") - F.col("w.isolation_width") / 2).alias("isolation_low"), (F.col("w.isolation_mz") + F.col("w.isolation_width") / 2).alias("isolation_high"), "w.collision_energy",
    )


def trimmed(start: Column, end: Column) -> tuple[Column, Column]:
    """Half-open scan range of a window without its edges."""
    off = F.least(F.floor((end - start) / TRIM_PART), F.lit(TRIM_MOST)).cast("bigint")
    return start + off, end - off


def explode_frames(frames: DataFrame) -> DataFrame:
    """One row a peak; frame columns are kept, arrays are not."""
    kept = [c for c in frames.columns if c not in ("scan_offsets", "tof_indices", "intensities")]
    zipped = F.arrays_zip(csr_explode(F.col("scan_offsets")).alias("scan_index"), F.col("tof_indices").alias("tof_index"), F.col("intensities").alias("intensity"))
    return frames.select(*kept, F.explode(zipped).alias("p")).select(*kept, "p.scan_index", "p.tof_index", "p.intensity")


def few_windows(windows: DataFrame) -> bool:
    """Whether the windows are few enough to be told to all tasks; one run has dozens."""
    return windows.limit(WINDOW_ROWS + 1).count() <= WINDOW_ROWS


def expand(frames: DataFrame, windows: DataFrame, broadcast_windows: bool | None = None) -> DataFrame:
    """All peaks: MS1 with null quad, MS2 once for each window of its run whose trimmed scans hold the peak.

    Windows that overlap both get a shared peak, by design. One pass over
    ``frames``; windows are broadcast if they are counted as few, else joined
    on (run, quad) by a shuffle.
    """
    peaks = explode_frames(frames)
    lo, hi = trimmed(F.col("scan_start"), F.col("scan_end"))
    w = windows.select(*[F.col(c).alias(f"w_{c}") for c in same_run(frames, windows)], F.col("quad_major").alias("wq"), "quad_sub", lo.alias("w_lo"), hi.alias("w_hi"))
    w = F.broadcast(w) if (few_windows(windows) if broadcast_windows is None else broadcast_windows) else w
    on = (F.col("ms_level") == 2) & (F.col("quad_major") == F.col("wq")) & (F.col("scan_index") >= F.col("w_lo")) & (F.col("scan_index") < F.col("w_hi"))
    for c in same_run(frames, windows):
        on = on & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    joined = peaks.join(w, on, "left").filter((F.col("ms_level") == 1) | F.col("wq").isNotNull())
    quad = F.when(F.col("ms_level") == 2, F.col("quad_major"))
    return joined.select(*keys(frames, "ms_level"), quad.alias("quad_major"), "quad_sub", "frame_index", "rt", "scan_index", "tof_index", "intensity")


def require_ms2(frames: DataFrame) -> DataFrame:
    """``frames``, or an error if the run has no MS2 frames."""
    if frames.filter("ms_level = 2").isEmpty():
        raise UnsupportedDataError("the run has no MS2 windows")
    return frames


def collect_frames(peaks: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The inverse of expansion: peaks with (frame_index, scan_index, tof_index, intensity) to CSR frames.

    A frame is one acquisition instant (of each value of ``more``), so its arrays are bounded by the instrument.
    """
    own = keys(peaks, "frame_index", "ms_level", *more)
    rows = F.sort_array(F.collect_list(F.struct("scan_index", "tof_index", "intensity")))
    held = peaks.groupBy(*own).agg(rows.alias("p"))
    field = lambda k: F.transform("p", lambda x: x[k].cast("bigint"))
    return held.select(*own, csr_compress(field("scan_index")).alias("scan_offsets"), field("tof_index").alias("tof_indices"), field("intensity").alias("intensities"))


def bucket_counts(peaks: DataFrame) -> DataFrame:
    """Peaks in each (quad, tof) bucket: the transposed layout's histogram."""
    return peaks.groupBy(*keys(peaks, "quad_major", "quad_sub", "tof_index")).agg(F.count(F.lit(1)).alias("n_peaks"), F.sum("intensity").alias("intensity"))


def slice_info(peaks: DataFrame, order: Column | None = None) -> DataFrame:
    """Per quad: frames, peaks, largest bucket, time span, mean cycle time.

    ``largest_tof`` is of the bucket that is last by ``order`` of its peaks ``n`` and its ``tof_index``: as a rule by n, then tof.
    """
    order = F.struct("n", "tof_index") if order is None else order
    own = keys(peaks, "quad_major", "quad_sub")
    per = peaks.groupBy(*own, "tof_index").agg(F.count(F.lit(1)).alias("n"))
    buckets = per.groupBy(*own).agg(F.count(F.lit(1)).alias("n_buckets"), F.max("n").alias("largest"), F.max_by("tof_index", order).alias("largest_tof"))
    frames = peaks.groupBy(*own).agg(F.countDistinct("frame_index").alias("n_frames"), F.count(F.lit(1)).alias("n_peaks"), F.min("rt").alias("rt_first"), F.max("rt").alias("rt_last"))
    out = frames.join(buckets, [frames[c].eqNullSafe(buckets[c]) for c in own]).drop(*[buckets[c] for c in own])
    return out.withColumn("cycle_time", (F.col("rt_last") - F.col("rt_first")) / F.col("n_frames"))
