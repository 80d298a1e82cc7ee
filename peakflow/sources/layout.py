"""Layouts at rest: the access path decides how peaks are partitioned and sorted.

``tof_major`` files are cut by (ms level, quad) and sorted by tof, so that a
target reads a few row groups of few partitions; ``frame_major`` ones by frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs

SORTS = {"tof_major": ("tof_index", "scan_index"), "frame_major": ("frame_index", "tof_index")}
#: Peaks that one file holds at most, about.
FILE_ROWS = 20_000_000
#: Peaks that one task sorts, about, unless the number of files is told: some 100 bytes each in memory.
TASK_ROWS = 2_000_000


def write_peaks(peaks: DataFrame, path: str, layout: str = "tof_major", files: int | None = None) -> None:
    """Write ``peaks`` in a layout. MS1, which may hold most peaks, is split by range like any quad.

    Tasks are as many as the peaks need, so what one sorts does not grow with the run; a file is a quad's part of one task.
    """
    keys = runs.keys(peaks, "ms_level", "quad_major", "quad_sub")
    lead = SORTS[layout]
    files = files or max(1, -(-peaks.count() // TASK_ROWS))
    ordered = peaks.repartitionByRange(files, *keys, *lead).sortWithinPartitions(*keys, *lead)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("ms_level", "quad_major").parquet(path)


def write_bucketed(peaks: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed by tof bin, so that the extraction join needs no shuffle of the peaks."""
    from ..operators.extract import BIN

    peaks.withColumn("bin", F.floor(F.col("tof_index") / BIN)).write.mode("overwrite").bucketBy(buckets, "bin").sortBy("tof_index").saveAsTable(table)
