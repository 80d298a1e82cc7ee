"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import DataReadingError
from ..operators.runs import RUN, keys
from ..plans.tolerance import Tolerance


def _with_run(spark: SparkSession, path: str, schema: str, skip_bad_files: bool = False) -> str:
    """``schema``, with the run's column if the files' own schema has it."""
    reader = spark.read.option("ignoreCorruptFiles", "true") if skip_bad_files else spark.read
    return f"{schemas.RUN_COLUMN}, {schema}" if RUN in reader.parquet(path).columns else schema


def read_frames(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ms_level: int | None = None, skip_bad_files: bool = False) -> DataFrame:
    """Frames of a run, or of several if files have a run_id; half-open index range and MS level pushed to the scan."""
    reader = spark.read.schema(_with_run(spark, path, schemas.FRAMES, skip_bad_files))
    df = (reader.option("ignoreCorruptFiles", "true") if skip_bad_files else reader).parquet(path)
    if low is not None:
        df = df.filter(F.col("frame_index") >= low)
    if high is not None:
        df = df.filter(F.col("frame_index") < high)
    return df if ms_level is None else df.filter(F.col("ms_level") == ms_level)


def good_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, bad) frames: bad ones have null or unequal arrays, or offsets that don't fit them."""
    size = F.size("tof_indices")
    ok = (size == F.size("intensities")) & (F.size("scan_offsets") > 0) & (F.element_at("scan_offsets", -1) == size) & F.col("rt").isNotNull()
    ok = F.coalesce(F.when(F.col("scan_offsets").isNotNull() & F.col("tof_indices").isNotNull() & F.col("intensities").isNotNull(), ok), F.lit(False))
    return frames.filter(ok), frames.filter(~ok)


def read_quad_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_run(spark, path, schemas.QUAD_WINDOWS)).parquet(path)


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks in either layout; partition columns come back with the rest, the run's if it is there."""
    peaks = spark.read.parquet(path)
    return peaks.select(*keys(peaks, *schemas.PEAK_COLUMNS))


def read_elution_groups(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of elution groups; unknown keys are ignored, optional ones may be absent."""
    return spark.read.schema(schemas.ELUTION_GROUPS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_tolerance(path: str, spark: SparkSession | None = None) -> Tolerance:
    """A tolerance file; through Spark's file systems if a session is given."""
    if spark is None:
        with open(path) as f:
            return Tolerance.from_json(f.read())
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise DataReadingError(f"{path} must be one file")
    return Tolerance.from_json(rows[0].value)


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)
