"""Small helpers shared by the corpus operators: shared scratch space and size checks."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A small side is broadcast only below this many rows (of a few dozen bytes each).
BROADCAST_ROWS = 200_000
#: Used only where the session names no shared folder and has no cluster, as in tests.
LOCAL_SCRATCH = "/tmp/peakflow-scratch"
#: White space as the word rule has it: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", LOCAL_SCRATCH)
        named = LOCAL_SCRATCH
    return named.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system, whatever store it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared scratch space, removed when the driver ends."""
    path = f"{scratch_root(spark)}/peakflow/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def words(text):
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a string column; null has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))

