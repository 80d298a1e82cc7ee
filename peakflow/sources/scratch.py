"""A shared folder for what a query writes and reads back."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

#: Used only where the session names no shared folder and has no cluster, as in tests.
LOCAL = "/tmp/peakflow-scratch"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names, removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL
    path = f"{root.rstrip('/')}/peakflow/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is scratch
        pass
