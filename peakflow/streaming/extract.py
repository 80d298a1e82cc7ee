"""Extraction over a stream of peaks: the same join and sums, incrementally.

The batch engine's contract is over finished runs; this serves instruments that
still write. Targets are static, so the join keeps no state; sums by group do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import intensity_sum
from ..operators.extract import extract


def intensity_stream(peaks: DataFrame, targets: DataFrame, windows: DataFrame, access: str = "frame_major") -> DataFrame:
    """Running intensity by group of a streaming ``peaks``."""
    return intensity_sum(extract(peaks, targets, windows, access))


def start(df: DataFrame, name: str, checkpoint: str, sink: str = "memory") -> StreamingQuery:
    """Start a stream that processes what is there, in complete mode, and then stops."""
    return df.writeStream.outputMode("complete").format(sink).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
