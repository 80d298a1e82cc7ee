"""Command line: write a template, or query a run."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import AGGREGATORS, Centroiding, PeakStore, choose_access
from .plans.targets import template_groups
from .sources import readers, sinks

FORMATS = ("pretty-json", "json", "parquet", "msgpack")
INDICES = {"expanded-raw-frame-index": "frame_major", "transposed-quad-index": "tof_major", "unspecified": None}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("peakflow")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("write-template")
    t.add_argument("--output-path", required=True)
    t.add_argument("--num-elution-groups", type=int, default=10)
    q = sub.add_parser("query-index")
    q.add_argument("--frames", required=True, help="parquet of frames")
    q.add_argument("--quad-windows", required=True, help="parquet of isolation windows")
    q.add_argument("--tolerance-settings-path", required=True)
    q.add_argument("--elution-groups-path", required=True)
    q.add_argument("--output-path", required=True)
    q.add_argument("--aggregator", choices=AGGREGATORS, default="raw-peak-intensity")
    q.add_argument("--index", choices=tuple(INDICES), default="unspecified")
    q.add_argument("--format", choices=FORMATS, default="pretty-json")
    q.add_argument("--centroid", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("peakflow").getOrCreate()
    if a.command == "write-template":
        sinks.write_template(template_groups(spark, a.num_elution_groups), a.output_path)
        return
    groups = readers.read_elution_groups(spark, a.elution_groups_path)
    access = INDICES[a.index] or choose_access(groups.count())
    store = PeakStore.from_frames(readers.read_frames(spark, a.frames), readers.read_quad_windows(spark, a.quad_windows), access=access, centroiding=Centroiding() if a.centroid else None)
    out = sinks.enveloped(store.query(groups, readers.read_tolerance(a.tolerance_settings_path), a.aggregator), groups)
    if a.format == "parquet":
        sinks.write_parquet(out, a.output_path)
    elif a.format == "msgpack":
        sinks.write_msgpack(out, a.output_path)
    else:
        sinks.write_report(out, a.output_path, pretty=a.format == "pretty-json")


if __name__ == "__main__":
    main()
