"""A store of peaks and the queries it answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators import aggregate, expand, score
from .operators.centroid import centroid_frames, relative
from .operators.extract import extract, extract_one
from .plans.targets import resolve
from .plans.tolerance import Calibration, Tolerance

AGGREGATORS = ("raw-peak-intensity", "raw-peak-vector", "multi-cmg-stats")
#: More groups than this take the tof-major path where none is asked for.
MANY_GROUPS = 10


@dataclass(frozen=True)
class Centroiding:
    """How frames are centroided: tof in ppm, mobility in percent, frames in a window."""

    tof_ppm: float = 15.0
    scan_pct: float = 1.5
    width: int = 3


@dataclass
class PeakStore:
    """Peaks of a run with its isolation windows and calibration."""

    peaks: DataFrame
    windows: DataFrame
    calibration: Calibration = field(default_factory=Calibration)
    access: str = "frame_major"

    @staticmethod
    def from_frames(frames: DataFrame, windows: DataFrame, calibration: Calibration | None = None, access: str = "frame_major", centroiding: Centroiding | None = None) -> PeakStore:
        """Expand frames (all of them, in one pass), and centroid them if settings for that are given."""
        peaks = expand.expand(expand.require_ms2(frames), windows)
        if centroiding is not None:
            peaks = centroid_frames(peaks, relative(centroiding.tof_ppm, 1e6), relative(centroiding.scan_pct, 100.0), centroiding.width)
        return PeakStore(peaks, windows, calibration or Calibration(), access)

    def extract(self, targets: DataFrame) -> DataFrame:
        """Matches of resolved targets."""
        return extract(self.peaks, targets, self.windows, self.access)

    def query_one(self, target: dict) -> DataFrame:
        """Matches of one resolved target."""
        return extract_one(self.peaks, target, self.windows, self.access)

    def query(self, groups: DataFrame, tol: Tolerance | None = None, aggregator: str | Callable[[DataFrame, DataFrame], DataFrame] = "raw-peak-intensity") -> DataFrame:
        """Extract all ``groups`` in one join and aggregate: by name, or by (matches, targets) -> DataFrame."""
        targets = resolve(groups, tol or Tolerance(), self.calibration)
        hits = self.extract(targets)
        if callable(aggregator):
            return aggregator(hits, targets)
        if aggregator == "raw-peak-intensity":
            return aggregate.zero_filled(aggregate.intensity_sum(hits), targets)
        if aggregator == "raw-peak-vector":
            return aggregate.peak_vectors(hits, targets)
        if aggregator == "multi-cmg-stats":
            expected = targets.select("eg_id", "ms_level", "transition_key", "expected_intensity")
            cmg = aggregate.chromatograms(hits)
            scores = score.scored(aggregate.rt_summary(cmg, expected))
            return score.cross_scores(score.with_transitions(scores, aggregate.densified(cmg), targets, self.calibration))
        raise ValueError(f"aggregator must be one of {AGGREGATORS} or a function")


def choose_access(n_groups: int) -> str:
    """The access path where none is asked for."""
    return "tof_major" if n_groups > MANY_GROUPS else "frame_major"
