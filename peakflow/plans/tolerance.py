"""Tolerances and calibration as column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DataReadingError

_KINDS = {"ms": ("Absolute", "Ppm"), "rt": ("Absolute", "Pct", "None"), "mobility": ("Absolute", "Pct", "None"), "quad": ("Absolute",)}


@dataclass(frozen=True)
class Width:
    """How far a range reaches below and above a value: in units, percent, or parts per million."""

    kind: str
    low: float = 0.0
    high: float = 0.0


@dataclass(frozen=True)
class Tolerance:
    """20 ppm, 5 s, 3 percent and 0.1 Th unless told otherwise."""

    ms: Width = field(default=Width("Ppm", 20.0, 20.0))
    rt: Width = field(default=Width("Absolute", 5.0, 5.0))
    mobility: Width = field(default=Width("Pct", 3.0, 3.0))
    quad: Width = field(default=Width("Absolute", 0.1, 0.1))

    @staticmethod
    def from_json(text: str) -> Tolerance:
        """From externally tagged JSON; ``rt`` may be missing and is then unbounded."""
        raw = {"rt": "None"} | json.loads(text)
        made = {}
        for name, kinds in _KINDS.items():
            if name not in raw:
                raise DataReadingError(f"tolerance lacks {name!r}")
            value = raw[name]
            kind, ends = (value, (0.0, 0.0)) if isinstance(value, str) else next(iter(value.items()))
            if kind not in kinds or len(ends) != 2:
                raise DataReadingError(f"tolerance {name!r} can't be {value!r}")
            made[name] = Width(kind, float(ends[0]), float(ends[1]))
        return Tolerance(**made)

    def to_json(self) -> str:
        """The same form that :meth:`from_json` reads."""
        return json.dumps({n: "None" if (w := getattr(self, n)).kind == "None" else {w.kind: [w.low, w.high]} for n in _KINDS}, indent=2)

    @staticmethod
    def template() -> Tolerance:
        """15 ppm, any time, 10 percent mobility, 0.1 Th."""
        return replace(Tolerance(), ms=Width("Ppm", 15.0, 15.0), rt=Width("None"), mobility=Width("Pct", 10.0, 10.0))

    def mz_range(self, mz: Column) -> tuple[Column, Column]:
        """(low, high) in m/z; ppm are of the value."""
        a, b = (F.lit(self.ms.low), F.lit(self.ms.high)) if self.ms.kind == "Absolute" else (mz * self.ms.low / 1e6, mz * self.ms.high / 1e6)
        return mz - a, mz + b

    def rt_range(self, rt: Column) -> tuple[Column, Column]:
        """(low, high) in seconds, single precision; nulls where unbounded."""
        return _single(self.rt, rt)

    def mobility_range(self, mobility: Column) -> tuple[Column, Column]:
        """(low, high) in 1/K0, single precision; nulls where unbounded."""
        return _single(self.mobility, mobility)

    def quad_range(self, low: Column, high: Column) -> tuple[Column, Column]:
        """Isolation range around the least and greatest precursor m/z; raises below zero."""
        a, b = (low - self.quad.low).cast("float"), (high + self.quad.high).cast("float")
        bad = (low <= 0) | (high <= 0)
        return F.when(bad, F.raise_error(F.lit("precursor m/z must be above zero")).cast("float")).otherwise(a), b


def _single(width: Width, x: Column) -> tuple[Column, Column]:
    x = x.cast("float")
    lit = lambda v: F.lit(v).cast("float")
    if width.kind == "None":
        return F.lit(None).cast("float"), F.lit(None).cast("float")
    if width.kind == "Absolute":
        return x - lit(width.low), x + lit(width.high)
    part = lambda v: (x * lit(v) / lit(100.0)).cast("float")  # noqa: E731  the quotient of floats is a double
    return x - part(width.low), x + part(width.high)


@dataclass(frozen=True)
class Calibration:
    """Converters between index and physical units, injectable; identity unless told otherwise.

    m/z is linear or, with ``root``, the square of a line in the tof index; mobility and time are lines.
    """

    tof: tuple[float, float] = (0.0, 1.0)
    scan: tuple[float, float] = (0.0, 1.0)
    frame: tuple[float, float] = (0.0, 1.0)
    root: bool = False
    lower_im: float = 0.0
    upper_im: float = 1000.0
    lower_rt: float = 0.0
    upper_rt: float = 1e6

    def mz(self, tof: Column) -> Column:
        line = self.tof[0] + self.tof[1] * tof
        return line * line if self.root else line

    def tof_of(self, mz: Column) -> Column:
        return ((F.sqrt(mz) if self.root else mz) - self.tof[0]) / self.tof[1]

    def mobility(self, scan: Column) -> Column:
        return self.scan[0] + self.scan[1] * scan

    def scan_of(self, mobility: Column) -> Column:
        return (mobility.cast("double") - self.scan[0]) / self.scan[1]

    def rt(self, frame: Column) -> Column:
        return self.frame[0] + self.frame[1] * frame

    def frame_of(self, rt: Column) -> Column:
        return (rt.cast("double") - self.frame[0]) / self.frame[1]


def included(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends in order."""
    return F.least(a, b), F.greatest(a, b)


def ppm_range(x: Column, ppm: float) -> tuple[Column, Column]:
    """Symmetric range in parts per million."""
    return included(x - x * ppm / 1e6, x + x * ppm / 1e6)


def pct_range(x: Column, pct: float) -> tuple[Column, Column]:
    """Symmetric range in percent."""
    return included(x - x * pct / 100, x + x * pct / 100)


def tof_window(tof: Column, ppm: float, cal: Calibration) -> tuple[Column, Column]:
    """Tof indices within ppm of an index, rounded."""
    return tuple(F.round(cal.tof_of(x)).cast("bigint") for x in ppm_range(cal.mz(tof), ppm))


def scan_window(scan: Column, pct: float, cal: Calibration) -> tuple[Column, Column]:
    """Scan indices within percent of an index, rounded and put in order."""
    return included(*(F.round(cal.scan_of(x)).cast("bigint") for x in pct_range(cal.mobility(scan), pct)))


def frame_window(low: Column, high: Column, cal: Calibration) -> tuple[Column, Column]:
    """Frame indices of a time range, rounded."""
    return tuple(F.round(cal.frame_of(x)).cast("bigint") for x in (low, high))
