"""Centroiding over neighbouring frames, and the peak-width estimate: greedy and in order, so grouped pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataProcessingError
from .runs import RUN, keys

#: Least summed intensity and least number of peaks of a centroid.
LEAST_INTENSITY, LEAST_PEAKS = 100, 1
#: Windows that one group of a task centroids, at most, and peaks that it holds about, if frames hold fewer.
WINDOWS_A_GROUP, PEAKS_A_GROUP = 64, 2_000_000
#: Pairs of a peak and one of its window's tofs that are looked at together.
PAIRS = 1_000_000


def _bounds(of, values):
    """Lower and upper bounds of each value, asked once for each distinct one, or for all if ``of`` takes arrays."""
    if getattr(of, "arrays", False):
        return of(values)
    each, back = np.unique(values, return_inverse=True)
    lo, hi = zip(*map(of, each), strict=True)
    return np.array(lo)[back], np.array(hi)[back]


def _crowded(scan, s_lo, s_hi, a, b):
    """Which peaks have another one in their window, or are in another's. Windows' peaks are looked at ``PAIRS`` at a time."""
    out, size = np.zeros(len(scan), bool), np.maximum(b - a, 0)
    ends, k = np.cumsum(size), 0
    while k < len(scan):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        n = size[k:stop]
        i = np.repeat(np.arange(k, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + a[i]
        meet = (i != j) & (scan[j] >= s_lo[i]) & (scan[j] <= s_hi[i])
        out[i[meet]], out[j[meet]] = True, True
        k = stop
    return out


def centroid_window(tof, scan, weight, is_reference, tof_range, scan_range, frame=None):
    """Centroids of pooled peaks as arrays (tof, scan, intensity), by tof.

    Peaks are visited by (tof, scan, frame, weight). An untaken one is a centre
    if no untaken peak in its window outweighs it; its window is then taken and
    the reference frame's intensities in it are summed. ``tof_range`` and
    ``scan_range`` map a centre to its bounds: tof half-open, scan closed.

    Peaks that share no window with another are no one's but their own, so they
    are decided all at once; only the others are visited in order.
    """
    tof, scan, weight = np.asarray(tof), np.asarray(scan), np.asarray(weight)
    own = np.where(np.asarray(is_reference, bool), weight, 0)
    if not len(tof):
        return tuple(np.array([], np.int64) for _ in range(3))
    order = np.lexsort((weight, np.zeros(len(tof)) if frame is None else np.asarray(frame), scan, tof))
    tof, scan, weight, own = tof[order], scan[order], weight[order], own[order]
    (lo, hi), (s_lo, s_hi) = _bounds(tof_range, tof), _bounds(scan_range, scan)
    a, b = np.searchsorted(tof, lo, "left"), np.searchsorted(tof, hi, "left")
    crowded, at = _crowded(scan, s_lo, s_hi, a, b), np.arange(len(tof))
    alone = (a <= at) & (at < b) & (scan >= s_lo) & (scan <= s_hi)
    total = np.where(alone, own, 0)
    centre = ~crowded & (alone >= LEAST_PEAKS) & (total >= LEAST_INTENSITY)
    some = np.flatnonzero(crowded)
    first, last = np.searchsorted(some, a[some]), np.searchsorted(some, b[some])
    s, w, o, s_lo, s_hi = (x[some] for x in (scan, weight, own, s_lo, s_hi))
    taken = np.zeros(len(some), bool)
    for k in range(len(some)):
        if taken[k]:
            continue
        x, y = first[k], last[k]
        inside = np.flatnonzero(~taken[x:y] & (s[x:y] >= s_lo[k]) & (s[x:y] <= s_hi[k])) + x
        if len(inside) < LEAST_PEAKS or (w[inside] > w[k]).any():
            continue
        summed = o[inside].sum()
        if summed >= LEAST_INTENSITY:
            taken[inside] = True
            centre[some[k]], total[some[k]] = True, summed
    return tuple(np.array(x[centre], np.int64) for x in (tof, scan, total))


def relative(ppm_or_pct: float, scale: float):
    """Bounds at a share of the index itself (identity calibration), rounded."""
    return lambda x: (round(x - x * ppm_or_pct / scale), round(x + x * ppm_or_pct / scale))


def absolute(width: int):
    """Bounds at a fixed distance."""
    of = lambda x: (x - width, x + width)
    of.arrays = True
    return of


def centroid_frames(peaks: DataFrame, tof_range=None, scan_range=None, width: int = 3) -> DataFrame:
    """Centroided peaks: each quad's frames in windows of ``width`` by time, the middle one as reference.

    A series of windows is one group: ``WINDOWS_A_GROUP``, or so few that its
    frames hold ``PEAKS_A_GROUP`` peaks; frames at a border go to both sides. n
    frames give n - width + 1. Runs, where ``peaks`` has a run_id, are apart.
    """
    if width < 2:
        raise DataProcessingError("a window needs two frames at least")
    tof_range, scan_range = tof_range or relative(15.0, 1e6), scan_range or relative(1.5, 100.0)
    own = keys(peaks, "ms_level", "quad_major", "quad_sub")
    frames = peaks.groupBy(*own, "frame_index", "rt").agg(F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy(*own)
    frames = frames.withColumn("per", F.greatest(F.lit(1), F.least(F.lit(WINDOWS_A_GROUP), F.floor(F.lit(PEAKS_A_GROUP) / F.max("size").over(group)))).cast("int"))
    frames = frames.withColumns({"at": F.row_number().over(group.orderBy("rt", "frame_index")) - 1, "n": F.count(F.lit(1)).over(group)})
    first, last = F.greatest(F.col("at") - width + 1, F.lit(0)), F.least(F.col("at"), F.col("n") - width)
    chunks = F.explode(F.sequence(F.floor(first / F.col("per")), F.floor(last / F.col("per"))))
    placed = frames.filter(F.col("n") >= width).withColumn("chunk", chunks)
    f = placed.select(*[F.col(c).alias(f"f_{c}") for c in own], F.col("frame_index").alias("f_frame"), "chunk", "at", "n", "per")
    p = peaks.select(*own, "frame_index", "rt", "scan_index", "tof_index", "intensity")
    pooled = p.join(f, [p.frame_index == f.f_frame, *[p[c].eqNullSafe(f[f"f_{c}"]) for c in own]]).select(p["*"], "chunk", "at", "n", "per")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        at, chunk, n, per = pdf["at"].to_numpy(), *(int(pdf[c].iloc[0]) for c in ("chunk", "n", "per"))
        tof, scan, weight, frame, rt = (pdf[c].to_numpy() for c in ("tof_index", "scan_index", "intensity", "frame_index", "rt"))
        parts = []
        for w in range(chunk * per, min((chunk + 1) * per, n - width + 1)):
            a, b = np.searchsorted(at, (w, w + width))
            middle = at[a:b] == w + width // 2
            if middle.any():
                t, s, total = centroid_window(tof[a:b], scan[a:b], weight[a:b], middle, tof_range, scan_range, frame[a:b])
                k = a + int(np.argmax(middle))
                parts.append(pd.DataFrame({"frame_index": frame[k], "rt": rt[k], "scan_index": s, "tof_index": t, "intensity": total}))
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=list(kind))
        for c in own:
            out[c] = pdf[c].iloc[0]
        return out[list(kind)]

    kind = dict(peaks.select(*own[:-3]).dtypes) | {"ms_level": "int", "quad_major": "int", "quad_sub": "int", "frame_index": "bigint", "rt": "double", "scan_index": "bigint", "tof_index": "bigint", "intensity": "bigint"}
    return pooled.groupBy(*own, "chunk").applyInPandas(run, ", ".join(f"{k} {v}" for k, v in kind.items()))


def peak_width(peaks: DataFrame, samples: int = 49, tops: int = 10, least: int = 100, apart: int = 5) -> DataFrame:
    """Per quad: median width in seconds of peaks tracked from sampled frames of its middle 60 percent.

    A sampled frame's ``tops`` strongest tofs are followed both ways, one tof
    either side, until they fall to a hundredth twice. Tracks need a quad's
    frames in order, so what is gathered is, from all frames, each peak within
    one tof of a start: all that a track can see.
    """
    quads, run_kind = keys(peaks, "quad_major"), [f"{c} {t}, " for c, t in peaks.dtypes if c == RUN]
    by_tof = peaks.groupBy(*quads, "frame_index", "rt", "tof_index").agg(F.sum("intensity").alias("intensity"))
    frames = peaks.select(*quads, "frame_index", "rt").distinct()
    quad = Window.partitionBy(*quads)
    frames = frames.withColumns({"at": F.row_number().over(quad.orderBy("frame_index", "rt")) - 1, "n": F.count(F.lit(1)).over(quad)})
    ats = [F.floor(F.col("n") * F.lit(0.2 + 0.6 * k / max(1, samples))).cast("int") for k in range(samples)]
    same = lambda x, y: [x[c].eqNullSafe(y[f"q_{c}"]) for c in quads]
    of = lambda x, y: [*same(x, y), x.frame_index == y.f, x.rt == y.t]
    quad_names = [F.col(c).alias(f"q_{c}") for c in quads]
    names = [*quad_names, F.col("frame_index").alias("f"), F.col("rt").alias("t")]
    sampled = frames.filter(F.array_contains(F.array(*ats), F.col("at"))).select(*names)
    strongest = Window.partitionBy(*quads, "frame_index", "rt").orderBy(F.desc("intensity"), F.desc("tof_index"))
    starts = by_tof.join(sampled, of(by_tof, sampled), "left_semi").filter(F.col("intensity") > least)
    starts = starts.withColumn("k", F.row_number().over(strongest)).filter(F.col("k") <= tops)
    near = starts.select(*quad_names, F.explode(F.sequence(F.col("tof_index") - 1, F.col("tof_index") + 1)).alias("tof")).distinct()
    seen = by_tof.join(near, [*same(by_tof, near), by_tof.tof_index == near.tof], "left_semi")
    placed = frames.select(*names, "at", "n")
    seen = seen.join(placed, of(seen, placed)).select(*quads, "at", "n", "rt", "tof_index", "intensity")
    # One row more for each quad, at no frame, as quads without a start count too.
    every = frames.groupBy(*quads).agg(F.lit(-1).alias("at"), F.max("n").alias("n"), F.lit(0.0).alias("rt"), F.lit(0).cast("bigint").alias("tof_index"), F.lit(0).cast("bigint").alias("intensity"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, widths = int(pdf.n.iloc[0]), []
        times, held = dict(zip(pdf["at"], pdf["rt"])), {k: dict(zip(g.tof_index, g.intensity)) for k, g in pdf.groupby("at")}
        for k in range(samples):
            at = int(n * (0.2 + 0.6 * k / max(1, samples)))
            if at >= n:
                continue
            best = sorted(((i, t) for t, i in held.get(at, {}).items() if i > least), reverse=True)[:tops]
            chosen: list[int] = []
            for _, t in sorted(best, key=lambda x: x[1]):
                if not chosen or t - chosen[-1] > apart:
                    chosen.append(t)
            for t in chosen:
                top, ends = held[at][t], []
                for step, stop in ((1, n), (-1, 1)):
                    j, misses, last = at, 0, at
                    while j + step != stop and 0 <= j + step < n and misses < 2:
                        j += step
                        seen = sum(held.get(j, {}).get(t + d, 0) for d in (-1, 0, 1))
                        misses, last = (misses + 1, last) if seen <= top / 100 else (0, j)
                    ends.append(last)
                widths.append(times[ends[0]] - times[ends[1]])
        widths.sort()
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in quads}, "n_tracks": [len(widths)], "width": [widths[len(widths) // 2] if widths else None]})

    return seen.unionByName(every).groupBy(*quads).applyInPandas(run, "".join(run_kind) + "quad_major int, n_tracks bigint, width double")
