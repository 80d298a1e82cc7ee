"""Known values of the engine's functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakflow.errors import DataReadingError, UnsupportedDataError
from peakflow.functions import scalars as s
from peakflow.operators import align, centroid, expand, score
from peakflow.plans import targets as tg
from peakflow.plans.tolerance import Calibration, Tolerance, Width, scan_window, tof_window

NAN = float("nan")


def one(spark, expr, **cols):
    kinds = {k: v[1] for k, v in cols.items()}
    real = lambda v, t: v if "double" not in t or "struct" in t else [float(x) for x in v] if isinstance(v, list) else float(v)
    cols = {k: (real(*v), v[1]) for k, v in cols.items()}
    df = spark.createDataFrame([tuple(v[0] for v in cols.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(expr.alias("x")).first().x


def close(a, b, eps=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (math.isnan(x) and math.isnan(y)) or x == y or abs(x - y) < eps, (a, b)


@pytest.mark.parametrize("off, ids", [([0, 0, 5, 5, 5, 7], [1] * 5 + [4] * 2), ([0, 2, 4, 4, 4, 7], [0, 0, 1, 1, 4, 4, 4]), ([0, 1, 6, 6, 6, 25], [0] + [1] * 5 + [4] * 19), ([], [])])
def test_csr(spark, off, ids):
    assert one(spark, s.csr_explode(F.col("o")), o=(off, "array<bigint>")) == ids
    if ids:
        assert one(spark, s.csr_compress(F.col("i")), i=(ids, "array<bigint>")) == off


def test_csr_unsorted(spark):
    with pytest.raises(Exception, match="not sorted"):
        one(spark, s.csr_compress(F.col("i")), i=([2, 1], "array<bigint>"))


def test_csr_works_out_its_array_once(spark):
    """Not once for each element: a frame's cost is in proportion to its peaks."""
    for f in (s.csr_compress, s.csr_explode):
        df = spark.createDataFrame([(list(range(50_000, -1, -1)),)], "i array<bigint>").select(f(F.reverse("i")).alias("o"))
        assert df._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
        assert len(df.first().o) == {s.csr_compress: 50_002, s.csr_explode: 50_000}[f]


def test_rolling_median(spark):
    v = [1.0, 2.0, 30.0, 4.0, 5.0, 60.0, 7.0, 8.0, 9.0]
    close(one(spark, s.rolling_median(F.col("v"), 3), v=(v, "array<double>")), [NAN, 2, 4, 5, 5, 7, 8, 8, NAN])
    close(one(spark, s.vs_baseline(F.col("v"), 3), v=([float(i) for i in range(1, 10)], "array<double>")), [NAN] + [0.0] * 7 + [NAN])


def stats(spark, values, weights=None):
    pairs = [(float(v), float(w)) for v, w in zip(values, weights or [1] * len(values))]
    return one(spark, s.running_stats(F.col("p")), p=(pairs, "array<struct<v:double,w:double>>"))


def test_running_stats(spark):
    third = [7.46, 6.77, 12.74, 7.11, 7.81, 8.84, 6.08, 5.39, 8.15, 6.42, 5.73]
    fourth = [6.58, 5.76, 7.71, 8.84, 8.47, 7.04, 5.25, 12.50, 5.56, 7.91, 6.89]
    for values, mean, sd in ((third, (7.4, 7.6), (1.92, 1.99)), (fourth, (7.4, 7.6), (1.91, 1.99))):
        r = stats(spark, values)
        assert mean[0] < r.mean < mean[1] and sd[0] < r.sd < sd[1] and r.weight == 11
    r = stats(spark, [0, 10, 0, 10, 0, 10, 0], [1] * 7)
    assert 4.5 <= r.sd < 5.5
    r = stats(spark, [0] + [10] * 5, [10] + [2] * 5)
    assert 4.4 < r.mean < 5.6 and 15 < r.sd**2 < 25


def test_cosine(spark):
    cos = lambda a, b: one(spark, s.cosine_similarity(F.col("a"), F.col("b")), a=(a, "array<double>"), b=(b, "array<double>"))
    assert abs(cos([1.0, 2, 3], [4.0, 5, 6]) - 0.9746318461970762) < 1e-12
    assert abs(cos([1.0, 2, 3], [1.0, 2, 3]) - 1) < 1e-12 and math.isnan(cos([0.0, 0], [1.0, 2]))
    for a, b in (([], []), ([1.0], [1.0, 2.0])):
        with pytest.raises(Exception, match="cosine"):
            cos(a, b)


def test_rolling_cosine(spark):
    roll = lambda a, b, w, mode="exact": one(spark, s.rolling_cosine(F.col("a"), F.col("b"), w, mode), a=(a, "array<double>"), b=(b, "array<double>"))
    a, b = [1.0, 2.0, 3.0] * 3, [4.0, 5.0, 6.0] * 3
    close(roll(a, b, 3), [NAN] + [0.9746318461970762] * 7 + [NAN])
    close(roll(a, b, 3, "compat"), [NAN, 0.97463, 0.97823, 0.95065, 0.97463, 0.97823, 0.95065, 0.97463, NAN], 1e-4)
    close(roll([1, 2, 3, 4], [1, 2, 3, 4], 2), [NAN, 1, 1, NAN])
    close(roll([0, 0, 1, 1], [0, 0, 1, 1], 2), [NAN, 0, 1, NAN])
    with pytest.raises(Exception, match="rolling cosine"):
        roll([1.0], [1.0], 2)


REF, X = [1.0, 2, 4, 5, 6, 7, 10], [1.1, 2.1, 3.1, 4.1, 5.1, 6.1, 7.1, 8.1, 10.1]


@pytest.mark.parametrize(
    "kind, ref, x, v, want",
    [
        ("max", REF, X, [5, 3, 1, 2, 1, 2, 4, 11, 9], [5, 3, 2, 1, 2, 11, 9]),
        ("max", REF, X, [5, 1, 3, 2, 1, 2, 7, 11, 9], [5, 1, 3, 1, 2, 11, 9]),
        ("sum", REF, X, [5, 3, 1, 2, 1, 2, 4, 4, 9], [5, 3, 3, 1, 2, 8, 9]),
        ("max", [1.0, 2, 3, 4, 5, 6, 7, 8, 10], [1.0, 2, 4, 5, 6, 7, 10], [5, 3, 2, 1, 2, 4, 9], [5, 3, -math.inf, 2, 1, 2, 4, -math.inf, 9]),
        ("product", [1.0, 2, 3], [1.0, 1.1, 2.0, 2.1, 3.0], [2, 2, 3, 10, 4], [4, 30, 4]),
    ],
)
def test_alignment(spark, kind, ref, x, v, want):
    refs = spark.createDataFrame([(1, float(r)) for r in ref], "g int, x double")
    values = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, v)], "g int, x double, v double")
    out = align.align(refs, values, ["g"], {"max": align.largest, "sum": align.total, "product": align.product}[kind]).orderBy("x")
    close([r.v for r in out.collect()], [float(w) for w in want])
    if kind != "product":
        got = one(spark, align.align_arrays(F.col("r"), F.col("x"), F.col("v"), kind), r=(ref, "array<double>"), x=(x, "array<double>"), v=([float(b) for b in v], "array<double>"))
        close(got, [float(w) for w in want])


def test_sorting(spark):
    out = one(spark, s.sort_by_first(F.col("a"), F.col("b")), a=([3, 1, 4], "array<int>"), b=(["x", "y", "z"], "array<string>"))
    assert [tuple(r) for r in out] == [(1, "y"), (3, "x"), (4, "z")]
    out = one(spark, s.top_n(F.col("v"), 3), v=([1, 2, 10, 4, 5, 9, 7, 8, 2, 1], "array<int>"))
    assert [tuple(r) for r in out] == [(10, 2), (9, 5), (8, 7)]
    assert [tuple(r) for r in one(spark, s.top_n(F.col("v"), 2), v=([5, 5, 5], "array<int>"))] == [(5, 0), (5, 1)]


def test_factorials(spark):
    f = lambda g, x, t: one(spark, g(F.col("x")), x=(x, t))
    assert f(s.lnfact, 0, "int") == 1.0 and abs(f(s.lnfact, 5, "int") - 5.5756) < 1e-3
    assert f(s.lnfact_float, 0.5, "double") == 0.0 and abs(f(s.lnfact_float, 5.0, "double") - 5.5756) < 1e-3


def test_argmax_and_asof(spark):
    arr = lambda g, v: one(spark, g(F.col("v")), v=(v, "array<double>"))
    assert arr(s.first_argmax, [-1.0, 2.0, 2.0]) == 1 and arr(s.first_argmax, [-1.0, 0.0]) == 0
    assert arr(s.last_argmax, [1.0, 3.0, 3.0, 2.0]) == 2
    for bad in ([], [NAN], [math.inf]):
        with pytest.raises(Exception, match="finite"):
            arr(s.last_argmax, bad)
    at = lambda t: one(spark, s.index_before(F.col("v"), F.lit(t)), v=([10, 20, 30], "array<int>"))
    assert [at(t) for t in (5, 10, 20, 25, 99)] == [0, 0, 0, 1, 2]


def test_saturating(spark):
    got = [one(spark, s.sat_uint(F.col("x")), x=(x, "double")) for x in (-1.5, NAN, 2.9, 1e30)]
    assert got == [0, 0, 2, 2**63 - 1]
    assert one(spark, s.rt_ms(F.col("x")), x=(1.2345, "double")) == 1234


def test_frames(spark):
    rows = [(0, 1, [0, 2, 4, 6], [1, 2, 3, 4, 1, 2], [10, 20, 30, 40, 50, 60])]
    df = spark.createDataFrame(rows, "frame_index bigint, ms_level int, scan_offsets array<bigint>, tof_indices array<bigint>, intensities array<bigint>")
    out = [tuple(r) for r in expand.explode_frames(df).orderBy("tof_index", "scan_index").select("tof_index", "scan_index", "intensity").collect()]
    assert out == [(1, 0, 10), (1, 2, 50), (2, 0, 20), (2, 2, 60), (3, 1, 30), (4, 1, 40)]
    back = expand.collect_frames(expand.explode_frames(df)).first()
    assert back.scan_offsets == [0, 2, 4, 6] and sorted(zip(back.tof_indices, back.intensities)) == sorted(zip(rows[0][3], rows[0][4]))


def test_trim_and_windows(spark):
    lo, hi = expand.trimmed(F.col("a"), F.col("b"))
    trim = lambda a, b: spark.createDataFrame([(a, b)], "a bigint, b bigint").select(lo, hi).first()
    assert tuple(trim(0, 100)) == (10, 90) and tuple(trim(10, 910)) == (30, 890) and tuple(trim(5, 14)) == (5, 14)
    q = spark.createDataFrame([(3, [0, 100], [100, 200], [400.0, 500.0], [25.0, 30.0], [20.0, 30.0])], "quad_major int, scan_starts array<bigint>, scan_ends array<bigint>, isolation_mz array<double>, isolation_width array<double>, collision_energy array<double>")
    w = expand.quad_windows(q)
    assert [(r.quad_sub, r.isolation_low, r.isolation_high) for r in w.collect()] == [(0, 387.5, 412.5), (1, 485.0, 515.0)]
    f = spark.createDataFrame([(1, 1.0, 1, None, [0, 1], [7], [70]), (2, 2.0, 2, 3, [0] * 96 + [1] * 5, [8], [80]), (3, 3.0, 2, 3, [0] * 51 + [1], [9], [90])], "frame_index bigint, rt double, ms_level int, quad_major int, scan_offsets array<bigint>, tof_indices array<bigint>, intensities array<bigint>")
    out = [tuple(r) for r in expand.expand(f, w).select("ms_level", "quad_major", "quad_sub", "scan_index", "intensity").collect()]
    assert sorted(out, key=str) == [(1, None, None, 0, 70), (2, 3, 0, 50, 90)]
    with pytest.raises(UnsupportedDataError):
        expand.require_ms2(f.filter("ms_level = 1"))


def test_centroid():
    tof = np.array([100, 101, 200, 201, 101, 201])
    ims = np.array([1, 1, 2, 2, 1, 2])
    inten = np.array([1000, 2000, 500, 600, 900, 600])
    ref = np.array([True] * 4 + [False] * 2)
    two, one_ = centroid.absolute(2), centroid.absolute(1)
    t, c, i = centroid.centroid_window(tof, ims, inten, ref, two, one_, np.array([0] * 4 + [1] * 2))
    assert list(zip(t, c, i)) == [(101, 1, 3000), (201, 2, 1100)]
    t, c, i = centroid.centroid_window([100, 200, 102, 202], [1, 2, 1, 2], [1000, 100, 100, 1000], [True, True, False, False], two, one_)
    assert (t[0], c[0], i[0]) == (100, 1, 1000)
    assert len(centroid.centroid_window([], [], [], [], two, one_)[0]) == 0


def test_centroid_window_asks_for_bounds_once_a_value(monkeypatch):
    """Lone peaks are decided together, not each by a visit; crowded ones in order, however few pairs are held."""
    r = np.random.default_rng(0)
    tof, scan, weight = np.arange(0, 30_000, 10), r.integers(0, 5, 3000), r.integers(50, 3000, 3000)
    asked, ref = [], r.random(3000) < 0.5
    t, c, i = centroid.centroid_window(tof, scan, weight, ref, centroid.absolute(2), lambda x: asked.append(x) or (x - 1, x + 1))
    own = ref & (weight >= centroid.LEAST_INTENSITY)
    assert len(asked) == 5 and (t.tolist(), c.tolist(), i.tolist()) == (tof[own].tolist(), scan[own].tolist(), weight[own].tolist())
    # Three in a row: the middle one is heaviest and takes all; a lone one beside another's scans stays alone.
    pool = ([10, 11, 12, 12], [3, 3, 3, 9], [200, 300, 100, 400], [True] * 4)
    for pairs in (1, 2, 1_000_000):
        monkeypatch.setattr(centroid, "PAIRS", pairs, raising=False)
        assert [x.tolist() for x in centroid.centroid_window(*pool, centroid.absolute(2), centroid.absolute(1))] == [[11, 12], [3, 9], [600, 400]]


def test_centroid_frames(spark):
    rows = [(2, 0, 0, f, f * 1.0, 5, 100 + d, 200 - 50 * abs(d)) for f in range(5) for d in (-1, 0, 1)]
    df = spark.createDataFrame(rows, "ms_level int, quad_major int, quad_sub int, frame_index bigint, rt double, scan_index bigint, tof_index bigint, intensity bigint")
    out = centroid.centroid_frames(df, centroid.absolute(2), centroid.absolute(1)).collect()
    assert sorted((r.frame_index, r.tof_index, r.scan_index, r.intensity) for r in out) == [(f, 100, 5, 500) for f in (1, 2, 3)]
    w = centroid.peak_width(df).first()
    assert w.width == 2.0  # the first two frames are never reached backwards


def test_peak_width_sees_weak_peaks_of_crowded_frames(spark):
    """Ten tofs, strong in the sampled frames and weak in the others, where 250 stronger ones lie."""
    rows = [(0, f, f * 0.5, 100 * k, 100_000 if 4 <= f <= 15 else 2000) for f in range(20) for k in range(1, 11)]
    rows += [(0, f, f * 0.5, 10_000 * (f + 1) + 20 * k, 3000) for f in range(20) for k in range(250)] + [(None, f, f * 0.5, 7, 50) for f in range(5)]
    df = spark.createDataFrame(rows, "quad_major int, frame_index bigint, rt double, tof_index bigint, intensity bigint")
    got = {r.quad_major: (r.n_tracks, r.width) for r in centroid.peak_width(df).collect()}
    assert got == {0: (490, 8.5), None: (0, None)}  # frames 2 to 19; a quad without a start has no track


def test_tolerances(spark):
    t = Tolerance.from_json('{"ms":{"Ppm":[15.0,15.0]},"rt":"None","mobility":{"Pct":[10.0,10.0]},"quad":{"Absolute":[0.1,0.1]}}')
    assert t == Tolerance.template() == Tolerance.from_json(t.to_json())
    assert Tolerance.from_json('{"ms":{"Absolute":[1,2]},"mobility":"None","quad":{"Absolute":[0,0]}}').rt.kind == "None"
    for bad in ('{"rt":"None"}', '{"ms":{"Pct":[1,1]},"mobility":"None","quad":{"Absolute":[0,0]}}'):
        with pytest.raises(DataReadingError):
            Tolerance.from_json(bad)
    r = spark.range(1).select(*Tolerance().mz_range(F.lit(1e6)), *Tolerance().rt_range(F.lit(10.0)), *t.rt_range(F.lit(1.0)), *Tolerance(rt=Width("Pct", 10, 20)).rt_range(F.lit(100.0))).first()
    assert tuple(r) == (999980.0, 1000020.0, 5.0, 15.0, None, None, 90.0, 120.0)
    with pytest.raises(Exception, match="above zero"):
        spark.range(1).select(Tolerance().quad_range(F.lit(0.0), F.lit(1.0))[0]).collect()
    cal = Calibration(scan=(1.6, -0.001), tof=(10.0, 0.01), root=True)
    a, b = spark.range(1).select(*scan_window(F.lit(600), 3.0, cal)).first()
    assert a < 600 < b
    a, b = spark.range(1).select(*tof_window(F.lit(1000), 1e6 / 400, cal)).first()
    assert a < 1000 < b


def test_targets(spark):
    g = tg.template_groups(spark, 11)
    assert g.count() == 10
    t = tg.resolve(g, Tolerance.template(), Calibration(scan=(1.6, -0.001), lower_rt=1.0, upper_rt=99.0))
    rows = t.collect()
    assert len(rows) == 110 and sum(r.ms_level == 1 for r in rows) == 10
    assert all(r.scan_lo <= r.scan_hi and r.tof_lo <= r.tof_hi and (r.frame_lo, r.frame_hi) == (1, 99) for r in rows)
    r = tg.random_groups(spark, 50)
    assert r.count() == 49 and r.filter("size(fragment_mzs) <> 10 or rt_seconds > 1320").count() == 0
    lim = tg.precursor_limits(g).first()
    assert lim.low == lim.high


def test_ranked(spark):
    out = one(spark, score.ranked_transitions(F.col("i"), F.col("e")), i=([5, 50, 20], "array<bigint>"), e=([0.1, 0.2, 0.3], "array<double>"))
    assert [tuple(r) for r in out] == [(50, 0.2), (20, 0.3)]
