"""The extraction engine end to end."""

import json

import pytest
from pyspark.sql import functions as F

from peakflow import cli
from peakflow.engine import Centroiding, PeakStore, choose_access
from peakflow.operators import aggregate, centroid, expand, extract, score
from peakflow.plans import fixture as fx
from peakflow.plans.tolerance import Calibration, Tolerance
from peakflow.sources import layout, readers, sinks
from peakflow.streaming import extract as stream

SMALL = "/root/testdata/sf0.01"


def every_fourth(spark):
    """The targets that the known sums are of."""
    return fx.targets(spark, SMALL).filter("eg_id % 4 = 0")


def facts(hits):
    return tuple(hits.agg(F.count(F.lit(1)), F.sum("intensity"), F.countDistinct("eg_id"), F.sum(F.when(F.col("ms_level") == 1, 1))).first())


def test_golden_sums(spark):
    p, t, q = fx.peaks(spark, SMALL), every_fourth(spark), fx.quads(spark)
    assert facts(extract.extract(p, t, q)) == (2821, 2423759, 432, 590)
    assert facts(extract.extract(p, t, q, "tof_major")) == (2748, 2357519, 427, 570)
    assert facts(extract.extract(p, t, q, "raw"))[3] is None
    with pytest.raises(ValueError):
        extract.extract(p, t, q, "other")


def test_plan_has_no_nested_loop_over_peaks(spark, monkeypatch):
    p, t, q = fx.peaks(spark, SMALL), every_fourth(spark), fx.quads(spark)
    plan = lambda: extract.extract(p, t, q)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan() and "PushedFilters" in plan()
    monkeypatch.setattr(extract, "BROADCAST_ROWS", 0)
    assert facts(extract.extract(p, t, q)) == (2821, 2423759, 432, 590)


def test_single_target_and_bin_width(spark, monkeypatch):
    p, t, q = fx.peaks(spark, SMALL), every_fourth(spark), fx.quads(spark)
    best = extract.extract(p, t, q).groupBy("eg_id", "ms_level", "transition_key").count().orderBy(F.desc("count"), "eg_id").first()
    row = t.filter((F.col("eg_id") == best.eg_id) & (F.col("transition_key") == best.transition_key)).first().asDict()
    assert extract.extract_one(p, row, q).count() == best["count"]
    monkeypatch.setattr(extract, "BIN", 3)
    assert facts(extract.extract(p, t, q)) == (2821, 2423759, 432, 590)


def make_run(spark, folder):
    ramp = [(1, 1.0, 1, None), (2, 2.0, 2, 0), (3, 3.0, 1, None), (4, 4.0, 2, 0), (5, 5.0, 1, None), (6, 6.0, 2, 0)]
    rows = [(i, rt, lv, "DIA", 0, q, 1.0, [0] * 21 + [2] * 30, [100, 105], [50 * i, 30 * i]) for i, rt, lv, q in ramp]
    spark.createDataFrame(rows, "frame_index bigint, rt double, ms_level int, acquisition_type string, window_group int, quad_major int, intensity_correction_factor double, scan_offsets array<bigint>, tof_indices array<bigint>, intensities array<bigint>").write.parquet(f"{folder}/frames")
    w = spark.createDataFrame([(0, 0, 0, 50, 100.0, 40.0, 80.0, 120.0, 1.0)], "quad_major int, quad_sub int, scan_start bigint, scan_end bigint, isolation_mz double, isolation_width double, isolation_low double, isolation_high double, collision_energy double")
    w.write.parquet(f"{folder}/windows")
    groups = [{"id": 7, "mobility": 20.0, "rt_seconds": 3.0, "precursor_mzs": [100.0], "fragment_mzs": {"b2": 105.0, "y1": 100.0}, "human_id": "x", "expected_fragment_intensity": {"b2": 2.0}}, {"id": 8, "mobility": 20.0, "rt_seconds": 900.0, "precursor_mzs": [100.0], "fragment_mzs": {"b2": 105.0}}]
    (folder / "groups.json").write_text(json.dumps(groups))
    (folder / "tol.json").write_text(Tolerance().to_json())


def test_cli_round(spark, tmp_path):
    make_run(spark, tmp_path)
    base = ["query-index", "--frames", f"{tmp_path}/frames", "--quad-windows", f"{tmp_path}/windows", "--tolerance-settings-path", f"{tmp_path}/tol.json", "--elution-groups-path", f"{tmp_path}/groups.json"]
    for name in ("raw-peak-intensity", "raw-peak-vector", "multi-cmg-stats"):
        cli.main([*base, "--output-path", f"{tmp_path}/{name}.json", "--aggregator", name], spark)
        out = {r["elution_group"]["id"]: r["result"] for r in json.loads((tmp_path / f"{name}.json").read_text())}
        assert set(out) == {7, 8}
        if name == "raw-peak-intensity":
            assert out[7]["intensity"] == sum(50 * i for i in (1, 3, 5)) + sum(80 * i for i in (2, 4, 6)) and out[8]["intensity"] == 0
        if name == "raw-peak-vector":
            assert len(out[7]["scans"]) == 9 and out[8]["scans"] == []
        if name == "multi-cmg-stats":
            assert len(out[7]["cross_ms2"]) == 3 and out[8] is None
    cli.main(["write-template", "--output-path", str(tmp_path / "t"), "--num-elution-groups", "5"], spark)
    assert readers.read_elution_groups(spark, str(tmp_path / "t/elution_groups.json")).count() == 4
    assert readers.read_tolerance(str(tmp_path / "t/tolerance_settings.json"), spark) == Tolerance.template()
    for fmt in ("json", "parquet"):
        cli.main([*base, "--output-path", f"{tmp_path}/out-{fmt}", "--format", fmt, "--index", "transposed-quad-index"], spark)
    assert spark.read.parquet(f"{tmp_path}/out-parquet").count() == 2
    assert choose_access(3) == "frame_major" and choose_access(11) == "tof_major"


def test_readers_and_layouts(spark, tmp_path):
    make_run(spark, tmp_path)
    assert readers.read_frames(spark, f"{tmp_path}/frames", 2, 4).count() == 2
    assert readers.read_frames(spark, f"{tmp_path}/frames", ms_level=2).count() == 3
    frames = readers.read_frames(spark, f"{tmp_path}/frames")
    bad = frames.limit(1).withColumn("intensities", F.array(F.lit(1).cast("bigint")))
    ok, broken = readers.good_frames(frames.unionByName(bad).unionByName(frames.limit(1).withColumn("scan_offsets", F.lit(None).cast("array<bigint>"))))
    assert ok.count() == 6 and broken.count() == 2
    peaks = expand.expand(frames, readers.read_quad_windows(spark, f"{tmp_path}/windows"))
    for name in layout.SORTS:
        layout.write_peaks(peaks, f"{tmp_path}/{name}", name, 2)
        assert sorted(map(str, readers.read_peaks(spark, f"{tmp_path}/{name}").collect())) == sorted(map(str, peaks.select(*readers.schemas.PEAK_COLUMNS).collect()))
    layout.write_bucketed(peaks, "bucketed_peaks", 2)
    assert spark.table("bucketed_peaks").count() == peaks.count()
    info = {r.quad_major: r for r in expand.slice_info(peaks).collect()}
    assert info[None].n_frames == 3 and info[0].n_peaks == 6
    spark.createDataFrame([("a", "1")], "x string, y string").write.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv")
    assert readers.read_tsv(spark, f"{tmp_path}/tsv").first().y == "1"
    store = PeakStore.from_frames(frames, readers.read_quad_windows(spark, f"{tmp_path}/windows"), centroiding=Centroiding())
    assert store.peaks.count() == 0 and set(store.peaks.columns) == set(peaks.columns)  # indices too small for the default widths


def test_custom_aggregator_and_compat(spark, tmp_path):
    make_run(spark, tmp_path)
    store = PeakStore.from_frames(readers.read_frames(spark, f"{tmp_path}/frames"), readers.read_quad_windows(spark, f"{tmp_path}/windows"), Calibration())
    groups = readers.read_elution_groups(spark, f"{tmp_path}/groups.json")
    assert store.query(groups, aggregator=lambda hits, targets: hits.groupBy("eg_id").agg(F.max("intensity").alias("top"))).first().top == 300
    hits = extract.extract(fx.peaks(spark, SMALL), every_fourth(spark), fx.quads(spark))
    exact, compat = aggregate.chromatograms(hits), aggregate.chromatograms(hits, "compat")
    keys = ["eg_id", "ms_level", "transition_key", "rt_ms"]
    assert exact.join(compat.withColumnRenamed("intensity", "i2"), keys).filter("intensity <> i2").count() == 0 and exact.count() == compat.count()
    with pytest.raises(ValueError):
        store.query(groups, aggregator="other")


def test_physical_units_and_apex(spark, tmp_path):
    make_run(spark, tmp_path)
    cal = Calibration(scan=(1.6, -0.001), tof=(0.0, 2.0), lower_im=0.5, upper_im=1.6)
    store = PeakStore.from_frames(readers.read_frames(spark, f"{tmp_path}/frames"), readers.read_quad_windows(spark, f"{tmp_path}/windows"), cal)
    row = {"id": 1, "mobility": 1.58, "rt_seconds": 3.0, "precursor_mzs": [200.0], "fragment_mzs": {"y1": 200.0, "b2": 210.0}, "expected_fragment_intensity": {"y1": 5.0, "b2": 3.0}, "expected_precursor_intensity": [1.0]}
    groups = spark.createDataFrame([row], readers.schemas.ELUTION_GROUPS)
    store.windows = store.windows.withColumns({"isolation_low": F.lit(180.0), "isolation_high": F.lit(220.0)})
    out = store.query(groups, Tolerance(), "multi-cmg-stats")
    r = out.first()
    assert set(r.ms2.transition_mzs) == {"y1", "b2"} and r.ms2.transition_mzs["b2"] == [210.0] * 3 and r.ms2.expected_mzs["y1"] == 200.0
    assert all(abs(x - 1.58) < 1e-9 for x in r.ms2.average_mobility) and abs(r.ms2.expected_mobility - 1.58) < 2e-3  # the index is truncated
    a = score.apex_scores(out).first()
    assert a.ms2_errors.mz_errors == {"y1": 0.0, "b2": 0.0} and a.ms1_errors.transition_intensities["0"] > 0


def test_json_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [float("inf"), 1.0])], "a int, b double, c array<double>")
    sinks.write_json(df, f"{tmp_path}/x")
    assert "NaN" not in "".join(r.value for r in spark.read.text(f"{tmp_path}/x").collect())
    sinks.write_report(df, f"{tmp_path}/y.json")
    assert json.loads((tmp_path / "y.json").read_text()) == [{"a": 1, "b": None, "c": [None, 1.0]}]


def test_stream(spark, tmp_path):
    fx.peaks(spark, SMALL).repartition(2).write.parquet(f"{tmp_path}/p")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/p").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p")
    q = stream.start(stream.intensity_stream(src, every_fourth(spark), fx.quads(spark)), "sums", f"{tmp_path}/c")
    q.awaitTermination(120)
    assert spark.table("sums").agg(F.sum("intensity")).first()[0] == 2423759


def test_json_has_no_nan_in_structs(spark, tmp_path):
    kind = "a int, s struct<x:double,l:array<struct<y:float>>>, m map<string,double>"
    df = spark.createDataFrame([(1, (float("nan"), [(float("inf"),), (2.0,)]), {"k": float("-inf"), "j": 1.0}), (2, None, None)], kind)
    assert sinks.json_safe(df).schema.simpleString() == df.schema.simpleString()
    sinks.write_json(df, f"{tmp_path}/x")
    rows = {r["a"]: r for r in (json.loads(x.value) for x in spark.read.text(f"{tmp_path}/x").collect())}
    assert rows[1]["s"] == {"l": [{}, {"y": 2.0}]} and rows[1]["m"] == {"k": None, "j": 1.0} and "s" not in rows[2]


def test_two_runs_are_the_union_of_each(spark):
    """Peaks, windows and results of two runs in one table equal those of each run alone."""
    shift = {"a": 0, "b": 7}
    peaks = {k: fx.peaks(spark, SMALL).withColumn("intensity", F.col("intensity") + v).filter(F.col("frame_index") % 3 != v % 3) for k, v in shift.items()}
    windows = {k: fx.quads(spark).withColumn("isolation_high", F.col("isolation_high") + v) for k, v in shift.items()}
    targets = fx.targets(spark, SMALL)
    both = lambda parts: parts["a"].withColumn("run_id", F.lit("a")).unionByName(parts["b"].withColumn("run_id", F.lit("b")))
    expected = targets.select("eg_id", "ms_level", "transition_key", "expected_intensity")

    def results(p, w):
        hits = extract.extract(p, targets, w)
        cmg = aggregate.chromatograms(hits)
        crossed = score.cross_scores(score.scored(aggregate.rt_summary(cmg, expected)))
        apex = score.apex_scores(crossed).select(*(["run_id"] if "run_id" in crossed.columns else []), "eg_id", "apex_rt_ms", F.round("cross_score", 6).alias("x"))
        raw = extract.extract(p, targets, w, "raw").drop("rt_lo", "rt_hi")
        return [hits, raw, aggregate.zero_filled(aggregate.intensity_sum(hits), targets), aggregate.densified(cmg).select(*[c for c in cmg.columns if c in ("run_id", "eg_id", "ms_level", "transition_key", "rt_ms", "intensity")]), apex, centroid.centroid_frames(p.filter("frame_index < 60"), centroid.absolute(2), centroid.absolute(2)), centroid.peak_width(p)]

    together = results(both(peaks), both(windows))
    alone = {k: results(peaks[k], windows[k]) for k in shift}
    for i, got in enumerate(together):
        for k in shift:
            mine = got.filter(F.col("run_id") == k).drop("run_id")
            assert sorted(map(str, mine.select(alone[k][i].columns).collect())) == sorted(map(str, alone[k][i].collect())), (i, k)


def test_many_windows_meet_in_bins(spark, monkeypatch):
    q, made = fx.quads(spark), every_fourth(spark)
    targets = spark.createDataFrame(made.collect(), made.schema)
    few, many = extract.matching_quads(targets, q, True), extract.matching_quads(targets, q, False)
    assert "BroadcastNestedLoopJoin" not in many._jdf.queryExecution().toString() and "CartesianProduct" not in many._jdf.queryExecution().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() > 0


def naive_centroids(peaks, width, reach):
    """Every window of frames centroided from the definition, one peak at a time."""
    frames = {}
    for r in peaks:
        frames.setdefault((r.ms_level, r.quad_major, r.quad_sub), {}).setdefault((r.rt, r.frame_index), []).append((r.tof_index, r.scan_index, r.intensity))
    out = []
    for quad, by in frames.items():
        order = sorted(by)
        for w in range(len(order) - width + 1):
            middle = order[w + width // 2]
            pool = sorted((t, s, f[1], i, f == middle) for f in order[w : w + width] for t, s, i in by[f])
            taken = set()
            for k, (t, s, _, i, _) in enumerate(pool):
                near = [j for j, x in enumerate(pool) if j not in taken and t - reach <= x[0] < t + reach and s - reach <= x[1] <= s + reach]
                if k in taken or any(pool[j][3] > i for j in near):
                    continue
                total = sum(pool[j][3] for j in near if pool[j][4])
                if total >= centroid.LEAST_INTENSITY:
                    taken |= set(near)
                    out.append((*quad, middle[1], middle[0], s, t, total))
    return out


def test_centroids_equal_the_definition(spark, monkeypatch):
    peaks = fx.peaks(spark, "/root/testdata/sf0.001").filter("frame_index between 300 and 500").withColumns({"tof_index": F.col("tof_index") % 40, "scan_index": F.col("scan_index") % 8})
    want = sorted(map(str, naive_centroids(peaks.collect(), 3, 2)))
    assert len(want) > 100
    for most in (2_000_000, 3):
        monkeypatch.setattr(centroid, "PEAKS_A_GROUP", most)
        got = centroid.centroid_frames(peaks, centroid.absolute(2), centroid.absolute(2))
        assert sorted(str(tuple(r)) for r in got.select("ms_level", "quad_major", "quad_sub", "frame_index", "rt", "scan_index", "tof_index", "intensity").collect()) == want


def naive_width(rows, samples=49, tops=10, least=100, apart=5):
    """Widths of one quad's peaks, tracked over all of its frames."""
    frames = {}
    for r in rows:
        held = frames.setdefault((r.frame_index, r.rt), {})
        held[r.tof_index] = held.get(r.tof_index, 0) + r.intensity
    order = sorted(frames)
    n, widths = len(order), []
    for k in range(samples):
        at = int(n * (0.2 + 0.6 * k / samples))
        if at >= n:
            continue
        best = sorted(((i, t) for t, i in frames[order[at]].items() if i > least), reverse=True)[:tops]
        chosen = []
        for t in sorted(t for _, t in best):
            if not chosen or t - chosen[-1] > apart:
                chosen.append(t)
        for t in chosen:
            ends = []
            for step, stop in ((1, n), (-1, 1)):
                j, misses, last = at, 0, at
                while misses < 2 and j + step != stop and 0 <= j + step < n:
                    j += step
                    if sum(frames[order[j]].get(t + d, 0) for d in (-1, 0, 1)) <= frames[order[at]][t] / 100:
                        misses += 1
                    else:
                        misses, last = 0, j
                ends.append(order[last][1])
            widths.append(ends[0] - ends[1])
    widths.sort()
    return len(widths), widths[len(widths) // 2] if widths else None


def test_peak_widths_equal_the_definition(spark):
    peaks = fx.peaks(spark, "/root/testdata/sf0.001").withColumn("tof_index", F.col("tof_index") % 25)
    rows = peaks.collect()
    want = {q: naive_width([r for r in rows if r.quad_major == q]) for q in {r.quad_major for r in rows}}
    assert {r.quad_major: (r.n_tracks, r.width) for r in centroid.peak_width(peaks).collect()} == want
    assert any(w for _, w in want.values())


def test_layouts_are_sorted_by_as_many_tasks_as_peaks_need(spark, tmp_path, monkeypatch):
    peaks = fx.peaks(spark, "/root/testdata/sf0.001").cache()
    monkeypatch.setattr(layout, "TASK_ROWS", 1000, raising=False)
    for name in layout.SORTS:
        layout.write_peaks(peaks, f"{tmp_path}/{name}", name)
        tasks = {f.name.split("-")[1] for f in (tmp_path / name).rglob("part-*.parquet")}
        assert len(tasks) >= peaks.count() // 1000 >= 5
        back = readers.read_peaks(spark, f"{tmp_path}/{name}")
        assert back.exceptAll(peaks.select(back.columns)).isEmpty() and back.count() == peaks.count()


def test_expected_values_are_merged_not_broadcast(spark):
    """They are as many as targets, whatever the size of their file."""
    cmg = spark.createDataFrame([(1, 2, k, 5, 10 * n, 3.0) for n, k in enumerate("ab", 1)], "eg_id bigint, ms_level int, transition_key string, rt_ms bigint, intensity bigint, scan_mean double")
    expected = spark.createDataFrame([(1, 2, k, float(n)) for n, k in enumerate("abc", 1)], "eg_id bigint, ms_level int, transition_key string, expected_intensity double")
    for c, e in ((cmg, expected), (cmg.withColumn("run_id", F.lit(1)), expected.withColumn("run_id", F.lit(1)))):
        out = aggregate.rt_summary(c, e)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert round(out.first().cosine, 9) == 1.0


def test_scores_deal_matches_out_by_group_once(spark, monkeypatch):
    """To as many tasks as the input needs, whatever the session's number; same summary as by a join of expected values."""
    from peakflow import registry

    d, summary = "/root/testdata/sf0.001", lambda df: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}
    monkeypatch.setattr(aggregate, "TASK_ROWS", 500, raising=False)
    for name in ("hyperscore", "lazyerscore", "score_bundle", "scores_at_rt_asof"):
        plan = registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(eg_id" in line]
        assert len(dealt) == 1 and "SortMergeJoin" not in plan
    rows = fx.peaks(spark, d).count() + fx.targets(spark, d).count()
    assert f", {-(-rows // 500)})" in dealt[0]
    for hits in (registry._hits(spark, d), registry._hits(spark, d).withColumn("run_id", F.col("scan_index") % 2)):
        want = aggregate.rt_summary(aggregate.chromatograms(hits), fx.targets(spark, d).select("eg_id", "ms_level", "transition_key", "expected_intensity"))
        assert summary(aggregate.group_summary(hits, rows)) == summary(want)


def test_hulls_of_few_windows_gather_no_targets(spark):
    """Same hulls as by grouping, of quads with several windows and with runs, and no sums over targets on the way."""
    t = spark.createDataFrame([(k, 2, 100.0 + k, 101.0 + k, 3 * k, 3 * k + 30) for k in range(20)] + [(99, 1, 0.0, 999.0, 0, 99)], "eg_id bigint, ms_level int, iso_lo double, iso_hi double, scan_lo bigint, scan_hi bigint")
    w = spark.createDataFrame([(q, s, 40 * s, 40 * s + 20, 95.0 + 5 * q + 4 * s, 104.0 + 5 * q + 4 * s) for q in range(3) for s in range(3)], "quad_major int, quad_sub int, scan_start bigint, scan_end bigint, isolation_low double, isolation_high double")
    runs = spark.createDataFrame([(1,), (2,), (None,)], "run_id int")
    for a, b in ((t, w), (t, w.crossJoin(runs)), (t.crossJoin(runs), w.crossJoin(runs)), (t.crossJoin(runs), w)):
        want, got = extract.quad_hulls(extract.matching_quads(a, b, True)), extract.few_hulls(a, b)
        assert sorted(want.columns) == sorted(got.columns)
        rows = sorted(map(str, got.select(want.columns).collect()))
        assert rows == sorted(map(str, want.collect())) and len(rows) > 30
    ranges = {"tof_lo": F.lit(0), "tof_hi": F.lit(9), "frame_lo": F.lit(0), "frame_hi": F.lit(9)}
    plan = extract._planned(t.withColumns(ranges), w, "raw", True)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "eg_id" in x]
