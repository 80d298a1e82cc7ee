"""Queries of the extraction engine over the driver's tables, with SQL twins.

Each query applies the operators it is named for to whole tables and rounds
floats to six places, so that values of both engines compare.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import scalars as s
from .operators import aggregate as agg
from .operators import align, centroid, expand, extract, score
from .plans import fixture as fx
from .plans.tolerance import Calibration, Tolerance

_EMB, _EMB_ID = "embedding", "vec_id"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_PEAKS = """peaks AS (SELECT CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS ms_level, CASE WHEN l_linenumber > 1 THEN l_linenumber::INTEGER - 2 END AS quad,
  date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))::BIGINT AS frame_index, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 0.5::DOUBLE AS rt,
  (l_suppkey % 100)::BIGINT AS scan_index, l_partkey::BIGINT AS tof_index, CAST(l_quantity * l_quantity AS BIGINT) AS intensity FROM lineitem)"""
_QUADS = """quads AS (SELECT q AS quad, q * 15 AS scan_start, q * 15 + 30 AS scan_end, 891.0 + 18 * q AS isolation_low, 911.0 + 18 * q AS isolation_high FROM (VALUES (0),(1),(2),(3),(4),(5)) t(q))"""
_TARGETS = """targets AS (SELECT p_partkey::BIGINT AS eg_id, CASE WHEN k < 0 THEN 1 ELSE 2 END AS ms_level, k::VARCHAR AS transition_key, (p_partkey + 37 * (k + 1)) % n - 2 AS tof_lo, (p_partkey + 37 * (k + 1)) % n + 2 AS tof_hi,
  p_partkey % 100 - 20 AS scan_lo, p_partkey % 100 + 20 AS scan_hi, p_size * 40 - 200 AS frame_lo, p_size * 40 + 200 AS frame_hi, p_retailprice::DOUBLE - 0.1::DOUBLE AS iso_lo, p_retailprice::DOUBLE + 0.1::DOUBLE AS iso_hi, (k + 2)::DOUBLE AS expected_intensity
  FROM part CROSS JOIN (SELECT count(*) AS n FROM part) c CROSS JOIN (VALUES (-1),(0),(1),(2),(3),(4)) t(k))"""
_HITS = """hits AS (SELECT t.eg_id, t.ms_level, t.transition_key, t.expected_intensity, p.quad, p.frame_index, p.rt, p.scan_index, p.tof_index, p.intensity FROM targets t JOIN peaks p ON p.ms_level = t.ms_level
  AND p.tof_index BETWEEN t.tof_lo AND t.tof_hi AND p.frame_index BETWEEN t.frame_lo AND t.frame_hi AND p.scan_index >= t.scan_lo AND p.scan_index {upper} t.scan_hi LEFT JOIN quads q ON q.quad = p.quad
  WHERE t.ms_level = 1 OR (q.isolation_low <= t.iso_hi AND q.isolation_high >= t.iso_lo AND q.scan_end >= t.scan_lo AND q.scan_start <= t.scan_hi))"""
_BASE = ", ".join([_PEAKS, _QUADS, _TARGETS, _HITS.format(upper="<=")])
_CMG = """cmg AS (SELECT eg_id, ms_level, transition_key, any_value(expected_intensity) AS expected_intensity, CAST(trunc(CAST(rt AS FLOAT) * 1000::FLOAT) AS BIGINT) AS rt_ms, sum(intensity)::BIGINT AS intensity,
  sum(scan_index * intensity::DOUBLE) / sum(intensity::DOUBLE) AS scan_mean, sum(tof_index * intensity::DOUBLE) / sum(intensity::DOUBLE) AS tof_mean,
  sum(scan_index::DOUBLE * scan_index * intensity::DOUBLE) / sum(intensity::DOUBLE) AS scan_sq, sum(tof_index::DOUBLE * tof_index * intensity::DOUBLE) / sum(intensity::DOUBLE) AS tof_sq
  FROM hits GROUP BY eg_id, ms_level, transition_key, CAST(trunc(CAST(rt AS FLOAT) * 1000::FLOAT) AS BIGINT))"""
_SUMMARY = """seen AS (SELECT eg_id, ms_level, sum(e * e) AS ee FROM (SELECT DISTINCT eg_id, ms_level, transition_key, expected_intensity AS e FROM cmg) GROUP BY ALL),
 summary AS (SELECT c.eg_id, c.ms_level, rt_ms, sum(intensity)::BIGINT AS summed_intensity, sum(CASE WHEN intensity > 100 THEN 1 ELSE 0 END)::INTEGER AS npeaks, sum(CASE WHEN intensity > 10 THEN ln(intensity::DOUBLE) ELSE 0 END) AS log_intensity,
  sum(scan_mean * intensity) / sum(intensity::DOUBLE) AS scan_mean, sum(intensity::DOUBLE * expected_intensity) / (sqrt(sum(intensity::DOUBLE * intensity)) * sqrt(any_value(ee))) AS cosine
  FROM cmg c JOIN seen USING (eg_id, ms_level) GROUP BY c.eg_id, c.ms_level, rt_ms)"""
_LNFACT = "(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE ELSE {x} * ln({x}) - {x} + ln({x}) / 2 + ln(2 * pi() * {x}) / 2 END)"
_LNFLOAT = "(CASE WHEN {x} < 1 THEN 0.0::DOUBLE ELSE {x} * ln({x}) - {x} + ln({x}) / 2 + ln(2 * pi() * {x}) / 2 END)"
_SCORED = (
    """lists AS (SELECT eg_id, ms_level, list(rt_ms ORDER BY rt_ms) AS ts, list(cosine ORDER BY rt_ms) AS cs, list(lz ORDER BY rt_ms) AS lz, count(*)::INTEGER AS n FROM (SELECT *, """
    + _LNFLOAT.format(x="log_intensity")
    + """ AS lz FROM summary) GROUP BY eg_id, ms_level),
 based AS (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i - (w - 1 - w // 2) < 1 OR i + w // 2 > n THEN 0.0::DOUBLE ELSE lz[i] - list_sort(lz[(i - (w - 1 - w // 2)):(i + w // 2)])[w // 2 + 1] END) AS vb FROM (SELECT *, 1 + n // 20 AS w FROM lists)),
 rows_ AS (SELECT eg_id, ms_level, unnest(ts) AS t, unnest(cs) AS c, unnest(vb) AS v, unnest(range(0, n)) AS i FROM based)"""
)
_NEAREST = """near AS (SELECT x.eg_id, x.ms_level, x.t AS t0, x.c, x.v, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN x.t - lo < hi - x.t THEN lo ELSE hi END AS t FROM
  (SELECT o.*, (SELECT max(r.t) FROM rows_ r WHERE r.eg_id = o.eg_id AND r.ms_level = 3 - o.ms_level AND r.t <= o.t) AS lo, (SELECT min(r.t) FROM rows_ r WHERE r.eg_id = o.eg_id AND r.ms_level = 3 - o.ms_level AND r.t > o.t) AS hi FROM rows_ o) x),
 crossed AS (SELECT r.eg_id, r.ms_level, r.t AS rt_ms, r.i, CASE WHEN max(n.c) IS NULL OR max(n.v) IS NULL THEN 0.0::DOUBLE ELSE r.c * max(n.c) * max(n.v) END AS score FROM rows_ r LEFT JOIN near n ON n.eg_id = r.eg_id AND n.ms_level = 3 - r.ms_level AND n.t = r.t
  WHERE EXISTS (SELECT 1 FROM lists l WHERE l.eg_id = r.eg_id AND l.ms_level = 3 - r.ms_level) GROUP BY r.eg_id, r.ms_level, r.t, r.i, r.c)"""


def query(sql: str | None = None):
    """Register a query and its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, places: int = 6):
    return F.round(c, places)


def _hits(spark, d, access="frame_major"):
    return extract.extract(fx.peaks(spark, d), fx.targets(spark, d), fx.quads(spark), access)


def _cmg(spark, d):
    return agg.chromatograms(_hits(spark, d))


def _summary(spark, d):
    return agg.group_summary(_hits(spark, d), fx.peaks(spark, d).count() + fx.targets(spark, d).count())


@query(f"WITH {_BASE} SELECT eg_id, sum(intensity)::BIGINT AS intensity FROM hits GROUP BY eg_id")
def extract_intensity_sum(spark, d):
    return agg.intensity_sum(_hits(spark, d))


@query(f"WITH {_BASE} SELECT t.eg_id, coalesce(sum(h.intensity), 0)::BIGINT AS intensity FROM (SELECT DISTINCT eg_id FROM targets) t LEFT JOIN hits h USING (eg_id) GROUP BY t.eg_id")
def extract_zero_filled(spark, d):
    return agg.zero_filled(agg.intensity_sum(_hits(spark, d)), fx.targets(spark, d))


@query("WITH " + ", ".join([_PEAKS, _QUADS, _TARGETS, _HITS.format(upper="<")]) + " SELECT eg_id, ms_level, count(*) AS n, sum(intensity)::BIGINT AS intensity FROM hits GROUP BY eg_id, ms_level")
def extract_halfopen_scan(spark, d):
    return _hits(spark, d, "tof_major").groupBy("eg_id", "ms_level").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))


@query(
    f"""WITH {_PEAKS}, {_QUADS}, {_TARGETS} SELECT t.eg_id, count(*) AS n, sum(p.intensity)::BIGINT AS intensity FROM targets t JOIN quads q
  ON q.isolation_low <= t.iso_hi AND q.isolation_high >= t.iso_lo AND q.scan_end >= t.scan_lo AND q.scan_start <= t.scan_hi
  JOIN peaks p ON p.quad = q.quad AND p.tof_index >= t.tof_lo AND p.tof_index < t.tof_hi AND p.frame_index >= t.frame_lo AND p.frame_index < t.frame_hi
  AND p.scan_index >= greatest(t.scan_lo, q.scan_start) AND p.scan_index < least(t.scan_hi, q.scan_end) WHERE t.ms_level = 2 GROUP BY t.eg_id"""
)
def extract_raw_hull(spark, d):
    return _hits(spark, d, "raw").groupBy("eg_id").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))


@query(
    f"WITH {_QUADS}, {_TARGETS} SELECT t.eg_id, q.quad AS quad_major, count(*) AS n FROM targets t JOIN quads q ON q.isolation_low <= t.iso_hi AND q.isolation_high >= t.iso_lo AND q.scan_end >= t.scan_lo AND q.scan_start <= t.scan_hi WHERE t.ms_level = 2 GROUP BY ALL"
)
def quad_overlap_join(spark, d):
    return extract.matching_quads(fx.targets(spark, d), fx.quads(spark)).groupBy("eg_id", "quad_major").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BASE} SELECT ms_level, transition_key, count(*) AS n, sum(intensity)::BIGINT AS intensity FROM hits GROUP BY ALL")
def ms_level_union(spark, d):
    return _hits(spark, d).groupBy("ms_level", "transition_key").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))


@query(
    """SELECT p_partkey AS id, round(m - m * 15.0 / 1e6, 6) AS mz_lo, round(m + m * 15.0 / 1e6, 6) AS mz_hi, round(CAST(s - s * 10::FLOAT / 100::FLOAT AS DOUBLE), 4) AS im_lo, round(CAST(s + s * 10::FLOAT / 100::FLOAT AS DOUBLE), 4) AS im_hi, round(m - 0.1, 2) AS iso_lo, round(m + 0.1, 2) AS iso_hi
  FROM (SELECT p_partkey, p_retailprice::DOUBLE AS m, p_size::FLOAT AS s FROM part)"""
)
def tolerance_ranges(spark, d):
    tol = Tolerance.template()
    m, size = F.col("p_retailprice").cast("double"), F.col("p_size").cast("float")
    mz, im, iso = tol.mz_range(m), tol.mobility_range(size), tol.quad_range(m, m)
    cols = {"mz_lo": _r(mz[0]), "mz_hi": _r(mz[1]), "im_lo": _r(im[0].cast("double"), 4), "im_hi": _r(im[1].cast("double"), 4), "iso_lo": _r(iso[0].cast("double"), 2), "iso_hi": _r(iso[1].cast("double"), 2)}
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[v.alias(k) for k, v in cols.items()])


@query(f"WITH {_BASE} SELECT eg_id, scan_index AS scan, tof_index AS tof, intensity, rt FROM hits")
def raw_peak_vectors(spark, d):
    v = agg.peak_vectors(_hits(spark, d))
    x = F.explode(F.arrays_zip("scans", "tofs", "intensities", "retention_times")).alias("x")
    return v.select("eg_id", x).select("eg_id", F.col("x.scans").alias("scan"), F.col("x.tofs").alias("tof"), F.col("x.intensities").alias("intensity"), F.col("x.retention_times").alias("rt"))


@query(
    f"""WITH {_BASE}, {_CMG} SELECT eg_id, ms_level, transition_key, rt_ms, intensity, round(scan_mean, 6) AS scan_mean, round(sqrt(greatest(scan_sq - scan_mean * scan_mean, 0)), 3) AS scan_sd, round(tof_mean, 6) AS tof_mean, round(sqrt(greatest(tof_sq - tof_mean * tof_mean, 0)), 3) AS tof_sd FROM cmg"""
)
def chromatogram_weighted_stats(spark, d):
    c = _cmg(spark, d)
    return c.select("eg_id", "ms_level", "transition_key", "rt_ms", "intensity", *[_r(F.col(k), 6 if k.endswith("mean") else 3).alias(k) for k in ("scan_mean", "scan_sd", "tof_mean", "tof_sd")])


@query(f"WITH {_BASE}, {_CMG}, {_SUMMARY} SELECT eg_id, ms_level, rt_ms, summed_intensity, npeaks, round(log_intensity, 6) AS log_intensity, round(scan_mean, 6) AS scan_mean FROM summary")
def chromatogram_rt_summary(spark, d):
    return agg.rt_summary(_cmg(spark, d)).select("eg_id", "ms_level", "rt_ms", "summed_intensity", "npeaks", _r(F.col("log_intensity")).alias("log_intensity"), _r(F.col("scan_mean")).alias("scan_mean"))


@query(
    f"""WITH {_BASE}, {_CMG} SELECT k.eg_id, k.ms_level, k.transition_key, r.rt_ms, coalesce(c.intensity, 0)::BIGINT AS intensity, round(c.scan_mean, 6) AS scan_mean
  FROM (SELECT DISTINCT eg_id, ms_level, transition_key FROM cmg) k JOIN (SELECT DISTINCT eg_id, ms_level, rt_ms FROM cmg) r ON r.eg_id = k.eg_id AND r.ms_level = k.ms_level
  LEFT JOIN cmg c ON c.eg_id = k.eg_id AND c.ms_level = k.ms_level AND c.transition_key = k.transition_key AND c.rt_ms = r.rt_ms"""
)
def densified_grid(spark, d):
    return agg.densified(_cmg(spark, d)).select("eg_id", "ms_level", "transition_key", "rt_ms", "intensity", _r(F.nanvl("scan_mean", F.lit(None).cast("double"))).alias("scan_mean"))


@query(f"WITH {_BASE}, {_CMG} SELECT eg_id, ms_level, transition_key, rt_ms, round(1.6 - 0.001 * scan_mean, 6) AS mobility, round((10 + 0.01 * tof_mean) * (10 + 0.01 * tof_mean), 5) AS mz FROM cmg")
def physical_units(spark, d):
    maps = score.transition_maps(agg.densified(_cmg(spark, d)), Calibration(scan=(1.6, -0.001), tof=(10.0, 0.01), root=True), times=True)
    joined = maps.select("eg_id", "ms_level", F.col("rt_ms").alias("t"), F.explode("transition_mobilities").alias("transition_key", "im"), F.col("transition_mzs").alias("m"))
    rows = joined.select("eg_id", "ms_level", "transition_key", F.explode(F.arrays_zip(F.col("t"), F.col("im"), F.element_at("m", F.col("transition_key")).alias("mz"))).alias("x")).filter("not isnan(x.im)")
    return rows.select("eg_id", "ms_level", "transition_key", F.col("x.t").alias("rt_ms"), _r(F.col("x.im")).alias("mobility"), _r(F.col("x.mz"), 5).alias("mz"))


@query(f"WITH {_BASE}, {_CMG}, {_SUMMARY} SELECT eg_id, ms_level, rt_ms, round(cosine, 6) AS cosine FROM summary")
def cosine_per_rt(spark, d):
    return _summary(spark, d).select("eg_id", "ms_level", "rt_ms", _r(F.col("cosine")).alias("cosine"))


@query(f"WITH {_BASE}, {_CMG}, {_SUMMARY} SELECT eg_id, ms_level, rt_ms, round({_LNFACT.format(x='npeaks::DOUBLE')} + 2 * ln(summed_intensity + 1.0::DOUBLE), 6) AS hyperscore FROM summary")
def hyperscore(spark, d):
    return _summary(spark, d).select("eg_id", "ms_level", "rt_ms", _r(s.hyperscore(F.col("npeaks"), F.col("summed_intensity"))).alias("hyperscore"))


@query(f"WITH {_BASE}, {_CMG}, {_SUMMARY} SELECT eg_id, ms_level, rt_ms, round({_LNFLOAT.format(x='log_intensity')}, 6) AS lazyerscore FROM summary")
def lazyerscore(spark, d):
    return _summary(spark, d).select("eg_id", "ms_level", "rt_ms", _r(s.lazyerscore(F.col("log_intensity"))).alias("lazyerscore"))


_SERIES = "SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"


def _series(spark, d):
    e = fx.table(spark, d, "events").withColumn("value", F.col("value").cast("double"))
    p = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    return e.groupBy("user_id").agg(p.alias("p")).select("user_id", F.transform("p", lambda x: x["value"]).alias("v"))


@query(
    f"""WITH l AS (SELECT user_id, list(value::DOUBLE ORDER BY i) AS v, count(*)::INTEGER AS n FROM ({_SERIES}) GROUP BY user_id), w AS (SELECT *, 1 + n // 20 AS w FROM l),
  m AS (SELECT user_id, unnest(v) AS value, unnest(list_transform(range(1, n + 1), lambda i: CASE WHEN i - (w - 1 - w // 2) < 1 OR i + w // 2 > n THEN NULL ELSE list_sort(v[(i - (w - 1 - w // 2)):(i + w // 2)])[w // 2 + 1] END)) AS med, unnest(range(0, n))::INTEGER AS i FROM w)
  SELECT user_id, i, round(coalesce(value - med, 0), 6) AS vs_baseline FROM m"""
)
def rolling_median_baseline(spark, d):
    x = _series(spark, d).select("user_id", F.posexplode(s.nan_to_zero(s.vs_baseline(F.col("v"), s.baseline_window(F.size("v"))))).alias("i", "x"))
    return x.select("user_id", "i", _r(F.col("x")).alias("vs_baseline"))


@query(
    """SELECT id, i, round(CASE WHEN c = 3 THEN CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE ab / (sqrt(na) * sqrt(nb)) END END, 5) AS cosine FROM (SELECT id, i::INTEGER AS i, sum(a * b) OVER w AS ab, sum(a * a) OVER w AS na, sum(b * b) OVER w AS nb, count(*) OVER w AS c FROM
  (SELECT id, unnest(e)::DOUBLE AS a, unnest(list_reverse(e))::DOUBLE AS b, unnest(range(0, len(e))) AS i FROM (SELECT {id} AS id, {vec} AS e FROM embeddings)) WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
)
def rolling_cosine_exact(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col(_EMB_ID).alias("id"), F.transform(_EMB, lambda x: x.cast("double")).alias("e"))
    x = e.select("id", F.posexplode(s.rolling_cosine(F.col("e"), F.reverse("e"), 3)).alias("i", "x"))
    return x.select("id", "i", _r(F.nanvl("x", F.lit(None).cast("double")), 5).alias("cosine"))


_REFS = """refs AS (SELECT DISTINCT user_id, epoch_us(date_trunc('day', ts)) / 1e6 AS x FROM events),
 near AS (SELECT user_id, value, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN x - lo < hi - x THEN lo ELSE hi END AS x FROM (SELECT e.user_id, e.value::DOUBLE AS value, epoch_us(e.ts) / 1e6 AS x,
  (SELECT max(r.x) FROM refs r WHERE r.user_id = e.user_id AND r.x <= epoch_us(e.ts) / 1e6) AS lo, (SELECT min(r.x) FROM refs r WHERE r.user_id = e.user_id AND r.x > epoch_us(e.ts) / 1e6) AS hi FROM events e))"""


def _events(spark, d):
    micros = lambda c: (F.unix_micros(c.cast("timestamp")) / 1e6)
    e = fx.table(spark, d, "events")
    refs = e.select("user_id", micros(F.date_trunc("day", F.col("ts"))).alias("x")).distinct()
    return refs, e.select("user_id", micros(F.col("ts")).alias("x"), F.col("value").cast("double").alias("v"))


@query(f"WITH {_REFS} SELECT r.user_id, r.x, round(coalesce(max(n.value), -1), 6) AS v FROM refs r LEFT JOIN near n USING (user_id, x) GROUP BY r.user_id, r.x")
def align_max(spark, d):
    refs, e = _events(spark, d)
    out = align.align(refs, e, ["user_id"], align.largest)
    return out.select("user_id", "x", _r(F.when(F.col("v") == float("-inf"), -1.0).otherwise(F.col("v"))).alias("v"))


@query(f"WITH {_REFS} SELECT r.user_id, r.x, round(coalesce(sum(n.value), 0), 4) AS v FROM refs r LEFT JOIN near n USING (user_id, x) GROUP BY r.user_id, r.x")
def align_sum(spark, d):
    refs, e = _events(spark, d)
    return align.align(refs, e, ["user_id"], align.total).select("user_id", "x", _r(F.col("v"), 4).alias("v"))


@query(f"WITH {_BASE}, {_CMG}, {_SUMMARY}, {_SCORED}, {_NEAREST} SELECT eg_id, ms_level, rt_ms, round(score, 5) AS score FROM crossed")
def cross_score(spark, d):
    c = score.cross_scores(score.scored(_summary(spark, d)))
    leg = lambda n: F.transform(F.arrays_zip(F.col(f"ms{n}.rt_ms").alias("t"), F.col(f"cross_ms{n}").alias("x")), lambda z: F.struct(F.lit(n).alias("ms_level"), z["t"].alias("t"), z["x"].alias("x")))
    rows = c.filter("ms1 is not null and ms2 is not null").select("eg_id", F.explode(F.concat(leg(1), leg(2))).alias("z"))
    return rows.select("eg_id", "z.ms_level", F.col("z.t").alias("rt_ms"), _r(F.col("z.x"), 5).alias("score"))


@query(f"WITH {_BASE}, {_CMG}, {_SUMMARY}, {_SCORED} SELECT eg_id, ms_level, n, coalesce((SELECT min(i) FROM rows_ r WHERE r.eg_id = l.eg_id AND r.ms_level = l.ms_level AND r.v > 0 AND round(r.v, 9) = (SELECT round(max(v), 9) FROM rows_ q WHERE q.eg_id = l.eg_id AND q.ms_level = l.ms_level)), 0)::INTEGER AS apex FROM lists l")
def apex_argmax(spark, d):
    return score.scored(_summary(spark, d)).select("eg_id", "ms_level", F.size("rt_ms").alias("n"), "apex")


_AT_APEX = ", ".join(
    f"m{k}.rt_ms AS ms{k}_rt_ms, m{k}.summed_intensity AS ms{k}_summed_intensity, m{k}.npeaks AS ms{k}_npeaks, round(m{k}.cosine, 5) AS ms{k}_cosine, round(m{k}.scan_mean, 5) AS ms{k}_scan_mean, round(m{k}.lz, 5) AS ms{k}_lazyerscore, round(m{k}.v, 5) AS ms{k}_lazyerscore_vs_baseline"
    for k in (1, 2)
)


@query(
    f"""WITH {_BASE}, {_CMG}, {_SUMMARY}, {_SCORED}, {_NEAREST}, best AS (SELECT eg_id, rt_ms, score FROM (SELECT *, row_number() OVER (PARTITION BY eg_id ORDER BY round(score, 9) DESC, i DESC) AS k FROM crossed WHERE ms_level = 2) WHERE k = 1),
  levels AS (SELECT s.*, r.v, {_LNFLOAT.format(x='s.log_intensity')} AS lz FROM summary s JOIN rows_ r ON r.eg_id = s.eg_id AND r.ms_level = s.ms_level AND r.t = s.rt_ms),
  at_ AS (SELECT b.eg_id, b.rt_ms, b.score, coalesce((SELECT max(t) FROM rows_ r WHERE r.eg_id = b.eg_id AND r.ms_level = 1 AND r.t < b.rt_ms), (SELECT min(t) FROM rows_ r WHERE r.eg_id = b.eg_id AND r.ms_level = 1)) AS t1,
  coalesce((SELECT max(t) FROM rows_ r WHERE r.eg_id = b.eg_id AND r.ms_level = 2 AND r.t < b.rt_ms), (SELECT min(t) FROM rows_ r WHERE r.eg_id = b.eg_id AND r.ms_level = 2)) AS t2 FROM best b)
  SELECT a.eg_id, a.rt_ms AS apex_rt_ms, round(a.score, 5) AS cross_score, {_AT_APEX} FROM at_ a JOIN levels m1 ON m1.eg_id = a.eg_id AND m1.ms_level = 1 AND m1.rt_ms = a.t1 JOIN levels m2 ON m2.eg_id = a.eg_id AND m2.ms_level = 2 AND m2.rt_ms = a.t2"""
)
def scores_at_rt_asof(spark, d):
    a = score.apex_scores(score.cross_scores(score.scored(_summary(spark, d))))
    whole = ("rt_ms", "summed_intensity", "npeaks")
    side = [(F.col(f"{m}.{k}") if k in whole else _r(F.col(f"{m}.{k}"), 5)).alias(f"{m}_{k}") for m in ("ms1", "ms2") for k in (*whole, "cosine", "scan_mean", "lazyerscore", "lazyerscore_vs_baseline")]
    return a.select("eg_id", "apex_rt_ms", _r(F.col("cross_score"), 5).alias("cross_score"), *side)


@query(f"WITH {_PEAKS}, t AS (SELECT ms_level, coalesce(quad, -1) AS quad, frame_index, tof_index, sum(intensity)::BIGINT AS intensity FROM peaks GROUP BY ALL) SELECT ms_level, quad, frame_index, tof_index, intensity, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ms_level, quad, frame_index ORDER BY intensity DESC, tof_index) AS k FROM t) WHERE k <= 10")
def topn_per_frame(spark, d):
    keys = ["ms_level", "quad", "frame_index"]
    t = fx.peaks(spark, d).withColumn("quad", F.coalesce("quad_major", F.lit(-1))).groupBy(*keys, "tof_index").agg(F.sum("intensity").alias("intensity"))
    return agg.top_per_group(t, keys, "intensity", "tof_index", 10).select(*keys, "tof_index", "intensity", "rank")


@query(f"WITH {_PEAKS} SELECT coalesce(quad, -1) AS quad, round((max(rt) - min(rt)) / count(*), 6) AS cycle_time, count(*) AS n_frames FROM (SELECT DISTINCT quad, rt FROM peaks) GROUP BY quad")
def cycle_time(spark, d):
    f = fx.peaks(spark, d).select(F.coalesce("quad_major", F.lit(-1)).alias("quad"), "rt").distinct()
    return agg.cycle_time(f, "quad").select("quad", _r(F.col("cycle_time")).alias("cycle_time"), "n_frames")


@query(f"WITH {_PEAKS} SELECT frame_index, list_sort(list(intensity))[len(list(intensity)) // 2 + 1] AS median, count(*) AS n FROM peaks GROUP BY frame_index")
def upper_median(spark, d):
    return agg.width_median(fx.peaks(spark, d), "frame_index", "intensity")


@query(f"WITH {_PEAKS} SELECT frame_index, round(exp(avg(ln(intensity::DOUBLE))), 6) AS mean FROM peaks GROUP BY frame_index")
def geometric_mean(spark, d):
    return fx.peaks(spark, d).groupBy("frame_index").agg(_r(s.geometric_mean(F.col("intensity").cast("double"))).alias("mean"))


@query(
    f"""WITH {_PEAKS}, p AS (SELECT ms_level, coalesce(quad, -1) AS quad, frame_index, scan_index, count(*) AS n FROM peaks GROUP BY ALL), g AS (SELECT ms_level, quad, frame_index, unnest(range(0, max(scan_index) + 2)) AS i FROM p GROUP BY ms_level, quad, frame_index)
  SELECT g.ms_level, g.quad, g.frame_index, g.i::INTEGER AS i, coalesce(sum(p.n) OVER (PARTITION BY g.ms_level, g.quad, g.frame_index ORDER BY g.i), 0)::BIGINT AS offset_ FROM g LEFT JOIN p ON p.ms_level = g.ms_level AND p.quad = g.quad AND p.frame_index = g.frame_index AND p.scan_index = g.i - 1"""
)
def csr_compress(spark, d):
    keys = ["ms_level", "quad", "frame_index"]
    ids = fx.peaks(spark, d).withColumn("quad", F.coalesce("quad_major", F.lit(-1))).groupBy(*keys).agg(F.sort_array(F.collect_list("scan_index")).alias("ids"))
    return ids.select(*keys, F.posexplode(s.csr_compress(F.col("ids"))).alias("i", "offset_"))


@query(f"WITH {_PEAKS} SELECT ms_level, coalesce(quad, -1) AS quad, frame_index, scan_index, tof_index, intensity FROM peaks")
def csr_explode(spark, d):
    return expand.explode_frames(fx.csr_frames(spark, d)).select("ms_level", F.coalesce("quad_major", F.lit(-1)).alias("quad"), "frame_index", "scan_index", "tof_index", "intensity")


@query(f"WITH {_PEAKS}, {_QUADS}, w AS (SELECT quad, scan_start + least((scan_end - scan_start) // 10, 20) AS lo, scan_end - least((scan_end - scan_start) // 10, 20) AS hi FROM quads) SELECT p.quad, p.frame_index, count(*) AS n, sum(intensity)::BIGINT AS intensity FROM peaks p JOIN w ON w.quad = p.quad WHERE scan_index >= lo AND scan_index < hi GROUP BY ALL")
def scan_edge_trim(spark, d):
    lo, hi = expand.trimmed(F.col("scan_start"), F.col("scan_end"))
    w = fx.quads(spark).select(F.col("quad_major").alias("quad"), lo.alias("lo"), hi.alias("hi"))
    p = fx.peaks(spark, d).join(F.broadcast(w), F.col("quad_major") == F.col("quad")).filter("scan_index >= lo and scan_index < hi")
    return p.groupBy("quad", "frame_index").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))


@query(f"WITH {_PEAKS} SELECT coalesce(quad, -1) AS quad, tof_index, count(*) AS n_peaks, sum(intensity)::BIGINT AS intensity FROM peaks GROUP BY ALL")
def transpose_bucket_counts(spark, d):
    return expand.bucket_counts(fx.peaks(spark, d)).select(F.coalesce("quad_major", F.lit(-1)).alias("quad"), "tof_index", "n_peaks", "intensity")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice::DOUBLE, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def top1_per_group(spark, d):
    t = agg.top_per_group(fx.table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")
    return t.select("o_custkey", "o_orderkey", _r(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def semi_join_filter(spark, d):
    c = fx.table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return fx.table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT {id} AS id, round(list_dot_product(e, list_reverse(e)) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(e, e))), 5) AS cosine FROM (SELECT *, list_transform({vec}, lambda x: x::DOUBLE) AS e FROM embeddings)")
def embedding_cosine(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col(_EMB_ID).alias("id"), F.transform(_EMB, lambda x: x.cast("double")).alias("e"))
    return e.select("id", _r(s.cosine_similarity(F.col("e"), F.reverse("e")), 5).alias("cosine"))


@query(
    f"""WITH {_BASE} SELECT t.eg_id, t.ms_level, t.transition_key, count(h.eg_id) AS n, coalesce(max(h.intensity), 0)::BIGINT AS top FROM targets t LEFT JOIN hits h ON h.eg_id = t.eg_id AND h.ms_level = t.ms_level AND h.transition_key = t.transition_key GROUP BY ALL"""
)
def transition_coverage(spark, d):
    h = _hits(spark, d).groupBy("eg_id", "ms_level", "transition_key").agg(F.count(F.lit(1)).alias("n"), F.max("intensity").alias("top"))
    t = fx.targets(spark, d).select("eg_id", "ms_level", "transition_key").join(h, ["eg_id", "ms_level", "transition_key"], "left")
    return t.select("eg_id", "ms_level", "transition_key", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), F.coalesce("top", F.lit(0).cast("bigint")).alias("top"))


@query(f"WITH {_PEAKS} SELECT coalesce(quad, -1) AS quad, frame_index, rt - lag(rt) OVER (PARTITION BY quad ORDER BY rt) AS step FROM (SELECT DISTINCT quad, frame_index, rt FROM peaks)")
def frame_steps(spark, d):
    f = fx.peaks(spark, d).select("quad_major", "frame_index", "rt").distinct()
    return f.select(F.coalesce("quad_major", F.lit(-1)).alias("quad"), "frame_index", (F.col("rt") - F.lag("rt").over(Window.partitionBy("quad_major").orderBy("rt"))).alias("step"))


@query()
def centroid_frames(spark, d):
    return centroid.centroid_frames(fx.peaks(spark, d), centroid.absolute(2), centroid.absolute(2))


@query()
def peak_width(spark, d):
    return centroid.peak_width(fx.peaks(spark, d))


for _name in ("embedding_cosine", "rolling_cosine_exact"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("{id}", _EMB_ID).replace("{vec}", _EMB)

from . import registry_more  # noqa: E402, F401  registers its queries here
