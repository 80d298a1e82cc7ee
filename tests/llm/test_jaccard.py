import random

import numpy as np
import pyarrow as pa
from brute import components
from pyspark.sql import functions as F

from peakflow.llm import graph, jaccard as j


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.components_of(df).collect()}
    assert got == components(texts)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.components_of(docs).collect()}
    assert got == want
    left = j.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()})


def made(rnd):
    words = [f"w{i}" for i in range(300)]
    texts, k = {}, 0
    for n in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 120]:
        for _ in range(3):
            base = [rnd.choice(words) for _ in range(n)]
            for _ in range(5):
                t = list(base)
                for _ in range(rnd.randint(0, 2 + n // 25)):
                    at = rnd.randrange(len(t) + 1)
                    if rnd.random() < 0.5 and len(t) > 1:
                        t.pop(min(at, len(t) - 1))
                    else:
                        t.insert(at, rnd.choice(words))
                texts[k] = " ".join(t).upper() if rnd.random() < 0.3 else "\n".join(t)
                k += 1
    texts |= {k: None, k + 1: "", k + 2: " \n"}
    return texts


def test_small_and_large_sets(spark):
    check(spark, made(random.Random(7)))


def test_groups_in_blocks_and_lists_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(j, "GROUP_SHINGLES", 300)
    monkeypatch.setattr(j, "TOLD", 0)
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = made(rnd)
    for k in range(1000, 1060):  # one passage in many texts, some of them close to it alone
        texts[k] = " ".join(passage + [f"x{rnd.randrange(9999)}" for _ in range(rnd.choice([0, 3, 8, 15, 60]))])
    check(spark, texts)


def test_lists_as_chains_only(spark, monkeypatch):
    monkeypatch.setattr(j, "SHORT", 1)
    check(spark, made(random.Random(11)))


def test_all_light_or_all_heavy(spark, monkeypatch):
    texts = {k: v for k, v in made(random.Random(9)).items() if v and len(v.split()) < 14}
    for x in (0, 12):
        monkeypatch.setattr(j, "boundary", lambda h, x=x: x)
        check(spark, texts)


def test_boundary_follows_cost():
    assert j.boundary({7: 100}) >= 7  # eight subsets cost less than two entries and a check
    assert j.boundary({12: 10**6, 4: 1}) < 12


def test_walk_spans_components():
    rnd = np.random.default_rng(2)
    core = rnd.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([core[: 200 - i], rnd.integers(0, 1 << 60, i).astype(np.uint64)])) for i in range(0, 60, 2)]
    sets.append(rnd.integers(0, 1 << 60, 50).astype(np.uint64))
    edges = j.linked(sets)
    assert all(7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b])) for a, b in edges)
    assert 0 < len(edges) < len(sets)


def test_odd_ids_and_columns(spark):
    t, u = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, t, "x"), (1, t, "x"), (1, u, "y"), (None, u, "z"), (None, t + " k", "q"), (5, None, "n"), (6, "", "n"), (None, "only one here", "o"), (7, "solo", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").withColumn("row", F.lit(1))
    out = j.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(map(str, (tuple(r)[:3] for r in out.collect()))) == sorted(map(str, [(1, t, "x"), (1, u, "y"), (5, None, "n"), (6, "", "n"), (None, "only one here", "o"), (7, "solo", "s")]))
    assert j.components_of(df.limit(0)).count() == 0 and j.deduplicate(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_sql_twin(spark):
    import duckdb

    from peakflow.llm.registry import ORACLE_SQL

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in j.components_of(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(con.sql(ORACLE_SQL["op9_jaccard_join"]).select("doc_id", "n_shingles", "component_id").fetchall())


def test_buckets_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(j, "FAN", 3)
    monkeypatch.setattr(j, "BUCKET_SHINGLES", 60)
    monkeypatch.setattr(j, "FINER_BYTES", 2000)
    check(spark, made(random.Random(12)))


def test_sets_that_agree_in_one_hash(spark, monkeypatch):
    """Half of the first hashes are said not to tell sets apart; their sets then go by the second."""

    def told(slim):
        odd = frozenset(r.node for r in slim.filter("n > 0 and node % 2 = 0").select("node").distinct().collect())
        assert len(odd) > 20
        return slim.withColumn("node", F.when(F.col("node").isin(*odd), F.col("second")).otherwise(F.col("node"))).drop("second"), odd

    monkeypatch.setattr(j, "_told_apart", told)
    texts = made(random.Random(13))
    check(spark, texts)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(1, "an id that comes twice " * 9)], "doc_id long, text string")
    assert j.deduplicate(df).count() > 0


def test_unlike_sets_are_found(spark):
    rows = [(1, 5, 7, 1), (2, 5, 7, 1), (3, 5, 8, 1), (4, 5, 8, 2), (5, 0, 0, 0)]
    slim, odd = j._told_apart(spark.createDataFrame(rows, "doc_id long, n long, node long, second long"))
    assert odd == {8} and sorted(r.node for r in slim.collect()) == [0, 1, 2, 7, 7]


def test_documents_are_dealt_evenly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    blank = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    for df, many, parts in ((docs, 10000, 50), (blank, 30000, 50)):
        got = df.repartition(parts).mapInArrow(j._count_map(57), f"bucket int, shingles binary, {j._ROWS_SQL}").filter("ids is not null")
        by = [r[1] for r in got.groupBy("bucket").agg(F.sum(F.size("ids"))).collect()]
        assert sum(by) == many and len(by) == 57 and max(by) <= 2 * many / 57


def test_very_long_texts(spark):
    rnd = random.Random(14)
    ws = [f"w{rnd.randrange(5000)}" for _ in range(150_000)]
    near = [w if rnd.random() > 0.02 else "new" for w in ws]
    far = [w if rnd.random() > 0.2 else "new" for w in ws]
    check(spark, {1: " ".join(far), 2: " ".join(near), 3: " ".join(ws), 4: " ".join(ws[:100]), 5: "w" * 2_000_000, 6: " ".join(ws)})


def test_every_frequent_shingle_comes_last():
    """The order has no limit of frequent shingles: of 60 in one of many buckets none is taken for a rare one."""
    n, at, rnd = 1 << 17, 77, np.random.default_rng(15)
    s = ((at + n * np.arange(1, 101)).astype(np.uint64) << np.uint64(32)) | rnd.integers(0, 1 << 32, 100).astype(np.uint64)
    often, rare = s[np.arange(100) % 5 < 3], s[np.arange(100) % 5 >= 3]
    rows = {c: pa.array([None], pa.list_(t)) for c, t in j._ROWS.items()}
    got = j._count_group(n)(pa.table({"bucket": pa.array([at], pa.int32()), "shingles": [np.concatenate([s] + [often] * 20).tobytes()], **rows}))
    assert got["bucket"].to_pylist() == [at]
    told = np.zeros((n, j._width(n) // 4), np.uint8)
    told[at] = np.frombuffer(got["cells"][0].as_py(), np.uint8)
    assert told.nbytes <= 64 << 20
    assert len(rare) == 40 and np.isin(j.ordered_prefix(s, told.ravel(), n), rare).all()
