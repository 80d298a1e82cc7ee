import random

from brute import quality
from pyspark.sql import functions as F

from peakflow.llm import quality as q

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_signals_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = q.quality_report(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        assert {k: r[k] for k in COUNTS} == quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "a", "a b c a b c", "x\n x\nx\n\n", "é é é é", "a b c", "one two\r\none two\r\n", "#*$%&|<> |"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["w " * 30000, " ".join(map(str, range(30000)))]
    rows = [(i, t, None if i % 3 else "en", "s", i) for i, t in enumerate(texts)] + [(None, "null id", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")
    got = {r.doc_id: r for r in q.quality_report(df).collect()}
    for i, t in enumerate(texts):
        assert {k: got[i][k] for k in COUNTS} == quality(t), t[:80] if t else t
    assert None in got


def test_exact_path_for_colliding_windows(spark, monkeypatch):
    """With all positions and hardly any hash bits, neighbours differ and the windows themselves are sorted."""
    monkeypatch.setattr(q, "_POSITION_BITS", 62)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcd") for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.n_repeat_words for r in q.with_signals(df, F.col("text")).collect()}
    assert got == {i: quality(t)["n_repeat_words"] for i, t in enumerate(texts)}


def test_sketches_merge(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    signals = q.with_signals(docs, F.col("text"))
    halves = q.merge(q.sketch(signals.filter("doc_id % 2 = 0")), q.sketch(signals.filter("doc_id % 2 = 1")))
    key = lambda df: sorted(map(tuple, df.select("lang", "source", "signal", "cell", "n").collect()))
    assert key(halves) == key(q.sketch(signals))


def test_filter_keeps_rows_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1))
    out = q.quality_filter(docs)
    assert out.columns == docs.columns
    want = {r.doc_id for r in q.quality_report(docs).filter("kept").collect()}
    assert {r.doc_id for r in out.collect()} == want
    assert q.quality_filter(docs.limit(0)).count() == 0 and q.quality_report(docs.limit(0)).count() == 0


def test_good_labels_are_kept(spark):
    d = "/root/testdata/sf0.01"
    out = q.quality_report(spark.read.parquet(f"{d}/documents.parquet"))
    good = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("quality = 1 and not base_failed")
    bad = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("quality = 0")
    n, kept = good.count(), good.filter("kept").count()
    assert kept >= 0.99 * n
    assert bad.filter("not kept").count() >= 0.5 * bad.count()
