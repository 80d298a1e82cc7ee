import duckdb
from pyspark.sql import functions as F

from peakflow.llm import mixing as m


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(map(tuple, m.mix_report(spark.read.parquet(f"{d}/documents.parquet")).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.sql(m.ORACLE).fetchall())
    assert got == want
    by = {}
    for _, size, total, target, taken in got:
        assert taken <= 3 * size
        by.setdefault((total, target), []).append((size, taken))
    for (total, target), v in by.items():
        assert abs(sum(t for _, t in v) - target) <= max(s for s, _ in v) / 2 + 1


def test_caps_ties_nulls(spark):
    rows = [(i, "w " * (i % 7), s) for i, s in enumerate(["a"] * 3 + ["b"] * 400 + [None] * 5 + ["é"] * 2)] + [(None, "x y", "b"), (None, "x y", "b"), (9000, None, "b"), (9001, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine"))
    out = m.mix_report(df)
    a, b = sorted(out.collect(), key=str), sorted(m.mix_report(df.repartition(7)).collect(), key=str)
    assert a == b and len(a) == len(rows)
    assert sum({(r.source_size, r.target): r.target for r in a}.values()) <= sum(r.size for r in a) + 1e-6
    copies = m.mix(df)
    assert copies.columns == df.columns
    assert copies.select(F.sum(m.word_count(F.col("text")))).first()[0] == sum(r.taken for r in a)
    assert m.mix_report(df.limit(0)).count() == 0 and m.mix(df.limit(0)).count() == 0
