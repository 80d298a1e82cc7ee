import random

import numpy as np
from brute import shingles
from pyspark.sql import functions as F

from peakflow.llm import decontaminate as d


def brute(docs, items):
    out = set()
    sets = {i: shingles(t) for i, t in items}
    for k, t in docs:
        s = shingles(t)
        out |= {(k, i, len(s & x), len(x)) for i, x in sets.items() if x and 100 * len(s & x) >= 75 * len(x)}
    return out


def test_table(spark):
    t = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{t}/documents.parquet"), spark.read.parquet(f"{t}/benchmark.parquet")
    got = {tuple(r)[:4] for r in d.leaks(docs, items).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and want
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {w[0] for w in want}


def test_scattered_and_altered(spark):
    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([1, 3, 5, 6, 12, 20, 40, 40, 60, 120, 500])]
    docs, k = [], 0
    for _, ws in items:
        for _ in range(15):
            long = text(rnd.choice([0, 10, 3000]))
            cut = rnd.randint(0, len(ws)) if rnd.random() < 0.5 else 0  # in two pieces, far apart
            part = ws[: max(1, int(len(ws) * rnd.choice([0.7, 0.8, 1])))]
            docs.append((k, " ".join(part[:cut] + long + part[cut:] + text(5)).upper() if rnd.random() < 0.5 else "\n".join(long + part)))
            k += 1
    docs += [(k, None), (k + 1, ""), (None, " ".join(items[6][1])), (k + 2, " ".join(items[1][1]))]
    bench = [(i, " ".join(ws)) for i, ws in items] + [(99, None), (100, "")]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {tuple(r)[:4] for r in d.leaks(df, b).collect()} == brute(docs, bench)
    n = len([x for x in docs if not any(w[0] == x[0] for w in brute([x], bench))])
    assert d.clean(df, b).count() == n
    assert d.leaks(df.limit(0), b).count() == 0 and d.leaks(df, b.limit(0)).count() == 0 and d.clean(df, b.limit(0)).count() == len(docs)
    assert {tuple(r)[:4] for r in d.leaks(df, b, held=5).collect()} == brute(docs, bench)  # joined, as a great benchmark is
    wide = df.withColumn("K1_", F.lit(1)).withColumn("name", F.lit(2))
    assert d.clean(wide, b, held=5).columns == wide.columns
    assert sorted(map(str, d.clean(wide, b, held=5).collect())) == sorted(map(str, d.clean(wide, b).collect()))


def test_great_benchmark(spark, monkeypatch):
    """Joined, the whole table and repeated rows give what brute force gives, also where one text has many parts to check."""
    monkeypatch.setattr(d, "CHECKED", 2)
    t = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{t}/documents.parquet"), spark.read.parquet(f"{t}/benchmark.parquet")
    all_items = " ".join(r.text for r in items.collect())
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, all_items), (-1, all_items), (-2, None), (-3, "")], "doc_id long, text string"))
    items = items.select("item_id", "text").union(items.select("item_id", "text").limit(3)).union(spark.createDataFrame([(None, "one two")], "item_id long, text string"))
    got = sorted(map(str, d.leaks(docs, items, held=10).collect()))
    assert got == sorted(map(str, d.leaks(docs, items).collect())) and got
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.filter("item_id is not null").collect()])
    assert {tuple(r)[:4] for r in d.leaks(docs, items, held=10).filter("item_id is not null").collect()} == want
    assert sorted(map(str, d.clean(docs, items, size=10).collect())) == sorted(map(str, d.clean(docs, items).collect()))
    none = spark.createDataFrame([(1, ""), (2, " "), (3, None)], "item_id long, text string")
    assert d.leaks(docs, none, held=1).count() == 0 and d.clean(docs, none, held=1).count() == docs.count()
    assert d.leaks(docs.limit(0), items, held=1).count() == 0 and d.clean(docs.limit(0), items, held=1).count() == 0


def test_long_text_in_pieces():
    rnd = np.random.default_rng(1)
    s = rnd.integers(0, 1 << 62, d.PIECE * 2 + 999).astype(np.uint64)
    index = d.Index([(1, " ".join(f"w{i}" for i in range(40)))])
    for at in (0, d.PIECE - 20, d.PIECE, len(s) - len(index.sets[0])):
        t = s.copy()
        t[at : at + len(index.sets[0])] = index.sets[0]
        assert d._slice_candidates(t, np.array([0, len(t)]), index) == [{0}]
