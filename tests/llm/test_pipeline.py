"""Each stage against a plain version of its contract, on what the stage before kept."""

import hashlib
from collections import Counter

import numpy as np
from brute import components, quality, shingles

import corpus_pipeline
from peakflow.llm import training_order
from peakflow.llm._spark import materialise


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.collect())
    ids = lambda rows: {r.doc_id for r in rows}
    first = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert not any(quality(r.text)["base_failed"] for r in kept[0]) and len(kept[0]) > 0.5 * len(first)
    want = components({r.doc_id: r.text for r in kept[0]})
    assert ids(kept[1]) == {c for _, c in want.values()} and len(kept[1]) == len(ids(kept[1]))
    items = [x for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if (x := shingles(r.text))]
    leak = lambda t: any(100 * len(s & x) >= 75 * len(x) for s in [shingles(t)] for x in items)
    assert ids(kept[2]) == {r.doc_id for r in kept[1] if not leak(r.text)} != ids(kept[1])
    assert ids(kept[3]) <= ids(kept[2]) and max(Counter(r.doc_id for r in kept[3]).values()) <= 3
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    enc, n = training_order.encoder(), training_order.SEQUENCE
    digests = Counter()
    for r in kept[3]:
        t = np.append(enc.encode_to_numpy(r.text).astype(np.uint16), np.uint16(enc.max_token_value + 1))
        digests.update(hashlib.sha256(t[k : k + n].tobytes().ljust(2 * n, b"\0")).hexdigest() for k in range(0, len(t), n))
    assert Counter(r.sha256 for r in out) == digests
    assert sorted(r.slot for r in out) == list(range(len(out)))


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
