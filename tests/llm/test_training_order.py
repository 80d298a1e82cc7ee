import hashlib

import numpy as np
import pytest

from peakflow.llm import training_order as t


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    p = t.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert t.permute(p, n, back=True).tolist() == list(range(n))
    if n > 60:
        assert t.permute(np.arange(n), n, key=1).tolist() != p.tolist()
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.3


def test_wide_permutation():
    """Indices of up to 128 bits: one to one, back again, inside the size, and shards of like sizes in order of place."""
    rnd = np.random.default_rng(0)
    for size in (5, 1 << 40, (1 << 61) + 7, (1 << 63) * 3, (1 << 90) + 12345, 1 << 127, 1 << 128):
        half = t.half_bits(size)
        x = {int.from_bytes(rnd.bytes(17), "big") % size for _ in range(3000)} | {0, size - 1}
        halves = [np.array(v, np.uint64) for v in zip(*((i >> half, i & (1 << half) - 1) for i in sorted(x)))]
        up, low = t.permute_halves(*[h.copy() for h in halves], size)
        places = [(int(a) << half) | int(b) for a, b in zip(up, low)]
        assert len(set(places)) == len(x) and max(places) < size
        back = t.permute_halves(up.copy(), low.copy(), size, back=True)
        assert all((a == b).all() for a, b in zip(back, halves))
        space = t.Space.__new__(t.Space)
        space.size, space.half = size, half
        shard = space.shard(up, low, 5).astype(int)
        assert (np.diff(shard[sorted(range(len(places)), key=places.__getitem__)]) >= 0).all() and shard.max() <= 4
        if size > 1000:
            assert np.bincount(shard, minlength=5).min() > len(x) / 5 * 0.8


def test_indices_are_numbers():
    for low, high, most in ((-5, 2**62, 100), (-(2**63), 2**63 - 1, 1 << 40), (0, 9, 50_000)):
        s = t.Space(low, high, most, 16)
        for d, n in ((low, 3), (high, s.per), (None, 2)) if s.per < 10_000 else ((low, 3), (high, 5000), (None, 2)):
            up, lo = s.index(d, n)
            first = (s.ids - 1 if d is None else d - low) * s.per
            assert [(int(a) << s.half) | int(b) for a, b in zip(up, lo)] == list(range(first, first + n)) and first + n <= s.size


def round_trip(spark, rows, tmp_path, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = t.write_shards(df, str(tmp_path), **kw).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    enc, n = t.encoder(), kw.get("sequence", t.SEQUENCE)
    got = {}
    for r in sorted(out, key=lambda r: r.slot):
        record = t.read_records(str(tmp_path), r.shard, r.record, 1, n)[0]
        assert hashlib.sha256(record.tobytes()).hexdigest() == r.sha256
        assert not record[r.n_tokens :].any()
        got.setdefault(r.doc_id, {})[r.seq] = record[: r.n_tokens]
    for d, text in rows:
        ids = np.concatenate([got[d][k] for k in range(len(got[d]))])
        assert ids[-1] == enc.max_token_value + 1
        assert enc.decode(ids[:-1].tolist()) == (text or "")
    return out


def test_round_trip(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = round_trip(spark, rows, tmp_path / "a", shard_bytes=1 << 16)
    again = t.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), str(tmp_path / "b"), shard_bytes=1 << 16).collect()
    assert sorted(out) == sorted(again)
    assert len({r.shard for r in out}) > 3
    order = [r.doc_id for r in sorted(out, key=lambda r: r.slot)]
    assert abs(np.corrcoef(range(len(order)), order)[0, 1]) < 0.2


def test_odd_texts(spark, tmp_path):
    round_trip(spark, [(None, None), (3, ""), (-5, "é😀 <|endoftext|> x"), (9, "w " * 5000), (2**62, "far")], tmp_path, sequence=16)
    far = [(-(2**63) + k * 0x1FFFFFFFFFFFFFF, f"far {k} " * k) for k in range(100)]
    assert len({r.shard for r in round_trip(spark, far, tmp_path / "far", sequence=16, shard_bytes=1 << 10)}) > 3


def test_repeated_ids_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "c"), (None, "d")], "doc_id long, text string")
    out = t.write_shards(df, str(tmp_path / "x")).collect()
    assert sorted(r.slot for r in out) == [0, 1, 2, 3, 4]
    assert t.write_shards(df.limit(0), str(tmp_path / "y")).count() == 0
