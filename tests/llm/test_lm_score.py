import numpy as np
import pyarrow as pa

from peakflow.llm import lm_score as m
from peakflow.llm._text import word_hashes


def brute(net, around, word):
    """ln p of one word, from the definition."""
    x = sum(net.emb[a] * p for a, p in zip(around, net.place))
    h = np.tanh(x @ net.w + net.b)
    c, k = divmod(int(word), m.PER_CLASS)
    soft = lambda z, i: z[i] - np.log(np.exp(z).sum())
    return soft(h @ net.top + net.tb, c) + soft(h @ net.leaf[c] + net.lb[c], k)


def test_scores_equal_definition():
    texts = ["a b c d e a b", "", "x", None, "p q"]
    net = m.Net(seed=4)
    net.flat += np.random.default_rng(0).normal(0, 0.3, len(net.flat)).astype(np.float32)
    (_, _, h, offs) = next(word_hashes(pa.array(texts)))
    vocab = m.Vocabulary(h[:3])
    got = m.score_hashes(net, vocab, h, offs)
    ids = vocab.of(h)
    for i in range(len(texts)):
        own, want = ids[offs[i] : offs[i + 1]], 0.0
        for k in range(len(own)):
            around = [own[k + d] if 0 <= k + d < len(own) else m.WORDS for d in (-2, -1, 1, 2)]
            want += brute(net, around, own[k])
        assert abs(got[i] - want) < 1e-3
    total = sum(np.exp(net.log_probs(np.full((1, 4), m.WORDS), np.array([w])))[0] for w in range(m.WORDS))
    assert abs(total - 1) < 1e-3


def test_gradient_step_descends():
    rnd = np.random.default_rng(1)
    around, word = rnd.integers(0, m.WORDS, (512, 4)), rnd.integers(0, 40, 512)
    net = m.Net()
    before = net.log_probs(around, word).mean()
    for _ in range(30):
        net.step(around, word, m.RATE)
    assert net.log_probs(around, word).mean() > before + 0.3


def test_step_equals_definition():
    """Two steps of Adagrad with gradients from the definition, in double precision."""
    rnd = np.random.default_rng(5)
    around, word = rnd.integers(0, 300, (1500, 4)), rnd.integers(0, 300, 1500) ** 2 // 90 % m.WORDS
    around[:40, 0] = m.WORDS
    names, n = ("emb", "place", "w", "b", "top", "tb", "leaf", "lb"), len(word)
    net = m.Net(seed=4)
    net.flat += rnd.normal(0, 0.3, len(net.flat)).astype(np.float32)
    v = {k: getattr(net, k).astype(float) for k in names}
    past = {k: np.zeros_like(x) for k, x in v.items()}
    soft = lambda z: np.exp(z - z.max(-1, keepdims=True)) / np.exp(z - z.max(-1, keepdims=True)).sum(-1, keepdims=True)
    for _ in range(2):
        net.step(around, word, m.RATE)
        g = {k: np.zeros_like(x) for k, x in v.items()}
        e = v["emb"][around]
        x = (e * v["place"]).sum(1)
        h = np.tanh(x @ v["w"] + v["b"])
        p = soft(h @ v["top"] + v["tb"])
        p[np.arange(n), word // m.PER_CLASS] -= 1
        g["top"], g["tb"], dh = h.T @ p, p.sum(0), p @ v["top"].T
        for i, (c, k) in enumerate(zip(*divmod(word, m.PER_CLASS))):
            q = soft(h[i] @ v["leaf"][c] + v["lb"][c])
            q[k] -= 1
            g["leaf"][c] += np.outer(h[i], q)
            g["lb"][c] += q
            dh[i] += v["leaf"][c] @ q
        da = dh * (1 - h * h)
        dx = da @ v["w"].T
        g["w"], g["b"], g["place"] = x.T @ da, da.sum(0), (dx[:, None] * e).sum(0)
        np.add.at(g["emb"], around, dx[:, None] * v["place"])
        for k in names:
            past[k] += (g[k] / n) ** 2
            v[k] -= m.RATE * g[k] / n / np.sqrt(past[k] + 1e-8)
    assert all(np.allclose(getattr(net, k), v[k], atol=5e-4) for k in names), {k: np.abs(getattr(net, k) - v[k]).max() for k in names}


def test_great_logits():
    """Logits whose exponentials no single float holds."""
    rnd = np.random.default_rng(6)
    around, word = rnd.integers(0, m.WORDS, (600, 4)), rnd.integers(0, m.WORDS, 600)
    net = m.Net(seed=4)
    net.top *= 400
    net.leaf *= 400
    net.tb += 300
    net.lb -= 300
    h = np.tanh((net.emb[around] * net.place).sum(1) @ net.w + net.b).astype(float)
    z = h @ net.top + net.tb
    assert z.max() > 320
    log = lambda z, i: z[i] - z.max() - np.log(np.exp(z - z.max()).sum())
    want = [log(z[i], c) + log(h[i] @ net.leaf[c] + net.lb[c], k) for i, (c, k) in enumerate(zip(*divmod(word, m.PER_CLASS)))]
    assert np.allclose(net.log_probs(around, word), want, rtol=1e-4, atol=1e-2)
    net.step(around, word, m.RATE)
    assert np.isfinite(net.flat).all() and np.isfinite(net.log_probs(around, word)).all()


class Counted(np.ndarray):
    """Arrays, and all that element-wise functions make of them, that count the numbers passed through."""

    passed = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **more):
        plain = lambda xs: tuple(x.view(np.ndarray) if isinstance(x, Counted) else x for x in xs)
        got = getattr(ufunc, method)(*plain(inputs), **(more if out is None else more | {"out": plain(out)}))
        Counted.passed += max(map(np.size, inputs)) if ufunc is not np.matmul else 0
        return got.view(Counted) if isinstance(got, np.ndarray) else got


def test_logits_are_passed_over_once():
    """A word has 256 logits; passes over them are what training and scoring cost."""
    rnd = np.random.default_rng(7)
    around, word = rnd.integers(0, m.WORDS, (m.BATCH, 4)), rnd.integers(0, m.WORDS, m.BATCH)
    net = m.Net()
    net.step(around, word, m.RATE)
    for name, x in list(vars(net).items()):
        if isinstance(x, np.ndarray):
            setattr(net, name, x.view(Counted))
    for run, most in ((lambda: net.log_probs(around, word), 700), (lambda: net.step(around, word, m.RATE), 1600)):
        Counted.passed = 0
        run()
        assert m.CLASSES + m.PER_CLASS <= Counted.passed / m.BATCH < most, Counted.passed / m.BATCH


def test_held_out_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(3)
    seen, rest = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0")
    vocab = m.vocabulary(seen.select("text"))
    net = m.train(seen.select("text"), vocab, rounds=2, one_in=1)
    ids = lambda df: [(vocab.of(h), offs) for _, _, h, offs in word_hashes(pa.array([r.text for r in df.collect()]))]
    counts = sum(np.bincount(x, minlength=m.WORDS) for x, _ in ids(seen)) + 1.0
    log = np.log(counts / counts.sum())
    own = ids(rest)
    plain = np.concatenate([log[x] for x, _ in own]).mean()
    ours = np.concatenate([net.log_probs(m.windows(x, o), x) for x, o in own]).mean()
    assert ours > plain + 0.05, (ours, plain)


def test_every_word_is_learnt_from_in_one_round(spark):
    df = spark.createDataFrame([("a b c",), ("d",), (None,), ("e f a b c " * 50,)], "text string").coalesce(1)
    handle = spark.sparkContext.broadcast((m.Vocabulary(np.zeros(0, np.uint64)), m.Net().flat))
    seen = [df.mapInArrow(m._train(handle, k, m.LEARN_ONE_IN), "part int, seen bigint, net binary").collect() for k in range(m.ROUNDS)]
    assert sum(r.seen for rows in seen for r in rows) == 254
    (_, _, h, offs) = next(word_hashes(pa.array(["a b c", "d", "e f a b c " * 50])))
    assert (sum(m.learnt(h, offs, k, m.LEARN_ONE_IN).astype(int) for k in range(m.ROUNDS)) == 1).all()


def test_held_out_beats_word_frequencies_as_shipped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(3)
    seen, rest = docs.filter("doc_id % 5 > 0"), docs.filter("doc_id % 5 = 0")
    vocab = m.vocabulary(seen.select("text"))
    net = m.train(seen.select("text"), vocab)
    ids = lambda df: [(vocab.of(h), offs) for _, _, h, offs in word_hashes(pa.array([r.text for r in df.collect()]))]
    counts = sum(np.bincount(x, minlength=m.WORDS) for x, _ in ids(seen)) + 1.0
    log, own = np.log(counts / counts.sum()), ids(rest)
    plain = np.concatenate([log[x] for x, _ in own]).mean()
    ours = np.concatenate([net.log_probs(m.windows(x, o), x) for x, o in own]).mean()
    assert ours > plain + 0.05, (ours, plain)


def test_words_of_tail_entries_have_probabilities_of_their_own(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    monkeypatch.setattr(m, "train", lambda texts, vocab: m.Net(seed=4).begin_at(vocab.shares))
    monkeypatch.setattr(m, "SENT_WORDS", 400)
    words = [f"w{i}" for i in range(20_000)]  # more than the vocabulary has
    odds = 1 / np.arange(1, 20_001)
    texts = [" ".join(rnd.choice(words, 40, p=odds / odds.sum())) for _ in range(300)] + [" ".join(words), None, "w19999 misspelt"]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted((r.n_words, r.log_prob, r.doc_id or -1) for r in m.scores(df).collect())
    vocab = m.vocabulary(df.select("text"))
    (_, _, h, offs) = next(word_hashes(pa.array(texts)))
    entry, (keys, counts) = vocab.of(h), np.unique(h, return_counts=True)
    count, tail = dict(zip(keys.tolist(), counts.tolist())), set(vocab.tail.tolist())
    of_entry = np.bincount(entry, minlength=m.WORDS)
    own = np.array([np.log(count[int(x)] / (of_entry[e] + 1)) if e in tail else 0.0 for x, e in zip(h, entry)])
    assert (own < 0).sum() > 2000
    base = m.score_hashes(m.Net(seed=4).begin_at(vocab.shares), vocab, h, offs)
    want = sorted((int(offs[i + 1] - offs[i]), base[i] + own[offs[i] : offs[i + 1]].sum(), i if i % 7 else -1) for i in range(len(texts)))
    assert [(n, k) for n, _, k in got] == [(n, k) for n, _, k in want]
    assert np.allclose([x for _, x, _ in got], [x for _, x, _ in want], atol=1e-3)
    seen = keys[vocab.in_tail[vocab.of(keys)]]
    mass = np.bincount(vocab.of(seen), np.exp(vocab.log_share(seen, np.array([count[int(x)] for x in seen]))), m.WORDS)
    unseen = np.exp(vocab.log_share(np.arange(256, dtype=np.uint64), np.zeros(256)))
    assert np.allclose(mass[vocab.tail] + unseen, 1)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, " \n"), (3, "a b")], "doc_id long, text string")
    got = sorted(map(tuple, m.scores(df).collect()), key=str)
    assert len(got) == 5 and sum(r[1] for r in got) == 4
    assert all(r[3] is None and r[2] == 0 for r in got if not r[1])
    assert m.scores(df.limit(0)).count() == 0


def test_weights_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_WORDS", 60_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    nets = [m.train(d, m.vocabulary(d.select("text"))).flat for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(docs.doc_id.desc()))]
    assert all(np.allclose(n, nets[0], atol=2e-3) for n in nets[1:])
    assert np.abs(nets[0] - m.Net().flat).max() > 0.1


def test_entries_are_what_texts_say(spark):
    texts = ["a b c", None, "", "d e", " \n", "f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "place long, text string").coalesce(1)
    vocab = m.Vocabulary(np.zeros(0, np.uint64))
    got = df.mapInArrow(m._entries(spark.sparkContext.broadcast(vocab)), "place bigint, words binary").collect()
    (_, _, h, offs) = next(word_hashes(pa.array(texts)))
    assert {r.place: np.frombuffer(r.words, np.uint16).tolist() for r in got} == {i: vocab.of(h[offs[i] : offs[i + 1]]).tolist() for i in (0, 3, 5)}
