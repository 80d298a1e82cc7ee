"""Document scores from a bidirectional window network: masked pseudo-likelihood.

Every word is predicted from the two words on either side of it; the summed
log-probabilities of a document's words are its score. The network (embeddings
weighted by place, one hidden layer, a softmax in two levels: class, then word
in class) is plain numpy.

The network's entries are the most frequent words of the whole corpus, all
others share hashed tail entries. A word in a tail entry has the probability of
the entry times its own share of it, ln P(word | entry), by its count in the
corpus: the words of texts are dealt out by hash, counted, and their shares are
summed by text. An entry's counts and one more, which all unseen words share,
make up its whole. Training is spread out: texts are dealt out to shards by
hash, as many as the corpus's words ask for, and sorted in each; every shard
runs gradient steps from the weights of the last round, each word in one of the
rounds; the shards' weights are then averaged in steps, weighted by words seen.
So neither files nor the cluster's size change the weights, but for rounding.
What is gathered (word counts, weights, words of tail entries) grows with the
input; what reaches the driver is one vocabulary and one set of weights.

Defined cases: null, empty and blank texts have no words and score 0; places
beyond an end of a text are a padding entry; repeated rows are learnt from and
scored one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise
from ._text import buffers, mix, word_hashes

CLASSES, PER_CLASS = 128, 128
WORDS = CLASSES * PER_CLASS
#: Vocabulary entries for frequent words; the rest are shared by hash.
FREQUENT = WORDS - 256
SIDE = 2
WIDTH = 24
#: Rounds of averaging; shares that the words are dealt into, one for each round, so every word is learnt from; words in a step.
ROUNDS = 2
LEARN_ONE_IN = ROUNDS
BATCH = 8192
RATE = 0.05
#: Rows whose logits are held at once; words scored at once; logits below this need no shift before their exponential.
CHUNK = 512
SCORED = 32_768
MOST_LOGIT = 60
#: Words in a shard that is trained on by itself; least groups that words are counted in.
SHARD_WORDS = 4_000_000
COUNT_GROUPS = 64
#: Texts of a shard whose entries are made ready at once.
SHARD_TEXTS = 2048
#: Tail entries of a full vocabulary; tail words and texts sent at once; least groups that tail words are dealt into, and words in one.
REST = WORDS - FREQUENT
SENT_WORDS, SENT_TEXTS = 1_000_000, 100_000
SHARE_GROUPS, SHARE_GROUP_WORDS = 32, 2_000_000
#: Weights travel as half floats.
_SENT_AS = np.float16
_NET = pa.schema([("part", pa.int32()), ("seen", pa.int64()), ("net", pa.binary())])
_U = np.uint64
#: In ``tops`` and in each of ``leaves`` the last row is the bias, so one product makes logits.
_SHAPES = {"emb": (WORDS + 1, WIDTH), "place": (2 * SIDE, WIDTH), "w": (WIDTH, WIDTH), "b": (WIDTH,), "tops": (WIDTH + 1, CLASSES), "leaves": (CLASSES, WIDTH + 1, PER_CLASS)}


class Net:
    """The weights, as one flat array of single floats and views into it."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 1):
        size = sum(int(np.prod(s)) for s in _SHAPES.values())
        self.past: Net | None = None
        self.flat = np.empty(size, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, shape in _SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        self.top, self.tb = self.tops[:-1], self.tops[-1]
        self.leaf, self.lb = self.leaves[:, :-1], self.leaves[:, -1]
        if flat is None:
            random = np.random.default_rng(seed)
            for x in (self.emb, self.place, self.w, self.b, self.top, self.leaf):
                x[:] = random.normal(0, 0.1, x.shape)
            self.place += 1
            for x in (self.b, self.tb, self.lb):
                x[:] = 0

    def begin_at(self, shares: np.ndarray) -> Net:
        """Set the biases so that, without any context, entries have these shares."""
        by = shares.reshape(CLASSES, PER_CLASS)
        self.tb[:] = np.log(by.sum(1))
        self.lb[:] = np.log(by / by.sum(1, keepdims=True))
        return self

    def _hidden(self, around: np.ndarray):
        """Embeddings, the sum that enters the hidden layer, and that layer with a last column of ones, for the biases."""
        e = np.empty((*around.shape, WIDTH), np.float32)
        np.take(self.emb, around, axis=0, out=e, mode="clip")
        x = np.einsum("nkd,kd->nd", e, self.place, optimize=False)
        h = np.empty((len(x), WIDTH + 1), np.float32)
        np.tanh(x @ self.w + self.b, out=h[:, :-1])
        h[:, -1] = 1
        return e, x, h

    def _bounded(self) -> bool:
        """Whether no logit can leave the range where its exponential is exact, as the hidden layer is within -1 and 1."""
        return all(np.abs(x).sum(-2).max() < MOST_LOGIT for x in (self.tops, self.leaves))

    def log_probs(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        """ln p(word | around) for each row; rows are grouped by class for the second level."""
        order, classes = _by_class(word)
        word, around = word[order], around.take(order, 0)
        cls, leaf = word // PER_CLASS, word % PER_CLASS
        bounded, room = self._bounded(), _room()
        h, each = np.empty((len(word), WIDTH + 1), np.float32), np.empty(len(word), np.float32)
        for rows in _chunks(0, len(word)):  # chunks stay in the cache
            _, _, h[rows] = self._hidden(around[rows])
            own, _, _, total = _exps(h[rows], self.tops, cls[rows], bounded, room)
            each[rows] = own - np.log(total)
        for c, first, end in classes:
            for rows in _chunks(first, end):
                own, _, _, total = _exps(h[rows], self.leaves[c], leaf[rows], bounded, room)
                each[rows] += own - np.log(total)
        out = np.empty_like(each)
        out[order] = each
        return out

    def _move(self, name: str, where, grad: np.ndarray, rate: float) -> None:
        """Step against a gradient, scaled by the root of the squares summed so far (Adagrad); ``grad`` is used up.

        ``where`` is an index or a slice, or an array of rows.
        """
        whole, seen = getattr(self, name), getattr(self.past, name)
        now = seen[where]
        root = grad * grad
        now += root
        if isinstance(where, np.ndarray):
            seen[where] = now
        grad /= np.sqrt(now, out=root)
        grad *= rate
        whole[where] -= grad

    def step(self, around: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One step of descent on the mean of -ln p."""
        if self.past is None:
            self.past = Net(np.full_like(self.flat, 1e-8))  # so that no root is 0
        n = np.float32(len(word))
        rate = np.float32(rate)
        order, classes = _by_class(word)
        word, around = word[order], around.take(order, 0)
        cls, leaf = word // PER_CLASS, word % PER_CLASS
        e, x, h = self._hidden(around)
        bounded, room, dh, everything = self._bounded(), _room(), np.zeros_like(h), slice(None)
        back = lambda weights, at, rows: _back(h[rows], weights, at[rows], bounded, room, n, dh[rows])
        d_tops = reduce(np.add, (back(self.tops, cls, rows) for rows in _chunks(0, len(word))))  # chunks stay in the cache
        for c, first, end in classes:
            self._move("leaves", c, reduce(np.add, (back(self.leaves[c], leaf, rows) for rows in _chunks(first, end))), rate)
        self._move("tops", everything, d_tops, rate)
        da = dh * (1 - h * h)  # 0 in the column of ones
        da = da[:, :-1]
        dx = da @ self.w.T
        self._move("w", everything, x.T @ da / n, rate)
        self._move("b", everything, da.sum(0) / n, rate)
        d_place = np.einsum("nd,nkd->kd", dx, e, optimize=False) / n
        flat = around.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ids = flat[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        dx /= n
        de = dx.take(order // (2 * SIDE), 0, mode="clip")
        de *= self.place.take(order % (2 * SIDE), 0, mode="clip")
        # Pairs of floats are added as complex numbers are, at half the cost.
        self._move("emb", ids[first], np.add.reduceat(de.view(np.complex64), first).view(np.float32), rate)
        self._move("place", everything, d_place, rate)


def _by_class(word: np.ndarray):
    """The order of rows by their words' classes, and (class, first row, end) of each class in it."""
    cls = (word // PER_CLASS).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, cuts[c], cuts[c + 1]) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]


def _chunks(first: int, end: int):
    return (slice(a, min(a + CHUNK, end)) for a in range(first, end, CHUNK))


def _room() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Space for the logits of a chunk, where each of its rows begins, and ones to sum its rows with."""
    wide = max(CLASSES, PER_CLASS)
    return np.empty(CHUNK * wide, np.float32), np.arange(CHUNK), np.ones(wide, np.float32)


def _exps(h: np.ndarray, weights: np.ndarray, at: np.ndarray, bounded: bool, room):
    """(logits at ``at``, exponentials of all, places of ``at`` in them as a flat array, their sums) of each row.

    Logits that are not ``bounded`` are taken less their row's greatest.
    """
    space, count, ones = room
    n, wide = len(h), weights.shape[1]
    flat = space[: n * wide]
    z = np.matmul(h, weights, out=flat.reshape(n, wide))
    if not bounded:
        z -= z.max(1, keepdims=True)
    place = count[:n] * wide
    place += at
    own = flat.take(place)
    np.exp(z, out=z)
    return own, z, place, z @ ones[:wide]


def _back(h: np.ndarray, weights: np.ndarray, at: np.ndarray, bounded: bool, room, n, dh: np.ndarray) -> np.ndarray:
    """Gradient of the mean over ``n`` words of -ln softmax at ``at`` by the weights; that of the sum by the hidden layer is added to ``dh``."""
    _, z, place, total = _exps(h, weights, at, bounded, room)
    # z / total, less 1 at a row's place, is the gradient by logits; the division is left to the narrow side.
    room[0][place] -= total
    by = (1 / total)[:, None]
    d = z @ weights.T
    d *= by
    dh += d
    by /= n
    return (h * by).T @ z


class Vocabulary:
    """Frequent words by hash, in order of frequency; others by hash into the tail.

    ``counts`` and ``total`` give each entry's share of all words, from which
    the network's biases start; without them all shares are equal. ``rest`` has
    the words of each tail entry.
    """

    def __init__(self, frequent: np.ndarray, counts: np.ndarray | None = None, total: int = 0, rest: np.ndarray | None = None):
        self.keys, order = np.unique(frequent, return_index=True)
        # Neighbours in frequency go to different classes.
        self.ids = ((order % CLASSES) * PER_CLASS + order // CLASSES).astype(np.int64)
        used = set(self.ids.tolist())
        self.tail = np.array([i for i in range(WORDS) if i not in used])
        self.in_tail = np.isin(np.arange(WORDS), self.tail)
        self.rest = np.zeros(len(self.tail)) if rest is None else rest
        self.total = total
        self.shares = np.full(WORDS, 1.0 / WORDS)
        if counts is not None and total:
            self.shares[self.ids] = counts[order]
            self.shares[self.tail] = (total - counts.sum()) / len(self.tail)
            self.shares = (self.shares + 1) / (self.shares + 1).sum()

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.tail[(h % _U(len(self.tail))).astype(np.int64)]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out = np.where(self.keys[at] == h, self.ids[at], out)
        return out

    def log_share(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """ln P(word | its tail entry) of words by their counts; unseen ones, with count 0, share one count."""
        return np.log(np.maximum(counts, 1) / (self.rest[(h % _U(len(self.tail))).astype(np.int64)] + 1.0))


def windows(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[word, place]: entries around each word of a slice of texts; WORDS where a text ends."""
    n = len(words)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    out = np.full((n, 2 * SIDE), WORDS)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = (slice(0, max(0, n - d)), slice(d, n)) if d > 0 else (slice(-d, n), slice(0, max(0, n + d)))
        same = text[a] == text[b]
        out[a, k] = np.where(same, words[b], WORDS)
    return out


def _counts(groups: int):
    def out(h):
        h, n = np.unique(np.concatenate(h), return_counts=True)
        bucket = ((h >> _U(32)) % _U(groups)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, n, bucket = h[order], n[order].astype(np.uint32), bucket[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        cuts = [*first.tolist(), len(h)]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[first], pa.int32()), "words": [h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], "counts": [n[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    def scan(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, h, _ in word_hashes(batch.column("text")):
                if len(h):
                    held.append(h)
                    size += len(h)
                if size >= 4_000_000:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return scan


def _most(table: pa.Table) -> pa.Table:
    """The most frequent words of one bucket (no other can be among those of all), and its sums by tail entry as null words."""
    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
    words, place = np.unique(join("words", np.uint64), return_inverse=True)
    total = np.bincount(place, join("counts", np.uint32)).astype(np.int64)
    top = np.lexsort((words, -total))[:FREQUENT]
    rest = np.bincount((words % _U(REST)).astype(np.int64), total, REST).astype(np.int64)
    held, none = words[top].astype(np.int64).tolist(), [None]
    return pa.table({"word": pa.array([*held, *none * REST], pa.int64()), "entry": pa.array([*none * len(held), *range(REST)], pa.int32()), "n": pa.array([*total[top].tolist(), *rest.tolist()], pa.int64())})


def vocabulary(texts: DataFrame) -> Vocabulary:
    """The vocabulary of all of ``texts``: counts are summed over every word of the corpus."""
    groups = max(COUNT_GROUPS, texts.rdd.getNumPartitions())  # grows with the input; counts are the same for any number
    counted = texts.mapInArrow(_counts(groups), "bucket int, words binary, counts binary").groupBy("bucket").applyInArrow(_most, "word bigint, entry int, n bigint")
    counted = materialise(counted, "words")
    rows = counted.filter("word is not null").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words, n = np.array([r.word for r in rows], np.int64).astype(np.uint64), np.array([r.n for r in rows], float)
    by, rest = counted.filter("word is null").groupBy("entry").agg(F.sum("n").alias("n")).collect(), np.zeros(REST)
    for r in by:
        rest[r.entry] = r.n
    full = len(rows) == FREQUENT  # else every word has an entry of its own
    return Vocabulary(words, n, sum(r.n for r in by), rest - np.bincount((words % _U(REST)).astype(np.int64), n, REST) if full else None)


def learnt(h: np.ndarray, offs: np.ndarray, round_: int, one_in: int) -> np.ndarray:
    """Which words a round learns from: by hash of the word and its place in the text, each in one of ``one_in`` rounds."""
    place = np.arange(len(h)) - np.repeat(offs[:-1], np.diff(offs))
    return mix(h + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) % _U(one_in) == _U(round_ % one_in)


def _entries(handle):
    """Each text's vocabulary entries, two bytes a word; texts without words are left out."""

    def scan(batches):
        vocab = handle.value
        for batch in batches:
            for lo, _, h, offs in word_hashes(batch.column("text")):
                ids, some = vocab.of(h).astype(np.uint16), np.flatnonzero(np.diff(offs))
                words = pa.array([ids[offs[i] : offs[i + 1]].tobytes() for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("place").take(pa.array(some + lo)), words], names=["place", "words"])

    return scan


def _entry_slices(batch: pa.RecordBatch, vocab: Vocabulary):
    """(hashes that tell words apart, entries, offsets) of slices of a batch of texts, or of their entries."""
    if "text" in batch.schema.names:
        for _, _, h, offs in word_hashes(batch.column("text")):
            yield h, vocab.of(h), offs
    elif len(batch):
        data, offs = buffers(batch.column("words"))
        ids = np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.uint16).astype(np.int64)
        yield ids.astype(np.uint64), ids, (offs - offs[0]) // 2


def _train(handle, round_: int, one_in: int):
    def scan(batches):
        vocab, flat = handle.value
        net, seen, held = Net(flat.copy()), 0, []

        def run(held, size):
            around, word = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            for a in range(0, size, BATCH):
                net.step(around[a : a + BATCH], word[a : a + BATCH], RATE)

        size = 0
        for batch in batches:
            for h, ids, offs in _entry_slices(batch, vocab):
                pick = np.flatnonzero(learnt(h, offs, round_, one_in))
                held.append((windows(ids, offs)[pick], ids[pick]))
                size += len(pick)
                if size >= 20 * BATCH:
                    run(held, size)
                    seen, held, size = seen + size, [], 0
        if size:
            run(held, size)
            seen += size
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "seen": pa.array([seen], pa.int64()), "net": [net.flat.astype(_SENT_AS).tobytes()]})

    return scan


def _train_shard(scan):
    """``scan`` over the texts of one shard, in an order of their own."""

    def run(table: pa.Table) -> pa.Table:
        order = [("place", "ascending"), ("words", "ascending")]
        out = pa.Table.from_batches(scan(table.sort_by(order).to_batches(max_chunksize=SHARD_TEXTS)), schema=_NET)
        return out.set_column(0, "part", table.column("shard").slice(0, len(out)))

    return run


def _average(table: pa.Table, group: int) -> pa.Table:
    seen = np.array(table.column("seen").to_pylist(), float)
    total = 0.0
    for k in np.argsort(table.column("part").to_numpy(), kind="stable"):  # in the order of shards
        total = total + seen[k] / seen.sum() * np.frombuffer(table.column("net")[int(k)].as_py(), _SENT_AS)
    part = pa.array([int(table.column("part")[0].as_py()) // group], pa.int32())
    return pa.table({"part": part, "seen": pa.array([int(seen.sum())]), "net": [total.astype(_SENT_AS).tobytes()]})


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, one_in: int = LEARN_ONE_IN, group: int = 32) -> Net:
    """The network after ``rounds`` of training in all shards and averaging, up to ``group`` nets in a step.

    Shards are dealt by a hash of all columns, so equal texts with different ids do not meet in one.
    """
    kind = "part int, seen bigint, net binary"
    net = Net().begin_at(vocab.shares)
    shards = max(1, -(-int(vocab.total) // SHARD_WORDS))
    context = texts.sparkSession.sparkContext
    entries = texts.select(F.xxhash64(*texts.columns).alias("place"), "text").mapInArrow(_entries(context.broadcast(vocab)), "place bigint, words binary")
    dealt = materialise(entries, "entries").withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    for k in range(rounds):
        handle = context.broadcast((vocab, net.flat))
        nets, left = dealt.groupBy("shard").applyInArrow(_train_shard(_train(handle, k, one_in)), kind), shards
        while left > 1:
            nets = nets.withColumn("of", F.floor(F.col("part") / group)).groupBy("of").applyInArrow(lambda x: _average(x, group), kind)
            left = -(-left // group)
        got = nets.collect()
        if got:
            net = Net(np.frombuffer(got[0].net, _SENT_AS))
    return net


def _score_entries(net: Net, ids: np.ndarray, offs: np.ndarray, step: int = SCORED) -> np.ndarray:
    around, each = windows(ids, offs), np.empty(len(ids))
    for a in range(0, len(ids), step):
        each[a : a + step] = net.log_probs(around[a : a + step], ids[a : a + step])
    run = np.concatenate(([0.0], np.cumsum(each)))
    return run[offs[1:]] - run[offs[:-1]]


def score_hashes(net: Net, vocab: Vocabulary, h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Summed log-probability of the entries of each text of a slice."""
    return _score_entries(net, vocab.of(h), offs)


_SENT = "chunk bigint, bucket int, ids array<bigint>, n binary, score binary, words binary, at binary"


def _sent(chunk: int, groups: int, held: list) -> pa.RecordBatch:
    """One row with the texts of a chunk, and one for each group that has words of their tail entries."""
    ids, n, score, h, at = ([x[k] for x in held] for k in range(5))
    first = np.cumsum([0, *map(len, n)])
    h, at = np.concatenate(h), np.concatenate([x + first[k] for k, x in enumerate(at)]).astype(np.uint32)
    bucket = ((h >> _U(20)) % _U(groups)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    h, at, keys = h[order], at[order], np.unique(bucket)
    cuts = np.searchsorted(bucket[order], [*keys, groups])
    none, k = [None] * len(keys), len(keys)
    text = pa.array([pa.concat_arrays(ids).to_pylist(), *none], pa.list_(pa.int64()))
    cut = lambda x: pa.array([None, *(x[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))], pa.binary())
    one = lambda x, kind: pa.array([np.concatenate(x).astype(kind).tobytes(), *none], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([chunk] * (k + 1), pa.int64()), pa.array([chunk % groups, *keys.tolist()], pa.int32()), text, one(n, np.int64), one(score, np.float64), cut(h), cut(at)], names=["chunk", "bucket", "ids", "n", "score", "words", "at"])


def _shares(handle):
    """Texts as they come; for words, their counts in the corpus and from those ln P(word | entry), summed by text."""

    def run(table: pa.Table) -> pa.Table:
        vocab = handle.value[0]
        rare = table.filter(table.column("words").is_valid())
        texts = table.filter(table.column("words").is_null()).drop_columns(["words"])
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in rare.column("words")]
        scores, ats = [], []
        if parts:
            words, place, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            each = vocab.log_share(words, counts)[place]
            ends = np.cumsum([len(x) for x in parts])
            for a, b, at in zip([0, *ends], ends, rare.column("at")):
                at = np.frombuffer(at.as_py(), np.uint32)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                scores.append(np.add.reduceat(each[a:b], first).tobytes())
                ats.append(at[first].tobytes())
        none = [None] * len(parts)
        out = [rare.column("chunk"), rare.column("bucket"), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.binary()), pa.array(scores, pa.binary()), pa.array(ats, pa.binary())]
        return pa.concat_tables([texts, pa.table(out, names=texts.column_names).cast(texts.schema)])

    return run


def _joined(table: pa.Table) -> pa.Table:
    """The texts of a chunk with all their shares, added in a fixed order."""
    rows = table.sort_by("bucket").select(["ids", "n", "score", "at"]).to_pylist()
    of = next(r for r in rows if r["at"] is None)
    score = np.frombuffer(of["score"], np.float64).copy()
    for r in rows:
        if r["at"] is not None:
            score[np.frombuffer(r["at"], np.uint32)] += np.frombuffer(r["score"], np.float64)
    return pa.table({"doc_id": pa.array(of["ids"], pa.int64()), "n_words": pa.array(np.frombuffer(of["n"], np.int64)), "log_prob": pa.array(score)})


def scores(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, log_prob (summed) and mean_log_prob (null without words)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocab = vocabulary(slim.select("text"))
    net = train(slim, vocab)
    handle = docs.sparkSession.sparkContext.broadcast((vocab, net.flat))
    groups = max(SHARE_GROUPS, -(-int(vocab.rest.sum()) // SHARE_GROUP_WORDS))

    def scan(batches):
        vocab, flat = handle.value
        net, chunk = Net(flat), TaskContext.get().partitionId() << 32
        held, n_texts, n_words = [], 0, 0
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, h, offs in word_hashes(batch.column("text")):
                entries = vocab.of(h)
                rare = np.flatnonzero(vocab.in_tail[entries])
                at = np.searchsorted(offs, rare, "right") - 1
                held.append((ids.slice(lo, hi - lo), np.diff(offs), _score_entries(net, entries, offs), h[rare], at))
                n_texts, n_words = n_texts + hi - lo, n_words + len(rare)
                if n_texts >= SENT_TEXTS or n_words >= SENT_WORDS:
                    yield _sent(chunk, groups, held)
                    held, n_texts, n_words, chunk = [], 0, 0, chunk + 1
        if held:
            yield _sent(chunk, groups, held)

    sent = slim.mapInArrow(scan, _SENT).groupBy("bucket").applyInArrow(_shares(handle), _SENT.replace(" words binary,", ""))
    out = sent.groupBy("chunk").applyInArrow(_joined, "doc_id bigint, n_words bigint, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
