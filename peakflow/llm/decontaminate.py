"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items of the benchmark are sorted into size classes [2**c, 2**(c+1)) by their
distinct five-word shingles. For each class a document is cut into windows of
four times the class's least size, half overlapping, so that the two sides of a
comparison have like sizes however long the document is: a short item inside a
20,000-word text keeps a Jaccard similarity with some window that one band of
one hash catches. A window that has the same minimum as an item under any of
``HASHES`` hash functions is a candidate; the share of the item's shingles in
the whole document then decides, exactly.

Recall: over a document that holds a share t >= 0.75 of an item's shingles,
wherever they are, the chance that one hash finds it is at least
sum(|Q & W| / |Q | W|) >= 0.75 / 5 = 0.15 over its windows, so that all 96 miss
with chance under 0.85**96 = 2e-7; for a passage in one piece it is under
(1 - 1/4)**96 = 1e-12.

Up to ``BLOCK_ITEMS`` items of ``BLOCK_BYTES`` in all travel to the tasks, and
documents are read once and never shuffled. A greater benchmark stays
distributed: its minima are one side of a join, documents send the minima that
a filter of fixed size lets through (64 bits each, so chance agreements are
rare), and a second reading sends the shingles of texts that have a candidate,
for the exact check. The number of readings does not grow with the benchmark,
and neither items nor candidates reach the driver. There, texts are told apart
by 128 bits, so copies are looked up once.

Defined cases: null and empty texts and items hold nothing and match nothing;
items of fewer than five words are one shingle, matched only by documents that
are that sequence; repeated rows are judged one by one; empty tables give empty
results; other columns are ignored by :func:`leaks` and kept by
:func:`clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise
from ._text import mix, shingle_hashes, slice_shingles, word_hashes

SHINGLE = 5
LEAST = 0.75
HASHES = 96
#: Most items, and their bytes of text, that each task holds; more are joined.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Bits of a filter of keys at most, as a power of two (32 MB), and of one piece of it.
FILTER_BITS, PIECE_BITS = 28, 19
#: Candidates of one text that are checked together.
CHECKED = 20_000
#: Shingles of a document for which minima are kept at once.
PIECE = 1 << 18

_U = np.uint64
_SEEN_BITS = 22
_SEEN = _U((1 << _SEEN_BITS) - 1)
_ODD_WIDE = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)
_ODD = _ODD_WIDE.astype(np.uint32)


class Index:
    """The items of a small benchmark by size class: signatures sorted for search, and their shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        ids, sets = [], []
        for (item, _), s in zip(items, _sets(pa.array([t for _, t in items], pa.string())), strict=True):
            if len(s):
                ids.append(item)
                sets.append(s)
        self.ids, self.sets = ids, sets
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            by.setdefault(len(s).bit_length() - 1, []).append(k)
        for c, members in by.items():
            keys = np.concatenate([_minima(sets[k], np.array([0]))[:, 0] for k in members])
            owner = np.repeat(np.array(members), HASHES)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _SEEN_BITS, bool)  # most minima are told apart here, without a search
            seen[keys & _SEEN] = True
            self.classes[c] = keys[order], owner[order], seen


def _sets(column) -> Iterator[np.ndarray]:
    for lo, hi, h, offs in word_hashes(column):
        for i in range(hi - lo):
            yield np.unique(shingle_hashes(h[offs[i] : offs[i + 1]], SHINGLE))


def _minima(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """[hash, block]: minimum of each hash function over the blocks of ``s`` that begin at ``cuts``.

    The low seven bits tell the hash function, so minima of different functions never agree.
    """
    out = np.empty((HASHES, len(cuts)), np.uint32)
    high = (s >> _U(32)).astype(np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(high * _ODD[k], cuts)
    return out.astype(np.uint64) << _U(7) | np.arange(HASHES, dtype=np.uint64)[:, None]


def _wide_minima(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """:func:`_minima` of 64 bits; nothing tells the hash function."""
    return np.stack([np.minimum.reduceat(s * odd, cuts) for odd in _ODD_WIDE])


def _windows(s: np.ndarray, offs: np.ndarray, classes, minima=_minima) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, minima [hash, window], text of each window) for each size class.

    Text i has the shingles ``s[offs[i]:offs[i+1]]``. All texts are cut
    together: first into blocks of half the smallest window, which then make the
    half and full windows of each class.
    """
    if not len(s) or not classes:
        return
    step = 2 << min(classes)
    blocks = -(-np.diff(offs) // step)
    text = np.repeat(np.arange(len(blocks)), blocks)
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(text)) - first[text]
    low = minima(s, offs[text] + place * step)
    for c in classes:
        cuts = np.flatnonzero(place % ((2 << c) // step) == 0)
        half, own = np.minimum.reduceat(low, cuts, axis=1) if len(cuts) < low.shape[1] else low, text[cuts]
        full = half.copy()
        both = np.flatnonzero(own[1:] == own[:-1])
        full[:, both] = np.minimum(half[:, both], half[:, both + 1])
        yield c, full, own


def candidates(s: np.ndarray, offs: np.ndarray, index: Index) -> list[set[int]]:
    """For each text of a slice the items (by place) that share a minimum with one of its windows."""
    found: list[set[int]] = [set() for _ in offs[1:]]
    for c, full, own in _windows(s, offs, index.classes):
        keys, owner, seen = index.classes[c]
        where = np.nonzero(seen[full & _SEEN])
        for v, i in set(zip(full[where].tolist(), own[where[1]].tolist(), strict=True)):
            v = _U(v)
            found[i].update(owner[np.searchsorted(keys, v) : np.searchsorted(keys, v, "right")].tolist())
    return found


def _slice_candidates(s: np.ndarray, offs: np.ndarray, index: Index) -> list[set[int]]:
    """:func:`candidates`, in overlapping pieces where the slice is one very long text."""
    if len(offs) > 2 or len(s) <= PIECE or not index.classes:
        return candidates(s, offs, index)
    overlap = 4 << max(index.classes)
    out: set[int] = set()
    for a in range(0, len(s), PIECE):
        part = s[a : a + PIECE + overlap]
        out |= candidates(part, np.array([0, len(part)]), index)[0]
    return [out]


def shared(s: np.ndarray, item: np.ndarray) -> int:
    """Shingles of ``item`` that are in the sorted, distinct ``s``."""
    at = np.minimum(np.searchsorted(s, item), len(s) - 1)
    return int((s[at] == item).sum())


def _found(column, index: Index, least: float) -> Iterator[list[tuple[int, int, int]]]:
    """For each row: (item, shingles shared, shingles of the item) of the items that it holds."""
    for lo, hi, h, offs in word_hashes(column):
        shingles, cuts = slice_shingles(h, offs, SHINGLE)
        for i, places in enumerate(_slice_candidates(shingles, cuts, index)):
            s = np.unique(shingles[cuts[i] : cuts[i + 1]]) if places else None
            out = []
            for k in sorted(places):
                item = index.sets[k]
                n = shared(s, item)
                if 100 * n >= round(100 * least) * len(item):
                    out.append((index.ids[k], n, len(item)))
            yield out


def _held(benchmark: DataFrame, items: int, size: int) -> list[tuple[int, str]] | None:
    """The items of a benchmark of at most that count and size; None for a greater one."""
    said = benchmark.select("item_id", "text").filter("text is not null")
    n, held = said.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if n > items or (held or 0) > size:
        return None
    return [(r.item_id, r.text) for r in said.orderBy("item_id", "text").collect()]


def _signed(batches):
    """Items with words: their shingles, a name for those, their size class and their minima."""
    for batch in batches:
        ids, names, sets, classes, least = [], [], [], [], []
        for item, s in zip(batch.column("item_id").to_pylist(), _sets(batch.column("text")), strict=True):
            if len(s):
                ids.append(item)
                sets.append(s.tobytes())
                names.append(hashlib.blake2b(sets[-1], digest_size=16).digest())
                classes.append(len(s).bit_length() - 1)
                least.append(_wide_minima(s, np.array([0]))[:, 0].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary()), pa.array(sets, pa.binary()), pa.array(classes, pa.int32()), pa.array(least, pa.list_(pa.int64()))], names=["item_id", "name", "shingles", "class", "least"])


def _filter(keys: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Bits, one for each residue of a key (the only column, bigint), at most 2**``most`` of them; made in pieces."""
    n = keys.count()
    bits = min(most, max(PIECE_BITS, (16 * n).bit_length()))

    def piece(table: pa.Table) -> pa.Table:
        mask = np.zeros(1 << PIECE_BITS, bool)
        mask[table.column("at").to_numpy() & ((1 << PIECE_BITS) - 1)] = True
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary())})

    at = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(1 << bits)).alias("at")).distinct()
    made = at.withColumn("piece", F.shiftright("at", PIECE_BITS)).groupBy("piece").applyInArrow(piece, "piece bigint, bits binary")
    out = np.zeros((1 << bits - PIECE_BITS, 1 << PIECE_BITS - 3), np.uint8)
    for r in made.collect():
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.uint64) & _U(8 * len(bits) - 1)
    return (bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def _hits(handle):
    """(text key, minimum) of the minima of texts that the filter lets through."""

    def scan(batches):
        bits, classes = handle.value
        for batch in batches:
            for lo, hi, h, offs in word_hashes(batch.column("text")):
                s, cuts = slice_shingles(h, offs, SHINGLE)
                overlap = PIECE + (4 << max(classes))
                # One very long text is taken in overlapping pieces.
                parts = [(s, cuts)] if len(cuts) > 2 else [(x, np.array([0, len(x)])) for x in (s[a : a + overlap] for a in range(0, len(s), PIECE))]
                text, least = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for x, at in parts:
                    for _, full, own in _windows(x, at, classes, _wide_minima):
                        where = np.nonzero(_passes(bits, full))
                        text.append(own[where[1]])
                        least.append(full[where])
                rows = pa.array(np.concatenate(text) + lo)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(np.concatenate(least).astype(np.int64))], names=["k1", "k2", "least"])

    return scan


def _sent(handle):
    """The shingles of texts whose key the filter lets through."""

    def scan(batches):
        bits = handle.value
        for batch in batches:
            batch = batch.filter(pa.array(_passes(bits, batch.column("k1").to_numpy())))
            for k, s in enumerate(_sets(batch.column("text"))):
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("k1"), one.column("k2"), pa.array([s.tobytes()], pa.binary())], names=["doc_id", "k1", "k2", "own"])

    return scan


def _check(least: float):
    def run(pairs: pa.Table, text: pa.Table) -> pa.Table:
        names, n, of = [], [], []
        if len(text) and len(pairs):
            s = np.frombuffer(text.column("own")[0].as_py(), np.uint64)
            for name, raw in zip(pairs.column("name"), pairs.column("shingles"), strict=True):
                item = np.frombuffer(raw.as_py(), np.uint64)
                both = shared(s, item)
                if 100 * both >= round(100 * least) * len(item):
                    names.append(name.as_py())
                    n.append(both)
                    of.append(len(item))
        key = [pa.array([pairs.column(c)[0].as_py()] * len(n) if n else [], pa.int64()) for c in ("k1", "k2")]
        return pa.table([*key, pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], names=["k1", "k2", "name", "n_shared", "n_item"])

    return run


def _keyed(docs: DataFrame, k1: str = "k1", k2: str = "k2") -> DataFrame:
    return docs.withColumn(k1, F.xxhash64("text")).withColumn(k2, F.xxhash64(F.lit(7), "text"))


def _joined(slim: DataFrame, benchmark: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(items, texts, verdicts) of a benchmark that no task holds; None if it has no words."""
    context = slim.sparkSession.sparkContext
    said = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    items = materialise(said.mapInArrow(_signed, "item_id bigint, name binary, shingles binary, class int, least array<bigint>"), "items")
    classes = sorted(r["class"] for r in items.select("class").distinct().collect())  # powers of two: a few dozen at most
    if not classes:
        return None
    distinct = items.groupBy("name").agg(F.first("shingles").alias("shingles"), F.first("least").alias("least"))
    minima = materialise(distinct.select("name", F.explode("least").alias("least")), "minima")
    handle = context.broadcast((_filter(minima.select("least")), classes))
    docs = _keyed(slim)
    hits = docs.select("text", "k1", "k2").mapInArrow(_hits(handle), "k1 bigint, k2 bigint, least bigint").distinct()
    pairs = materialise(hits.join(minima, "least").select("k1", "k2", "name").distinct(), "candidates")
    bits = context.broadcast(_filter(pairs.select("k1").distinct()))
    texts = materialise(docs.mapInArrow(_sent(bits), "doc_id bigint, k1 bigint, k2 bigint, own binary"), "texts")
    parts = pairs.groupBy("k1", "k2").agg(F.ceil(F.count(F.lit(1)) / CHECKED).cast("int").alias("parts"))
    left = pairs.join(parts, ["k1", "k2"]).withColumn("part", F.pmod(F.hash("name"), F.col("parts"))).drop("parts")
    left = left.join(distinct.select("name", "shingles"), "name")
    right = texts.groupBy("k1", "k2").agg(F.first("own").alias("own")).join(parts, ["k1", "k2"])
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = ["k1", "k2", "part"]
    verdicts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_check(least), "k1 bigint, k2 bigint, name binary, n_shared bigint, n_item bigint")
    return items, texts, materialise(verdicts, "verdicts")


_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])
_LEAKS_SQL = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"


def _scan(handle, least: float):
    def scan(batches):
        index = Index(handle.value)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(d, *x) for d, found in zip(ids, _found(batch.column("text"), index, least), strict=True) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_LEAKS)], schema=_LEAKS)

    return scan


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, held: int = BLOCK_ITEMS, size: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document that holds an item.

    A benchmark of at most ``held`` items and ``size`` bytes goes to the tasks.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    block = _held(benchmark, held, size)
    if block is not None:
        out = slim.mapInArrow(_scan(spark.sparkContext.broadcast(block), least), _LEAKS_SQL)
    elif (found := _joined(slim, benchmark, least)) is not None:
        items, texts, verdicts = found
        named = verdicts.join(items.select("name", "item_id"), "name")
        out = texts.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "item_id", "n_shared", "n_item")
    else:
        out = spark.createDataFrame([], _LEAKS_SQL)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, held: int = BLOCK_ITEMS, size: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Nothing is joined by id, so repeated and null ids are safe: with a small
    benchmark a task judges the rows it reads, with a greater one a text's key
    tells, and only rows that a filter of the keys found lets through are shuffled.
    """
    spark = docs.sparkSession
    block = _held(benchmark, held, size)
    if block is not None:
        handle = spark.sparkContext.broadcast(block)

        def keep(batches):
            index = Index(handle.value)
            for batch in batches:
                ok = pa.array([not found for found in _found(batch.column("text"), index, least)], pa.bool_())
                yield batch.filter(ok)

        return docs.mapInArrow(keep, docs.schema)
    found = _joined(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), benchmark, least)
    if found is None:
        return docs
    leaked = found[2].select("k1", "k2").distinct()
    bits = spark.sparkContext.broadcast(_filter(leaked.select("k1")))
    maybe = F.pandas_udf(lambda k: pd.Series(_passes(bits.value, k.to_numpy())), "boolean")
    k1, k2 = (next(n for n in (f"{k}{'_' * i}" for i in range(1, 99)) if n.lower() not in map(str.lower, docs.columns)) for k in ("k1", "k2"))
    keyed = _keyed(docs, k1, k2)
    there = leaked.withColumnsRenamed({"k1": k1, "k2": k2})
    doubtful = keyed.filter(maybe(k1)).join(there, [k1, k2], "left_anti")
    return keyed.filter(~maybe(k1)).unionByName(doubtful).select(*[f"`{c}`" for c in docs.columns])
