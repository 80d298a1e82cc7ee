"""Token ids in training order, as binary shards of fixed-size records.

Documents are tokenised, ended with a separator and cut in sequences of a fixed
length; the last is padded and its true length kept. A keyed Feistel network
over the index space (id, sequence number) with cycle-walking gives every
sequence a place: a permutation that any task can work out alone, and that no
layout of partitions changes. The space is as wide as ids and texts ask for, up
to 128 bits, so different ids never share a place. Places are cut in equal ranges; each range is
one shard, written in order of place, so a record's offset is its rank times
the stride and reading can start anywhere. Its global slot is that rank plus
the sequences in all shards before, from the manifest. Places are uniform, so
no shard or task gets more than its share, whatever the ids, texts or sources.

Shards are written under a temporary name and renamed, so a task that runs
twice leaves the same file. Tokens are shuffled once and never kept elsewhere.

Defined cases: null and empty texts give the separator alone; a null id takes
the place after the largest id; rows that repeat an id share places and are
ordered by their tokens; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, scratch_path
from ._text import release

#: Where the public vocabularies are; a parameter of everything below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEQUENCE = 512
SHARD_BYTES = 8 << 20
KEY = 20_240_607
ROUNDS = 4
_U = np.uint64
_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The byte-pair encoder of a vocabulary file, made once in each Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _round(x: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (x + _U(key & (2**64 - 1))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(32))) & _U((1 << bits) - 1)


def _feistel(left: np.ndarray, right: np.ndarray, half: int, key: int, rounds: int = ROUNDS, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    for k in range(rounds):
        if back:
            left, right = right ^ _round(left, key * 0x5851F42D4C957F2D + rounds - 1 - k, half), left
        else:
            left, right = right, left ^ _round(right, key * 0x5851F42D4C957F2D + k, half)
    return left, right


def half_bits(size: int) -> int:
    """Bits of each half of an index below ``size``."""
    return max(1, (max(1, size - 1).bit_length() + 1) // 2)


def permute_halves(left: np.ndarray, right: np.ndarray, size: int, key: int = KEY, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keyed permutation of [0, size), at most 2**128: Feistel over the next even power of two, walked until inside.

    Indices come and go as their upper and lower ``half_bits(size)`` bits.
    """
    half = half_bits(size)
    top, low = _U((size - 1) >> half), _U((size - 1) & (1 << half) - 1)
    left, right = _feistel(left, right, half, key, back=back)
    while (out := (left > top) | (left == top) & (right > low)).any():
        left[out], right[out] = _feistel(left[out], right[out], half, key, back=back)
    return left, right


def permute(x: np.ndarray, size: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """:func:`permute_halves` of whole indices, below 2**62."""
    x, half = np.asarray(x, np.uint64), _U(half_bits(size))
    left, right = permute_halves(x >> half, x & ((_U(1) << half) - _U(1)), size, key, back)
    return left << half | right


class Space:
    """The index space: how (id, sequence number) becomes one number below ``size``."""

    def __init__(self, low: int, high: int, most_bytes: int, sequence: int):
        self.low = low
        self.per = (most_bytes + 1) // sequence + 1  # a token is a byte at least
        self.ids = high - low + 2  # the last is for null
        self.size = self.ids * self.per
        self.half = half_bits(self.size)

    def index(self, doc_id, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower halves of the indices of the n sequences of a document."""
        first = (self.ids - 1 if doc_id is None else doc_id - self.low) * self.per
        mask = (1 << self.half) - 1
        if (first & mask) + n <= mask:  # the upper half stays
            return np.full(n, first >> self.half, np.uint64), _U(first & mask) + np.arange(n, dtype=np.uint64)
        at = range(first, first + n)
        return np.array([x >> self.half for x in at], np.uint64), np.array([x & mask for x in at], np.uint64)

    def shard(self, left: np.ndarray, right: np.ndarray, shards: int) -> np.ndarray:
        """Which of ``shards`` equal ranges of places each place is in."""
        # The leading bits are enough where the space is wide; ranges then differ by under one in 2**20.
        off = max(0, self.size.bit_length() - 62)
        if off:
            place = (left << _U(self.half - off) | right >> _U(off)) if off < self.half else left >> _U(off - self.half)
        else:
            place = left << _U(self.half) | right
        return place // _U(-(-(((self.size - 1) >> off) + 1) // shards))


_ROWS = pa.schema([("shard", pa.int32()), ("upper", pa.int64()), ("lower", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("n_tokens", pa.int32()), ("tokens", pa.binary())])
_ROWS_SQL = "shard int, upper bigint, lower bigint, doc_id bigint, seq int, n_tokens int, tokens binary"


def _tokenise(path: str, space: Space, shards: int, sequence: int, key: int):
    def scan(batches):
        enc = encoder(path)
        kind, end = (np.uint16 if enc.max_token_value + 1 < 1 << 16 else np.uint32), enc.max_token_value + 1

        def out(held):
            index = [space.index(d, -(-len(t) // sequence)) for d, t in held]
            upper, lower = permute_halves(*map(np.concatenate, zip(*index)), space.size, key)
            ids, seq, n, raw = [], [], [], []
            for d, t in held:
                for k in range(0, len(t), sequence):
                    ids.append(d)
                    seq.append(k // sequence)
                    n.append(min(sequence, len(t) - k))
                    raw.append(t[k : k + sequence].tobytes())
            columns = [space.shard(upper, lower, shards), upper, lower, ids, seq, n, raw]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

        for batch in batches:
            held, size = [], 0
            for d, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.encode_to_numpy(value.as_py() or "", disallowed_special=()).astype(kind)
                held.append((d, np.append(ids, kind(end))))
                size += len(ids)
                if size >= 500_000:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)
            release()

    return scan


def _store(path: str):
    """(file system, path in it) of a folder in the shared store."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_WRITTEN = pa.schema([("shard", pa.int32()), ("record", pa.int32()), ("doc_id", pa.int64()), ("seq", pa.int32()), ("n_tokens", pa.int32()), ("sha256", pa.string())])


def _write(folder: str, stride: int):
    def group(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("upper", "lower", "tokens", "doc_id", "seq", "n_tokens")), strict=True), key=lambda r: (*r[:3], r[4]))
        shard = table.column("shard")[0].as_py()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, part = f"{base}/shard-{shard:07d}.bin", f"{base}/.{uuid.uuid4().hex}"
        digests = []
        with store.open_output_stream(part) as f:
            for r in rows:
                record = r[2].ljust(stride, b"\0")
                digests.append(hashlib.sha256(record).hexdigest())
                f.write(record)
        store.move(part, name)
        release()
        return pa.table([pa.array(c, f.type) for c, f in zip([[shard] * len(rows), range(len(rows)), [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], digests], _WRITTEN, strict=True)], schema=_WRITTEN)

    return group


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, shard_bytes: int = SHARD_BYTES, key: int = KEY) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text) to ``folder``; one row a sequence.

    Returns doc_id, seq, n_tokens, shard, record (rank in the shard), slot
    (global) and sha256 of the record, kept in shared scratch. A record's bytes
    are at record * sequence * bytes per id.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    low, high, most, total, rows = slim.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    space = Space(low or 0, high if high is not None else (low or 0), most or 0, sequence)
    enc = encoder(vocabulary)
    width = 2 if enc.max_token_value + 1 < 1 << 16 else 4
    # Bytes of text over-state tokens a little more than padding adds.
    shards = max(1, -(-((total or 0) * width // 2 + rows * width * sequence // 2) // shard_bytes))
    made = slim.mapInArrow(_tokenise(vocabulary, space, shards, sequence, key), _ROWS_SQL)
    done = made.groupBy("shard").applyInArrow(_write(folder, width * sequence), "shard int, record int, doc_id bigint, seq int, n_tokens int, sha256 string")
    done = materialise(done, "sequences")
    each = done.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    before = each.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    side = F.broadcast(before) if shards <= 1_000_000 else before
    return done.join(side, "shard").select("doc_id", "seq", "n_tokens", "shard", "record", (F.col("before") + F.col("record")).alias("slot"), "sha256")


def read_records(folder: str, shard: int, start: int = 0, count: int | None = None, sequence: int = SEQUENCE, kind=np.uint16) -> np.ndarray:
    """Records [start, start+count) of a shard, read in sequence from that offset."""
    store, base = _store(folder)
    stride = sequence * np.dtype(kind).itemsize
    with store.open_input_file(f"{base}/shard-{shard:07d}.bin") as f:
        size = f.size() // stride
        count = size - start if count is None else min(count, size - start)
        return np.frombuffer(f.read_at(count * stride, start * stride), kind).reshape(count, sequence)


def sequence_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Shards in shared scratch, and one row for each sequence that they hold."""
    return write_shards(docs, scratch_path(docs.sparkSession, "shards"), vocabulary)
