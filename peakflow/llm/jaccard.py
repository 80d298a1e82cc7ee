"""N-gram Jaccard join: which documents share three quarters of their word shingles.

Size-aware. Sets up to a boundary are *light*: each lists its subsets of every
size that a partner of its own or greater size could demand, and two light sets
are linked exactly if they list the same subset of the size their sizes ask
for. Larger sets are *heavy* and look each other up in inverted lists. The
boundary is where the subsets of a set, summed over all documents, would cost
more than its list entries and the check of its shingles.

Heavy sets enter lists only with their rarest shingles: sharing 3/7 of both
sizes, two linked sets must share k of the first ``n - ceil(3n/4) + k`` in any
order that is the same for all, for every k. Frequent shingles come last in
that order, so passages that many documents repeat are not looked up; a table
of fixed size tells every task each shingle's class, so no limit of frequent
shingles lets chance unite groups as tables grow. A long
list makes a chain of neighbours in size, never all pairs; of short lists
(``SHORT`` sets at most) each pair is counted, and counts only if the lists
that hold both reach k, which grows with the sets: single shingles shared by
chance do not. Chains and such pairs give coarse groups that no link leaves. A
group's sets then meet once: a breadth-first walk scans the group's
inverted lists from each set for those not yet reached, so a thousand near
copies cost a few scans. Groups above ``GROUP_SHINGLES`` are cut in blocks by
size and hash. The sets of a block meet, and with them a few leaders of the
whole group, which go to every block of fitting sizes: a large group of copies is
one component after that. Only sets outside a group's largest component then
meet the blocks of the rest, so the cost beyond one reading is the blocks of
those sets times the blocks of the group.

Equal sets are one node throughout. A node is a 64-bit hash of a set; sets that
agree in it but not in a second one are found by counting and get the second as
their node, so equality rests on 128 bits. Shingles are compared by 64-bit hashes.

What is dealt out by hash goes to ``FAN`` buckets at most in one step; more
buckets are made in a second one, so that no task cuts its rows finer than that.

Defined cases: a null, empty or blank text has an empty set, no link, and is
its own component; fewer than five words make one shingle; a null id is never
the least id of a component that has another; repeated rows are linked like
other copies; empty tables give empty results; other columns are ignored by
:func:`components_of` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import graph
from ._spark import materialise
from ._text import mix, release, shingle_sets

SHINGLE = 5
#: Shingles that one group of buckets, bins or blocks holds in a task at most (8 bytes each).
BUCKET_SHINGLES = 1_500_000
GROUP_SHINGLES = 150_000
#: Buckets that one step deals out to; what a task holds of a bucket's rows before it cuts them finer, in bytes.
FAN = 4096
FINER_BYTES = 32 << 20
#: Documents that a task counts at once, and buckets that hold those without words.
COUNT_ROWS, BLANK_BUCKETS = 100_000, 64
#: Leaders of each band of sizes of a large group, at most.
LEADERS = 8
#: Bins of whole groups, at least: small groups spread evenly.
BINS_LEAST = 64
#: Cells of the table that tells all tasks how often shingles occur, and cells of each bucket in it, at most (two bits
#: each, so 64 MB whatever the input). Every frequent shingle is in its cell; a rare one that shares it passes for frequent.
CELLS, BUCKET_CELLS = 1 << 28, 1 << 18
#: Group members told to all tasks: at most so many rows and parts, else they are joined by a shuffle.
TOLD = 500_000
#: Lists of so many sets at most have their pairs counted.
SHORT = 8
#: Least counts of the classes of frequent shingles. Those of the second and third may make long lists.
FREQUENT_LEAST = (4, SHORT + 1, 64)
#: Boundaries that are tried. A set of eight or more shingles always has more subsets than it costs as a heavy one.
BOUNDARIES = range(65)
_U = np.uint64


def needed(a: int, b: int) -> int:
    """Shingles that sets of sizes a and b must share to be linked: 100*i >= 75*(a+b-i)."""
    return -(-3 * (a + b) // 7)


def shares(n: int) -> int:
    """List entries that a set must share with any linked set of as many or more."""
    return 1 + n // 64


def prefix(n: int) -> int:
    """List entries of a set: any linked set shares at least the fewer of both sets' ``shares``."""
    return n - (3 * n + 3) // 4 + shares(n)


def subset_sizes(n: int) -> range:
    """Sizes of the subsets that a set lists: all that any partner could ask for."""
    return range((3 * n + 3) // 4, n + 1)


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(min(k, n - k)):
        out = out * (n - i) // (i + 1)
    return out


def boundary(histogram: dict[int, int]) -> int:
    """The size up to which sets are light, from numbers of sets by size.

    A light set costs its subsets; a heavy one its list entries and a check of
    its shingles. Light sets near the boundary pay both, for heavy partners.
    """

    def cost(x: int) -> int:
        total = 0
        for n, many in histogram.items():
            if n <= x:
                total += many * sum(_choose(n, o) for o in subset_sizes(n))
            if n > x or 4 * n >= 3 * (x + 1):
                total += many * (prefix(n) + n)
        return total

    return min(BOUNDARIES, key=cost)


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers; 0 for the empty set."""
    if not len(s):
        return 0, 0
    ends = mix(np.array([np.bitwise_xor.reduce(mix(s)), np.add.reduce(s)], np.uint64))
    both = np.array([np.add.reduce(ends), mix(ends[:1])[0] ^ (ends[1] >> _U(1))], np.uint64)
    return tuple(both.astype(np.int64).tolist())


def fingerprint(s: np.ndarray, odd=frozenset()) -> int:
    """The node of a set: its first hash, or the second where sets in ``odd`` differ in spite of the first."""
    one, two = fingerprints(s)
    return two if one in odd else one


def _bucket(s: np.ndarray, n: int) -> np.ndarray:
    return (s >> _U(32)) % _U(n)


def _width(n: int) -> int:
    """Cells of each of ``n`` buckets in the table of classes."""
    return max(4, min(BUCKET_CELLS, CELLS // n) // 4 * 4)


def _cell(low: np.ndarray, width: int) -> np.ndarray:
    """Cells of shingles in their bucket, by the lower half of their hash."""
    return ((low & _U(0xFFFFFFFF)) * _U(width)) >> _U(32)


def _coarse(bucket: np.ndarray, fan: int) -> np.ndarray:
    """The bucket of the first of two steps, or the only one."""
    return bucket % _U(fan)


def _dealt(values: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The buckets that have values, and each one's values as bytes: one sort, whatever the number of buckets."""
    order = np.argsort(buckets, kind="stable")
    of, values = buckets[order], np.ascontiguousarray(values[order])
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    offs = np.append(first, len(of)) * values.itemsize
    return of[first].astype(np.int32), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _finer(df: DataFrame, n: int, kind: np.dtype, column: str, bucket) -> DataFrame:
    """``df`` of (bucket, ``column``) in its ``n`` buckets, if the first step made coarse ones: rows that are not values pass."""
    if n <= FAN:
        return df
    schema = df.schema

    def scan(batches):
        held, size = [], 0

        def out():
            keys, parts = _dealt(v := np.concatenate(held), bucket(v, n))
            none = lambda f: pa.nulls(len(keys), to_arrow_type(f.dataType))
            return pa.RecordBatch.from_arrays([pa.array(keys) if f.name == "bucket" else parts if f.name == column else none(f) for f in schema], names=schema.names)

        for batch in batches:
            values = batch.column(column)
            rest = batch.filter(values.is_null())
            if len(rest):
                yield rest
            held += [np.frombuffer(x, kind) for x in values.drop_null().to_pylist()]
            size += values.nbytes
            if size >= FINER_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return df.repartition("bucket").mapInArrow(scan, schema)


# --- first reading: how often shingles occur, and each document's set size and fingerprints

_ROWS = {"ids": pa.int64(), "sizes": pa.int64(), "prints": pa.int64(), "seconds": pa.int64()}
_ROWS_SQL = ", ".join(f"{c} array<bigint>" for c in _ROWS)


def _count_map(n: int):
    """Shingles by bucket, and rows of documents dealt in turn to the buckets that a task has."""
    kind = pa.schema([("bucket", pa.int32()), ("shingles", pa.binary()), *((c, pa.list_(t)) for c, t in _ROWS.items())])

    def scan(batches):
        turn = int(mix(np.array([TaskContext.get().partitionId() + 1], np.uint64))[0] % _U(n))

        def out(held, rows):
            s = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if n > FAN:
                keys, parts = _dealt(s, _coarse(_bucket(s, n), FAN))
            else:  # the bucket says the upper half
                s = np.sort((_bucket(s, n) << _U(32)) | (s & _U(0xFFFFFFFF)))
                keys, parts = _dealt(s.astype(np.uint32), s >> _U(32))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), parts, *(pa.nulls(len(keys), pa.list_(t)) for t in _ROWS.values())], schema=kind)
            most = min(n, BLANK_BUCKETS)
            at = keys if len(keys) >= most else (turn + np.arange(most)) % n  # rows go to many buckets, whatever the shingles
            of = (np.arange(len(rows)) + turn) % len(at)
            order = np.argsort(of, kind="stable")
            used = np.unique(of)
            cuts = pa.array(np.append(np.searchsorted(of[order], used), len(rows)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array([rows[i][k] for i in order], t)) for k, t in enumerate(_ROWS.values())]
            yield pa.RecordBatch.from_arrays([pa.array(at[used], pa.int32()), pa.nulls(len(used), pa.binary()), *lists], schema=kind)

        held, rows, size = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, s in shingle_sets(batch.column("text"), SHINGLE):
                held.append(s)
                rows.append((ids[i], len(s), *fingerprints(s)))
                size += len(s)
                if size >= 500_000 or len(rows) >= COUNT_ROWS:
                    yield from out(held, rows)
                    turn += len(rows)
                    held, rows, size = [], [], 0
        if rows:
            yield from out(held, rows)

    return scan


def _count_group(n: int):
    """Classes of a bucket's shingles by cell, the greatest of a cell, four to a byte; and the bucket's rows."""
    kind = pa.schema([("bucket", pa.int32()), ("cells", pa.binary()), *((c, pa.list_(t)) for c, t in _ROWS.items())])

    def group(table: pa.Table) -> pa.Table:
        half = np.uint32 if n <= FAN else np.uint64
        s = [np.frombuffer(x, half) for x in table.column("shingles").drop_null().to_pylist()]
        values, counts = np.unique(np.concatenate([*s, np.zeros(0, half)]), return_counts=True)
        of = np.zeros(_width(n), np.uint8)
        for k, least in enumerate(FREQUENT_LEAST, 1):
            of[_cell(values[counts >= least].astype(np.uint64), len(of))] = k
        packed = (of.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
        rows = [table.column(c).combine_chunks().flatten() for c in _ROWS]
        rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in rows]
        return pa.Table.from_arrays([table.column("bucket")[:1].combine_chunks(), pa.array([packed.tobytes() if of.any() else None], pa.binary()), *rows], schema=kind)

    return group


# --- second reading: list entries of heavy sets, subsets of light ones


def ordered_prefix(s: np.ndarray, told: np.ndarray, n_buckets: int) -> np.ndarray:
    """The first ``prefix(n)`` shingles of a set: rare ones first, then by hash."""
    k = prefix(len(s))
    if k >= len(s):
        return s
    width = _width(n_buckets)
    cell = _bucket(s, n_buckets) * _U(width) + _cell(s, width)
    rank = (told[cell >> _U(2)] >> (cell & _U(3)).astype(np.uint8) * np.uint8(2)) & np.uint8(3)
    order = (rank.astype(np.uint64) << _U(60)) | (s >> _U(4))
    return s[np.argpartition(order, k - 1)[:k]]


def subset_keys(s: np.ndarray) -> list[tuple[int, int]]:
    """(key, size) of every subset that a light set lists."""
    out = []
    for o in subset_sizes(len(s)):
        picks = np.array(list(itertools.combinations(range(len(s)), o)))
        out += [(int(x), o) for x in mix(np.add.reduce(mix(s)[picks], axis=1) ^ mix(np.array([o], np.uint64)))]
    return out


_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("subset", "<i4")])


def _entry_bucket(e: np.ndarray, n: int) -> np.ndarray:
    return _bucket(mix(e["token"]), n)


def _post_map(handle, x: int, odd: frozenset, n: int):
    kind = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])

    def scan(batches):
        told = np.frombuffer(handle.value, np.uint8)
        for batch in batches:
            tokens, nodes, sizes, subsets, seen, held = [], [], [], [], set(), 0

            def out():
                e = np.empty(held, _ENTRY)
                e["token"] = np.concatenate(tokens)
                each = [len(t) for t in tokens]
                e["node"], e["n"], e["subset"] = np.repeat(nodes, each), np.repeat(sizes, each), np.repeat(subsets, each)
                keys, parts = _dealt(e, _coarse(_entry_bucket(e, n), FAN))
                return pa.RecordBatch.from_arrays([pa.array(keys), parts], schema=kind)

            for _, s in shingle_sets(batch.column("text"), SHINGLE):
                if not len(s) or (node := fingerprint(s, odd)) in seen:
                    continue
                seen.add(node)  # equal sets of a batch are one node already
                added = []
                if len(s) <= x:
                    own = subset_keys(s)
                    for o in subset_sizes(len(s)):
                        added.append((np.array([k for k, size in own if size == o], np.uint64), o))
                if len(s) > x or 4 * len(s) >= 3 * (x + 1):
                    added.append((ordered_prefix(s, told, n), 0))
                for t, o in added:
                    tokens.append(t)
                    nodes.append(node)
                    sizes.append(len(s))
                    subsets.append(o)
                    held += len(t)
                if held >= 250_000:
                    yield out()
                    tokens, nodes, sizes, subsets, held = [], [], [], [], 0
            if held:
                yield out()

    return scan


class Forest:
    """Union-find over numbers; the least of a tree is its root."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = self.top
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.top[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.top) if (r := self.root(x)) != x]


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("need", "<i4"), ("n", "<i4")])


def _summed(pairs: np.ndarray) -> np.ndarray:
    """One entry for each pair, with the sum of its counts."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    first = np.flatnonzero(np.concatenate(([True], (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1]))))
    out = pairs[first]
    out["n"] = np.add.reduceat(pairs["n"], first)
    return out


def _short_pairs(e: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Pairs of fitting sizes within the lists ``number`` of the sorted entries ``e``."""
    found = []
    for d in range(1, SHORT):
        a, b = e[:-d], e[d:]
        on = (number[d:] == number[:-d]) & (4 * a["n"].astype(np.int64) >= 3 * b["n"]) & (a["node"] != b["node"])
        pair = np.empty(int(on.sum()), _PAIR)
        pair["a"], pair["b"] = np.minimum(a["node"], b["node"])[on], np.maximum(a["node"], b["node"])[on]
        pair["need"], pair["n"] = 1 + a["n"][on] // 64, 1
        found.append(pair)
    return _summed(np.concatenate(found))


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])


def _edge_table(*groups) -> pa.Table:
    rows = [(a, b, sure) for pairs, sure in groups for a, b in pairs]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_EDGES)], schema=_EDGES)


_LISTS_SQL = "bucket int, pairs binary, a array<bigint>, b array<bigint>, sure boolean"
_LISTS = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("sure", pa.bool_())])


def _pair_bucket(p: np.ndarray, n: int) -> np.ndarray:
    return mix(p["a"].astype(np.uint64) ^ mix(p["b"].astype(np.uint64))) % _U(n)


def _list_group(n: int):
    """Counted pairs of short lists by bucket; forests of long lists' chains and of shared subsets (sure)."""

    def group(table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()])
        e = e[np.lexsort((e["node"], e["n"], e["subset"], e["token"]))]
        keep = np.concatenate(([True], (e["token"][1:] != e["token"][:-1]) | (e["subset"][1:] != e["subset"][:-1]) | (e["node"][1:] != e["node"][:-1])))
        e = e[keep]  # equal sets of several batches
        same = (e["token"][1:] == e["token"][:-1]) & (e["subset"][1:] == e["subset"][:-1])
        first = np.concatenate(([True], ~same))
        number = np.cumsum(first) - 1
        long = np.bincount(number)[number] > SHORT
        a, b = e[:-1], e[1:]
        chain = same & long[1:] & (a["subset"] == 0) & (4 * a["n"].astype(np.int64) >= 3 * b["n"])
        top = e[np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))]
        star = ~first & (e["subset"] > 0) & (7 * e["subset"].astype(np.int64) >= 3 * (top["n"].astype(np.int64) + e["n"]))
        rows = []
        for x, y, on, sure in ((a, b, chain, False), (top, e, star, True)):
            forest = Forest()
            for p, q in np.unique(np.stack([x["node"][on], y["node"][on]], 1), axis=0).tolist():
                forest.join(p, q)
            edges = forest.edges()
            rows.append((None, None, [p for p, _ in edges], [q for _, q in edges], sure))
        short = (e["subset"] == 0) & ~long
        pairs = _short_pairs(e[short], number[short])
        keys, parts = _dealt(pairs, _coarse(_pair_bucket(pairs, n), FAN))
        edges = pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_LISTS)], schema=_LISTS)
        more = pa.table([pa.array(keys), parts, *(pa.nulls(len(keys), f.type) for f in list(_LISTS)[2:])], schema=_LISTS)
        release()
        return pa.concat_tables([edges, more])

    return group


def _pair_group(table: pa.Table) -> pa.Table:
    """Forest of the pairs of one bucket whose lists are as many as they need."""
    pairs = _summed(np.concatenate([np.frombuffer(x, _PAIR) for x in table.column("pairs").to_pylist()]))
    forest = Forest()
    for a, b in zip(*(pairs[c][pairs["n"] >= pairs["need"]].tolist() for c in ("a", "b")), strict=True):
        forest.join(a, b)
    return _edge_table((forest.edges(), False))


# --- third reading: the sets of coarse groups meet


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (by place) that span the components of ``sets`` under the link rule.

    Breadth first; each popped set scans the inverted lists of the sets not yet
    reached. The lists are rebuilt as those sets halve in number.
    """
    sizes = np.array([len(s) for s in sets])
    left = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    lists = None

    def build():
        owners = np.flatnonzero(left)
        tokens = np.concatenate([sets[i] for i in owners])
        own = np.repeat(owners.astype(np.int32), sizes[owners])
        order = np.argsort(tokens, kind="stable")
        return tokens[order], own[order], len(owners)

    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            d = queue.pop()
            rest = int(left.sum())
            if not rest:
                break
            if lists is None or 2 * rest < lists[2]:
                lists = build()
            tokens, own, _ = lists
            lo, hi = np.searchsorted(tokens, sets[d]), np.searchsorted(tokens, sets[d], "right")
            many = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            common = np.bincount(own[at], minlength=len(sets))
            near = np.flatnonzero(left & (common > 0) & (7 * common >= 3 * (sizes + sizes[d])))
            left[near] = False
            edges += [(d, int(j)) for j in near]
            queue += near.tolist()
    return edges


def _sets_map(odd: frozenset):
    kind = pa.schema([("node", pa.int64()), ("part", pa.string()), ("shingles", pa.binary())])

    def scan(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

        for batch in batches:
            part, want, rows, held = batch.column("part").to_pylist(), batch.column("node").to_pylist(), [], 0
            for i, s in shingle_sets(batch.column("text"), SHINGLE):
                if fingerprint(s, odd) == want[i]:  # an id may stand for several texts
                    rows.append((want[i], part[i], s.tobytes()))
                    held += len(s)
                if held >= 500_000:
                    yield out()
                    rows, held = [], 0
            yield out()

    return scan


def _meet_group(table: pa.Table) -> pa.Table:
    """One bin of whole groups, one block with its leaders, or one pair of blocks."""
    by: dict[str, dict[int, np.ndarray]] = {}
    for part, node, raw in zip(*(table.column(c).to_pylist() for c in ("part", "node", "shingles")), strict=True):
        by.setdefault(part, {})[node] = np.frombuffer(raw, np.uint64)
    out = []
    release()
    for members in by.values():
        nodes = sorted(members, key=lambda n: (len(members[n]), n))
        out += [(nodes[a], nodes[b]) for a, b in linked([members[n] for n in nodes])]
    return _edge_table((out, True))


_MET = "a bigint, b bigint, sure boolean"


def _meet(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges of the sets (node, shingles) that ``parts`` (node, part) brings together."""
    side = F.broadcast(parts) if parts.count() <= TOLD else parts
    return sets.join(side, "node").select("part", "node", "shingles").groupBy("part").applyInArrow(_meet_group, _MET).select("a", "b")


def _banded(big: DataFrame) -> DataFrame:
    """Nodes of large groups with their band of sizes: linked sets are in one band or two neighbours."""
    return big.withColumn("band", F.floor(F.log(F.col("n") + 0.0) / F.lit(float(np.log(4 / 3)))).cast("int"))


def _blocks(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (root, band, node, n) with a block ``h`` of their band, and the number ``k`` of each (root, band)'s blocks."""
    cut = nodes.groupBy("root", "band").agg(F.ceil(F.sum("n") / F.lit(GROUP_SHINGLES / 2)).cast("int").alias("k"))
    return nodes.join(cut, ["root", "band"]).withColumn("h", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).drop("k"), cut


def _to_blocks(nodes: DataFrame, cut: DataFrame) -> DataFrame:
    """``nodes`` (root, band, node, ...) once for each block of ``cut`` that has fitting sizes, as ``to_band`` and ``to_h``."""
    near = nodes.withColumn("to_band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = near.join(cut.withColumnRenamed("band", "to_band"), ["root", "to_band"])
    return near.withColumn("to_h", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")


def _large(big: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that span the components of the large groups' nodes (root, node, n). No step gathers a group's rows."""
    own, cut = _blocks(_banded(big))
    own = materialise(own, "blocks")
    name = lambda *c: F.concat_ws("/", *c)
    stripes = F.greatest(F.lit(1), F.least(F.lit(LEADERS), F.floor(F.lit(GROUP_SHINGLES / 12) / F.pow(F.lit(4 / 3), F.col("band") + 1)))).cast("int")
    lead = own.groupBy("root", "band", F.pmod(F.xxhash64("node", F.lit(1)), stripes).alias("stripe")).agg(F.min(F.struct(F.xxhash64("node", F.lit(2)).alias("x"), "node")).alias("first"))
    lead = _to_blocks(lead.select("root", "band", F.col("first.node").alias("node")), cut).select("node", name("root", "to_band", "to_h").alias("part"))
    parts = own.select("node", name("root", "band", "h").alias("part")).unionByName(lead).distinct()
    first = materialise(_meet(sets, materialise(parts, "parts")), "met")
    found = graph.components(first)
    now = own.join(found.select("node", F.col("root").alias("part_of")), "node", "left").withColumn("part_of", F.coalesce("part_of", "node"))
    weighed = now.groupBy("root", "part_of").agg(F.sum("n").alias("held"))
    main = weighed.groupBy("root").agg(F.max_by("part_of", F.struct("held", "part_of")).alias("main"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    split = now.join(main, "root")
    rest = split.filter("part_of <> main").select("root", "band", "node", "n")
    if rest.isEmpty():
        return first
    rest, rest_cut = _blocks(materialise(rest, "rest"))
    pair = lambda a, b: name(F.lit("q"), "root", *a, *b)
    one = _to_blocks(rest.select("root", "band", "h", "node"), cut).select("node", pair(("band", "h"), ("to_band", "to_h")).alias("part"))
    two = _to_blocks(split.select("root", "band", "h", "node"), rest_cut).select("node", pair(("to_band", "to_h"), ("band", "h")).alias("part"))
    return first.unionByName(materialise(_meet(sets, materialise(one.unionByName(two).distinct(), "pairs")), "met"))


def nodes_of(docs: DataFrame, n: int) -> tuple[DataFrame, frozenset, bytes]:
    """First reading: (doc_id, n, node) of every document, first hashes that do not tell sets apart, and the table of shingles' classes."""
    counted = docs.mapInArrow(_count_map(n), f"bucket int, shingles binary, {_ROWS_SQL}")
    counted = _finer(counted, n, np.dtype("<u8"), "shingles", _bucket)
    counted = counted.groupBy("bucket").applyInArrow(_count_group(n), f"bucket int, cells binary, {_ROWS_SQL}")
    counted = materialise(counted, "shingles")
    told = np.zeros((n, _width(n) // 4), np.uint8)
    for r in counted.select("bucket", "cells").filter("cells is not null").collect():
        told[r.bucket] = np.frombuffer(r.cells, np.uint8)
    slim = counted.select(F.explode(F.arrays_zip(*_ROWS)).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n"), F.col("x.prints").alias("node"), F.col("x.seconds").alias("second"))
    slim, odd = _told_apart(slim)
    return slim, odd, told.tobytes()


def _told_apart(slim: DataFrame) -> tuple[DataFrame, frozenset]:
    """``slim`` with nodes that tell sets apart, and the first hashes that do not.

    Of N different sets about N * N / 2**65 agree in one by chance: 27,000 of a million million.
    """
    unlike = slim.filter("n > 0").groupBy("node").agg(F.min("second").alias("a"), F.max("second").alias("b")).filter("a <> b")
    odd = frozenset(r.node for r in unlike.select("node").collect())
    if odd:
        slim = slim.withColumn("node", F.when(F.col("node").isin(*odd), F.col("second")).otherwise(F.col("node")))
    return slim.drop("second"), odd


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, frozenset]:
    """((doc_id, n, node) of all documents, sure edges (a, b) between nodes, hashes that do not tell sets apart).

    The edges span each component; they are not all pairs.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-size // (6 * BUCKET_SHINGLES)))
    slim, odd, told = nodes_of(docs, n)
    histogram = {r.n: r.many for r in slim.filter(F.col("n").between(1, 64)).groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()}
    x = boundary(histogram)
    handle = spark.sparkContext.broadcast(told)
    lists = _finer(docs.select("text").mapInArrow(_post_map(handle, x, odd, n), "bucket int, entries binary"), n, _ENTRY, "entries", _entry_bucket)
    lists = materialise(lists.groupBy("bucket").applyInArrow(_list_group(n), _LISTS_SQL), "lists")
    edges = lists.filter("sure is not null").select("sure", F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b", "sure")
    often = _finer(lists.filter("pairs is not null").select("bucket", "pairs"), n, _PAIR, "pairs", _pair_bucket)
    often = often.groupBy("bucket").applyInArrow(_pair_group, _MET)
    coarse = graph.components(edges.filter("not sure").unionByName(often).select("a", "b"))
    reps = slim.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    nodes = reps.join(coarse, "node")
    totals = nodes.groupBy("root").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    fits = F.col("total") <= GROUP_SHINGLES
    places = nodes.join(totals, "root").withColumn("part", F.when(fits, F.concat(F.lit("g"), F.col("root").cast("string"))))
    places = materialise(places, "places")
    many, held, large = places.agg(F.count(F.lit(1)), F.sum(F.when(fits, F.col("n"))), F.coalesce(F.max("total") > GROUP_SHINGLES, F.lit(False))).first()
    side = F.broadcast(places) if many <= TOLD else places
    texts = docs.alias("d").join(side.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select("d.text", "p.node", "p.part")
    sets = texts.mapInArrow(_sets_map(odd), "node bigint, part string, shingles binary")
    if large:  # read more than once
        sets = materialise(sets, "sets")
    bin_ = F.pmod(F.xxhash64("part"), F.lit(max(BINS_LEAST, -(-4 * (held or 0) // GROUP_SHINGLES))))
    met = sets.filter("part is not null").withColumn("bin", bin_).groupBy("bin").applyInArrow(_meet_group, _MET).select("a", "b")
    if large:
        rest = sets.filter("part is null").select("node", "shingles")
        met = met.unionByName(_large(places.filter("part is null").select("root", "node", "n"), rest))
    sure = materialise(met.unionByName(edges.filter("sure").select("a", "b")), "links")
    return slim, sure, odd


def components_of(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least id reachable), and its node.

    ``docs`` needs doc_id and text.
    """
    return _components(docs)[0]


def _components(docs: DataFrame) -> tuple[DataFrame, frozenset]:
    slim, sure, odd = links(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    roots = graph.components(sure)
    least = slim.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    by_root = least.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("component_id"))
    of = least.select("node", F.coalesce("root", "node").alias("root")).join(by_root, "root").select(F.col("node").alias("key"), "component_id", "root")
    # Empty sets have no node of their own; spread them so that they don't meet in one task.
    own = slim.withColumn("key", F.when(F.col("n") > 0, F.col("node")).otherwise(F.xxhash64("doc_id")))
    out = own.join(of, "key", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node", F.when(F.col("n") > 0, F.col("root")).alias("root"))
    return out, odd


def _with_node(odd: frozenset):
    def scan(batches):
        for batch in batches:
            prints = [fingerprint(s, odd) for _, s in shingle_sets(batch.column("text"), SHINGLE)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints, pa.int64())], names=["row", "node"])

    return scan


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, the one of the least id; all columns are kept.

    Rows are told apart by id. Only for ids that are null or repeat are the
    texts read again and told apart by their sets too. Documents without words
    are in no group and all stay.
    """
    found, unlike = _components(docs)
    found = materialise(found.filter("n_shingles > 0"), "components")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    odd = materialise(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("many")).filter("many > 1 or doc_id is null").select("doc_id"), "odd")
    chosen = found.join(best, "root")
    mine = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node"))
    gone = materialise(chosen.filter(~mine).select("doc_id").unionByName(odd).distinct(), "gone")
    tell = lambda df: F.broadcast(df) if df.count() <= TOLD else df
    same = lambda side: F.col("row.doc_id").eqNullSafe(F.col(side))
    held = docs.select(F.struct("*").alias("row"))
    out = held.join(tell(gone.select(F.col("doc_id").alias("gone"))), same("gone"), "left_anti")
    if odd.count():
        again = held.join(tell(odd.select(F.col("doc_id").alias("odd"))), same("odd"), "left_semi").select("row", F.col("row.text").alias("text"))
        kind = again.select("row").schema.add("node", T.LongType())
        again = again.mapInArrow(_with_node(unlike), kind)
        keep = best.select(F.col("best.doc_id").alias("id"), F.col("best.node").alias("best_node"))
        first = again.join(keep, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("best_node")))
        first = first.groupBy("id", "best_node").agg(F.first("row").alias("row")).select("row")
        blank = again.filter("node = 0").select("row")
        out = out.unionByName(first).unionByName(blank)
    return out.select("row.*")
