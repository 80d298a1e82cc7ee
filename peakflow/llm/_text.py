"""Vectorised words and shingles over Arrow string columns.

Words are runs without space and U+0009 to U+000D, as everywhere here. A word's
hash is a polynomial in its bytes, taken from running sums over the whole
buffer, so that no word becomes a Python object. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text is cut at white space).
SLICE_BYTES = 1 << 19
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def release() -> None:
    """Give memory that is free in this worker back, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    if len(_POWERS[0]) < n:
        inverse = _U(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inverse)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=np.uint64)
    return _POWERS


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), o


def _hash_words(raw: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``raw``; no word goes over a cut."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BLANK[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(column, lower: bool = True, limit: int = SLICE_BYTES):
    """Yields (lo, hi, hashes, offsets) for slices of rows: row lo+i has hashes[offsets[i]:offsets[i+1]]."""
    data, offs = buffers(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        a, b = int(offs[lo]), int(offs[hi])
        if b - a <= limit:
            cuts = offs[lo : hi + 1] - a
            h, starts = _hash_words(data[a:b], cuts, lower)
            yield lo, hi, h, np.searchsorted(starts, cuts)
        else:  # one long text: pieces that end at white space, or grow until they do
            parts = []
            while a < b:
                size = limit
                while True:
                    end = min(b, a + size)
                    if end == b:
                        break
                    blank = np.flatnonzero(_BLANK[data[a:end]])
                    if len(blank):
                        end = a + int(blank[-1]) + 1
                        break
                    size *= 2
                parts.append(_hash_words(data[a:end], np.zeros(0, np.int64), lower)[0])
                a = end
            h = np.concatenate(parts)
            yield lo, hi, h, np.array([0, len(h)])
        lo = hi
    if len(data) > limit:
        release()


def shingle_hashes(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of one text; fewer words make one shingle, none make none."""
    n = len(h)
    if not n:
        return h
    size = min(n, k)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = out * _P + h[i : n - size + 1 + i]
    return mix(out + _U(size))


def slice_shingles(h: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_hashes` of all texts of a slice at once: (shingles, offsets by text)."""
    n = np.diff(offs)
    text = np.repeat(np.arange(len(n)), n)
    inside = text[: max(0, len(h) - k + 1)] == text[k - 1 :]
    out, owner = shingle_hashes(h, k)[inside] if len(h) >= k else h[:0], text[: max(0, len(h) - k + 1)][inside]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        out = np.concatenate([out, *[shingle_hashes(h[offs[i] : offs[i + 1]], k) for i in few]])
        owner = np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, np.searchsorted(owner, np.arange(len(n) + 1))


def shingle_sets(column, k: int = 5, limit: int = SLICE_BYTES):
    """Yields (row, sorted distinct shingle hashes) for every row of the column."""
    for lo, hi, h, offs in word_hashes(column, True, limit):
        for i in range(hi - lo):
            s = shingle_hashes(h[offs[i] : offs[i + 1]], k)
            if len(s) > 1:
                s = np.sort(s)
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield lo + i, s
