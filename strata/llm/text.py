"""Vectorised kernels over Arrow string columns: words and code points as numpy arrays, hashes, sorted hash arrays.

A word is a maximal run of ASCII letters, digits and characters beyond ASCII, in lower case. Nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strata.shared import trim  # noqa: F401

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U64) | U64(1)
#: The same as a regular expression on the text in lower case, for Python, Spark and RE2.
WORD_RE = r"[a-z0-9\x{80}-\x{10FFFF}]+"

_IS_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _IS_WORD[_lo:_hi] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits; h is overwritten."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seed_of(name: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0" if name is None else name.encode("utf-8", "surrogatepass") + b"\1", digest_size=8).digest(), "little")


def strings(column) -> pa.Array:
    """column as one large_string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string())


def lower(column) -> pa.Array:
    return pc.utf8_lower(strings(column))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string or large_binary array and its n + 1 offsets, from 0. Nulls have no bytes."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_large_string(column.type) else b"", column.type))
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return flat, off - off[0]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in order; about `most` bytes each, a single longer row alone."""
    n = len(column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, column.slice(at, to - at)
        at = to


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _powers_to(n: int, base: int) -> np.ndarray:
    return _powers(1 << max(16, int(n).bit_length()), base)


def runs(flat: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, which never cross a row, and n + 1 offsets of rows into them."""
    n = len(flat)
    inside = np.zeros(n + 1, bool)
    inside[:n] = member[flat]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, off)


def hash_runs(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of flat[s:e] for each run, the same wherever it lies."""
    if not len(starts):
        return np.zeros(0, U64)
    h = np.zeros(len(flat) + 1, U64)
    np.cumsum(_BYTE[flat] * _powers_to(len(flat), _P)[: len(flat)], out=h[1:])
    return mix((h[ends] - h[starts]) * _powers_to(len(flat), _PINV)[starts])


def words(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, row after row, and the n + 1 offsets of the rows."""
    flat, off = raw_bytes(lower(column))
    starts, ends, at = runs(flat, off, _IS_WORD)
    return hash_runs(flat, starts, ends), at


def word_hash(word: str) -> int:
    """The hash that words() gives to one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(hash_runs(b, np.array([0]), np.array([len(b)]))[0])


def ngrams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a sequence of hashes that don't cross rows, and the n + 1 offsets of the rows."""
    if n == 1:
        return h, at
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    g = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        g *= U64(_P)
        g += h[i : len(h) - n + 1 + i]
    g = mix(g)
    keep = np.ones(len(g), bool)
    for k in range(1, n):
        x = at[1:] - k
        keep[x[(x >= 0) & (x < len(g))]] = False
    return g[keep], np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - n + 1, 0))])


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unicode code points of a large_string array, row after row, and the n + 1 offsets of the rows."""
    flat, _ = raw_bytes(column)
    points = np.frombuffer(flat.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    return points, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def row_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row."""
    out = np.zeros(len(at) - 1, x.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(x, at[full])
    return out


class HashArrays:
    """Sorted 64-bit hashes with columns of values beside them. Looked up through an index of their leading bits."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], {k: v[order] for k, v in values.items()}
        self.keys, self.values = keys, values
        bits = max(1, min(26, len(keys).bit_length()))
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=U64)).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it isn't held."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket].astype(np.int64), self.first[bucket + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.keys[at] == h
            out[todo[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end)
            todo, at, end, h = todo[more], at[more], end[more], h[more]
        return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash that ngrams() gives to two words in sequence."""
    g = v * U64(_P)
    g += w
    return mix(g)
