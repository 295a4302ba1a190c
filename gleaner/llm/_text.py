"""Vectorised tokenising and hashing of whole texts, straight from Arrow buffers.

Words are found on UTF-8 bytes: the separators of both kinds are ASCII, so byte classes and code-point classes agree.
Lower-casing folds A-Z only. Texts are worked on a MB or two at a time, so memory doesn't grow with a batch; a single
text needs about eight times its own size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64


def _allocator():
    """glibc, if that is where memory comes from."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _allocator()


def give_back() -> None:
    """Return what a worker has freed to the system: a worker lives on between stages, and what it holds counts for its executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)

#: What separates words. Of kind "space": ``[\x20\x09-\x0D]``; of kind "alnum": all but ASCII letters, digits and non-ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = False

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_TABLE[0x41:0x5B] = _TABLE[0x61:0x7B]
_R = 0x9E3779B97F4A7C15 | 0b101
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, PIECE + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in that order."""
    return mix(a * U(0xD6E8FEB86659FD93) + (b ^ U(0xA0761D6478BD642F)))


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in ``data``, hashes of the lower-cased bytes, and ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text first words."""
    inside = ~separators[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    head[edges], tail[edges - 1] = inside[edges], inside[edges - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        b = int(ends[j - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[data[a:b]] * _power(_R, b - a)[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * _power(_R_INV, b - a + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def words_of(texts: pa.Array, separators: np.ndarray = SPACE) -> Words:
    data, offsets = raw(texts)
    starts, ends, first = find_words(data, offsets, separators)
    return Words(data, starts, ends, first, hash_ranges(data, starts, ends))


def hash_word(word: str) -> int:
    """The hash that :func:`words_of` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_ranges(data, np.array([0]), np.array([len(data)]))[0])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``size`` bytes of text at a time; a text is never cut."""
    try:
        for batch in batches:
            _, offsets = raw(batch.column(column))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
                yield batch.slice(a, b - a)
                a = b
            del batch, offsets
    finally:
        give_back()


def by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range; 0 where it is empty."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
