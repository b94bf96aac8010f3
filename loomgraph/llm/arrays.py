"""Whole-batch text primitives: words, lines and hashes as numpy arrays.

An Arrow string column is handled as one byte buffer plus offsets, in slices of a
few MB, so that memory is bounded by the slice (or by a single longer text) and no
Python object is made per word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space of the contracts: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SLICE_BYTES = 1 << 19
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit depends on all."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


#: One random 64-bit value for each byte, from the finaliser itself.
BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _STEP)
_POW = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of an odd multiplier modulo 2**64; the table doubles as needed."""
    global _POW
    while len(_POW) < n:
        top = _POW[-1:] * _U(0xD6E8FEB86659FD93)
        _POW = np.concatenate([_POW, _POW * top])
    return _POW


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def counts_below(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each offset, how many of the sorted positions lie before it."""
    return np.searchsorted(positions, offsets)


class Words:
    """Words of a slice: byte starts and lengths, and the ragged offsets of documents."""

    __slots__ = ("doc", "ends", "lengths", "offsets", "raw", "starts")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.raw = raw
        word = np.append(~space[raw], False)
        head, tail = word[:-1].copy(), word[:-1].copy()
        head[1:] &= ~word[:-2]
        tail &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        head[inner] |= word[inner]
        tail[inner - 1] |= word[inner - 1]
        self.starts = np.flatnonzero(head)
        self.ends = np.flatnonzero(tail) + 1
        self.lengths = self.ends - self.starts
        self.offsets = counts_below(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with lower, of the word with A-Z lowered."""
        raw = LOWER[self.raw] if lower else self.raw
        return span_hashes(raw, self.starts, self.lengths)


def span_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint non-empty byte spans in rising order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = BYTE[raw[np.repeat(starts, lengths) + at]] * powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _STEP)


def windows(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word window inside a document, and the index of its first word."""
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h = h * _U(0x9FB21C651E98DF25) + words[k : k + total]
    room = np.repeat(offsets[1:], np.diff(offsets))[:total] - np.arange(total)
    keep = np.flatnonzero(room >= n)
    return mix(h[keep]), keep


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur at least twice."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Marks each key that equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back what memory it no longer needs when a task is through: workers wait for others beside the JVM."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def by_slices(
    make: Callable[[np.ndarray, np.ndarray], list], schema: pa.Schema, limit: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over (key columns..., text): keys pass, make(raw, offsets) gives the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, text = batch.columns[:-1], batch.columns[-1]
            raw, offsets = flat(text)
            for i, j in slices(offsets, limit):
                made = make(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(k.slice(i, j - i) for k in keys), *map(pa.array, made)], schema=schema)

    return trimmed(run)
