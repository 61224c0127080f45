"""Vectorised text kernels that run inside Arrow tasks.

A text column of a record batch is one byte buffer plus offsets, so words, word hashes and
shingles of a whole batch come from a few numpy passes, without a Python loop over words.
Every function works on bounded slices of a batch (see :func:`slices`) and on segments of
the buffer, so memory does not grow with a text, except by eight bytes a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 15
SEGMENT = 1 << 18

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _rng.integers(
    0, 2, 256, dtype=np.uint64
)
_LOWERED = _LETTER.copy()
_LOWERED[0x41:0x5B] = _LETTER[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = 0xD1B54A32D192ED03

#: bytes that belong to words: anything but ASCII white space
SPACED = np.ones(256, dtype=bool)
SPACED[0x09:0x0E] = False
SPACED[0x20] = False
#: bytes that belong to words: ASCII letters, digits and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(33)
        x *= _U(0xC4CEB9FE1A85EC53)
        x ^= x >> _U(33)
    return x


class _Powers:
    """Powers of the odd hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SEGMENT)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.r_[_U(1), np.full(n, _U(b), dtype=np.uint64)], dtype=np.uint64)
                    for b in (_BASE, inverse)
                )
        return self.up, self.down


_POWERS = _Powers()


def release() -> None:
    """Give freed memory back to the system: a Python worker stays for later tasks, and the
    executor's memory is shared by all of its workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc: nothing to trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most SLICE_ROWS rows and about SLICE_BYTES of text (one
    row at least). Null texts become empty. Frees memory at the end."""
    try:
        yield from _slices(batches, column)
    finally:
        release()


def _slices(batches, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
            hi = min(max(hi, lo + 1), lo + SLICE_ROWS, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0. Nulls read as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, raw, data = texts.buffers()
    if not len(texts) or raw is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(raw, kind)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(lo, hi) pieces of the buffer that end between words."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + SEGMENT, n)
        while hi < n and is_word[data[hi]] and is_word[data[hi - 1]]:
            gaps = np.flatnonzero(~is_word[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            cut = int(np.searchsorted(offsets, lo, side="right"))  # a text begins inside
            if cut < len(offsets) and offsets[cut] < hi:
                hi = int(offsets[cut])
                break
            ahead = np.flatnonzero(~is_word[data[hi : hi + SEGMENT]])
            hi = hi + int(ahead[0]) if len(ahead) else min(hi + SEGMENT, n)
            nxt = offsets[cut] if cut < len(offsets) else n
            hi = min(hi, int(nxt))
            if hi == nxt:
                break
        yield lo, hi
        lo = hi


def words(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACED
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, begin byte, end byte) of every word of every text, in order.
    Hashes see A-Z as a-z."""
    out = []
    for lo, hi in _segments(data, offsets, is_word):
        b = data[lo:hi]
        w = is_word[b]
        start, stop = w.copy(), w.copy()
        start[1:] &= ~w[:-1]
        stop[:-1] &= ~w[1:]
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        start[inner] = w[inner]
        inner = inner[inner > 0] - 1
        stop[inner] = w[inner]
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        up, down = _POWERS.get(len(b))
        with np.errstate(over="ignore"):
            total = np.zeros(len(b) + 1, dtype=np.uint64)
            np.cumsum(_LOWERED[b] * up[: len(b)], out=total[1:])
            h = mix((total[end] - total[begin]) * down[begin])
        out.append((h, begin + lo, end + lo))
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    h, begin, end = (np.concatenate(x) for x in zip(*out))
    return h, np.searchsorted(offsets, begin, side="right") - 1, begin, end


def shingles(h: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``width`` words within one text."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[width - 1 :] == text[:m])
    with np.errstate(over="ignore"):
        s = np.zeros(len(at), dtype=np.uint64)
        for j in range(width):
            s = s * _U(_SHINGLE) + h[at + j]
        return mix(s + _U(width)), at


def first_words(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word index, word count) of each of ``n_texts`` texts."""
    count = np.bincount(text, minlength=n_texts)
    return np.cumsum(count) - count, count


def lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


class Bitmap:
    """A set of 64-bit hashes in 2**bits bits that may report members it does not hold; used to
    leave rows out before an exact join, never to decide."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed = packed
        self.bits = (8 * len(packed)).bit_length() - 1

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) >> _U(64 - self.bits)
        return (self.packed[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & np.uint8(1) == 1


def word_counts(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACED) -> np.ndarray:
    """Number of words of every text."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for lo, hi in _segments(data, offsets, is_word):
        w = is_word[data[lo:hi]]
        start = w.copy()
        start[1:] &= ~w[:-1]
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        start[inner] = w[inner]
        begin = np.flatnonzero(start) + lo
        out += np.bincount(np.searchsorted(offsets, begin, side="right") - 1, minlength=len(out))
    return out
