"""Words of whole texts as 64-bit hashes, computed over Arrow buffers.

A word's hash is a polynomial over its folded bytes (A-Z as a-z), finished by a
mixer. All words of a slice are hashed by prefix sums, without Python objects.
Texts are taken in slices of about ``SLICE`` bytes; a longer text is one slice
and its bytes go through the hash in segments cut between words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_ODD_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


_kept: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What a worker keeps from task to task, until a task of another kind begins."""
    return _kept.setdefault(name, {})


def released(run: Callable[[Iterator], Iterator], keep: str = "") -> Callable[[Iterator], Iterator]:
    """A task's function that begins without what other kinds of tasks kept (all but ``keep``),
    and hands free memory back when it ends: its worker is used again for other tasks."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        forget(keep)
        try:
            yield from run(batches)
        finally:
            release()

    return task


def forget(keep: str = "") -> None:
    for name, cache in _kept.items():
        if name != keep:
            cache.clear()


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _fold(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= 0x41) & (codes <= 0x5A), codes + 32, codes)


_CODES = _fold(np.arange(256))
LOWER = _CODES.astype(np.uint8)
_LETTERS = mix((_CODES.astype(U64) + U64(1)) * _ODD)
# What is part of a word, by byte: all but white space, or digits, letters and non-ASCII.
BETWEEN_SPACE = ~np.isin(_CODES, [0x20, *range(0x09, 0x0E)])
ALNUM = (_CODES >= 0x80) | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))


def power_table(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept by the worker."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE + 1), base, dtype=U64)
        out[0] = 1
        have = _powers[key] = np.multiply.accumulate(out)
    return have[:n]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offset of each row) of runs of rows.

    Nulls count as empty texts. The bytes are a view of the Arrow buffer.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 byte of each word; a word never crosses a row's end."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_LETTERS[data] * power_table(_ODD, len(data)), out=sums[1:])
    poly = (sums[ends] - sums[starts]) * power_table(_ODD_INVERSE, len(data) + 1)[starts]
    return mix(poly + (ends - starts).astype(U64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the folded bytes of every span, in order."""
    hashes = np.empty(len(starts), dtype=U64)
    word = 0
    while word < len(starts):
        low = starts[word]
        stop = max(int(np.searchsorted(ends, low + SLICE, side="right")), word + 1)
        high = ends[stop - 1]
        hashes[word:stop] = _segment_hashes(data[low:high], starts[word:stop] - low, ends[word:stop] - low)
        word = stop
    return hashes


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the place of each row's first word (rows + 1)."""
    starts, ends = word_spans(data, offsets, kind)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (the last n - 1 places have none)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(count, dtype=U64)
    for i in range(n):
        total *= _ODD
        total += hashes[i : i + count]
    return mix(total + U64(n))


def starts_of_grams(first_word: np.ndarray, n: int) -> np.ndarray:
    """Words at which a whole n-gram of the row begins."""
    rows = np.repeat(first_word[1:], np.diff(first_word))
    return np.flatnonzero(np.arange(len(rows)) + n <= rows)
