"""Vectorised text primitives over Arrow string buffers.

All functions work on whole batches as flat byte arrays (never one Python
string at a time) and never cut a text: a batch is split between rows only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.ones(1, np.uint64)
_LIBC = None

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = True
_IS_WORD[128:] = True
_IS_INK = np.ones(256, bool)
_IS_INK[[9, 10, 11, 12, 13, 32]] = False
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_string_view(col.type) if hasattr(pa.types, "is_string_view") else False:
        col = col.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def trim() -> None:
    """Give back what is free: Python workers live on between stages, and what one stage needed at most would stay theirs."""
    global _LIBC
    pa.default_memory_pool().release_unused()
    if _LIBC is None:
        try:
            _LIBC = ctypes.CDLL("libc.so.6")
            _LIBC.malloc_trim  # noqa: B018
        except (OSError, AttributeError):
            _LIBC = False
    if _LIBC:
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Split batches between rows so that each holds about ``size`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        offs = flat(batch.column(column))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch, offs
        trim()


def gather(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Batches joined until each holds at least ``size`` bytes of text, for work that is worth more on many rows at once."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.column(column).nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters in UTF-8."""
    out = _LOWER[buf]
    if len(buf) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][up] |= 0x20
    return out


def runs(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``mask``, which no position in ``cuts`` lies within."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    edge[0] = edge[n] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | edge[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (letters and digits), and each one's row."""
    s, e = runs(_IS_WORD[buf], offs)
    return s, e, np.searchsorted(offs, s, "right") - 1


def inks(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between white space."""
    return runs(_IS_INK[buf], cuts)


def _power(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        size = max(n, 2 * len(_POWER), 256)
        step = np.full(size, _STEP, np.uint64)
        step[0] = 1
        _POWER = np.cumprod(step, dtype=np.uint64)
    return _POWER


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions inside all spans in order, and where each span begins among them."""
    lens = ends - starts
    at = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) + np.repeat(starts - at, lens), at


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans must not be empty)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    pos, at = spans(starts, ends)
    within = pos - np.repeat(starts, lens)
    term = _BYTE[buf[pos]]
    term *= _power(int(lens.max()))[within]
    return mix(np.add.reduceat(term, at) + lens.astype(np.uint64))


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` tokens that lie within one row, and the first token of each."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g += h[k : k + m] * _GRAM[k]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(g[at]), at


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of the rows 0 to n begins in a sorted array of rows."""
    return np.searchsorted(row, np.arange(n + 1))


def ragged(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values of all spans, one after another."""
    return values[spans(starts, ends)[0]]
