"""Vectorised text primitives over Arrow string buffers.

All functions work on the concatenated UTF-8 bytes of a block of texts (``data``) and the byte
offset of each text (``offsets``, one longer than the block), so no Python string is made per word.
Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; these are ASCII, so byte spans are
code point spans. A span's 64-bit hash depends only on its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the temporary arrays of a worker (about 40 bytes each).
BLOCK_BYTES = 1 << 20
_SEGMENT = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 2**64, 256, dtype=U64)
_R = U64(0x9E3779B97F4A7C15)
_R_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}
#: What operators keep in a worker from task to task (vocabularies, spans, lattices), by a name each.
KEPT: dict[str, dict] = {}


def only(*names: str) -> None:
    """Free what this worker keeps under other names: workers are used again by other operators, and memory is not given back by itself."""
    others = [kept for name, kept in KEPT.items() if name not in names and kept]
    for kept in others:
        kept.clear()
    if others:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _SEGMENT + 4096)
        for name, base in (("up", _R), ("down", _R_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) of consecutive blocks of about ``most`` bytes, one row at least."""
    data, offsets = column_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one longer than the texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans ascend and do not overlap."""
    out = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
        hi = int(ends[j - 1])
        up, down = _pow(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (positions that cross a text's end are the caller's to mask)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= _R
        out += h[j : j + n]
    return mix(out)


def ngram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over word positions (those with ``k`` words left in the block) whose k-gram lies in one text."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int64)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    has = counts > 0
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[:-1][has] + counts[has], -1)
    return np.cumsum(ok[:-1]) > 0


def text_of(first: np.ndarray) -> np.ndarray:
    """For each word its text's index in the block."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def count_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return np.diff(total[offsets])
