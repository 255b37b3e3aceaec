"""Vectorised word operations on Arrow string columns.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  The
separators are single ASCII bytes, so UTF-8 texts can be cut as bytes.  A null
text has no words.  Hashes are 64-bit and depend on the bytes alone: the same
word or shingle has the same hash in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; a longer text is one step,
#: but its words are hashed in blocks of about as many bytes.
STEP_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _made_powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_kept_powers = lru_cache(maxsize=2)(_made_powers)


def _powers(n: int, base: int) -> np.ndarray:
    """The powers 0 to n - 1; up to those of a step are kept, longer ones are
    made anew."""
    return (_kept_powers(STEP_BYTES, base) if n <= STEP_BYTES else _made_powers(n, base))[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (A-Z as a-z if ``lower``).
    Spans ascend and do not overlap; they are hashed in blocks of STEP_BYTES, or
    of one longer span."""
    code, out, i = _BYTE_CODE[_LOWER] if lower else _BYTE_CODE, np.zeros(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, side="right")))
        at, n = starts[i], int(ends[j - 1] - starts[i])
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(code[data[at : at + n]] * _powers(n, _BASE), out=total[1:])
        value = (total[ends[i:j] - at] - total[starts[i:j] - at]) * _powers(n + 1, _BASE_INVERSE)[starts[i:j] - at]
        out[i:j] = mix(value + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


@dataclass
class Words:
    """Words of some texts: ``starts``/``ends`` are places in ``data``; the
    words of text ``i`` are ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z as a-z if ``lower``)."""
        return span_hashes(self.data, self.starts, self.ends, lower)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its offsets (nulls are empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, separator: np.ndarray = _SEPARATOR) -> Words:
    """The words of each text; ``separator``: which of the 256 bytes are outside."""
    data, offsets = text_buffers(column)
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), dtype=np.int64))
    inside = ~separator[data]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words, text after text, and where each
    text's windows begin.  A text with fewer words has one window, all its
    words; a text without words has none."""
    counts = np.diff(first)
    n_windows = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(n_windows)]).astype(np.int64)
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    at = np.repeat(first[:-1] - out_first[:-1], n_windows) + np.arange(out_first[-1])
    left = np.repeat(first[1:], n_windows) - at
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        factor = np.uint64((2 * j + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF | 1)
        part = mix(padded[at + j] * factor + np.uint64(j + 1))
        if j:
            part[left <= j] = 0  # past the end of a short text
        total += part
    return mix(total), out_first


def pieces(batch: pa.RecordBatch, text: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together hold at most ``limit`` bytes,
    or a single row."""
    _, offsets = text_buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
