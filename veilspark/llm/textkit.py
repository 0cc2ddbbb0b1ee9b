"""Vectorised words of Arrow text columns: byte offsets and 64-bit hashes.

A batch's UTF-8 bytes are scanned as one numpy array. Words never cross rows.
Every function takes null as an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Byte for byte maps, so that offsets stay what they are.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20
#: Lower case, and a blank for all ASCII but letters and digits.
ALNUM = LOWER.copy()
ALNUM[[i for i in range(128) if not chr(i).isalnum()]] = 0x20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that are scanned at once; a longer row is scanned alone.
CHUNK = 2 << 20


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            known = np.full(size, base, np.uint64)
            known[0] = 1
            known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the hash can be used."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets from 0) of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``chunk`` bytes."""
    raw, at = parts(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of consecutive rows. ``starts``, ``ends``: in ``data``, the mapped bytes.

    ``bounds``: row r has the words bounds[r]:bounds[r+1].
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, lut: np.ndarray = SAME, blank: np.ndarray = SPACE):
        self.data = raw if lut is SAME else lut[raw]
        self.at = at
        word = np.empty(len(raw) + 1, bool)
        np.logical_not(blank[self.data], out=word[:-1])
        word[-1] = False
        start = word.copy()
        start[1:] &= ~word[:-1]
        first = at[:-1][at[:-1] < at[1:]]  # rows with bytes: a word may begin right at the row
        start[first] = word[first]
        end = word.copy()
        end[:-1] &= ~word[1:] | start[1:]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, at)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=total[1:])
            return mix((total[self.ends] - total[self.starts]) * _power(_INVERSE, n + 1)[self.starts])

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the words with one blank after each, where each word begins in them)."""
        size = self.ends - self.starts
        first = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1] + 1, out=first[1:])
        edge = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(edge, self.starts, 1)
        np.subtract.at(edge, self.ends, 1)
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        body = np.ones(len(out), bool)
        body[first + size] = False
        out[body] = self.data[np.cumsum(edge)[:-1].astype(bool)]
        return out, first

    def text(self, which: np.ndarray) -> pa.Array:
        """The chosen words as an Arrow column."""
        return spans(self.data, self.starts[which], self.ends[which])


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges of ``data`` as an Arrow string column."""
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    where = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[where]))).cast(pa.string())


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (len - width + 1 of them)."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power(_BASE, n), out=total[1:])
        return mix((total[width:] - total[:-width]) * _power(_INVERSE, n + 1)[: n - width + 1])
