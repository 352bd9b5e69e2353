"""Words of many texts at once, as 64-bit hashes, with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are the UTF-8 buffer of an
Arrow column with its offsets; no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_U64 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U64)
    out[0] = 1
    return np.cumprod(out, dtype=_U64)


_up = _powers(_BASE, _BLOCK)
_down = _powers(_INVERSE, _BLOCK)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_up):
        return _up[:n], _down[:n]
    return _powers(_BASE, n), _powers(_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


@dataclass
class Words:
    """start, end: byte positions; doc: index of the text; hash: of the word's bytes."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # for each text, the index of its first word; one more at the end

    def __len__(self) -> int:
        return len(self.start)

    @property
    def position(self) -> np.ndarray:
        """Index of each word within its text."""
        return np.arange(len(self), dtype=np.int64) - self.first[self.doc]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def split(column: pa.Array) -> Words:
    raw, off = buffers(column)
    size = len(raw)
    if not size:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(0, _U64), np.zeros(len(off), np.int64))
    solid = ~_BLANK[raw]
    edge = np.zeros(size + 1, dtype=bool)
    edge[off] = True
    before = np.empty(size, dtype=bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before |= edge[:-1]
    start = np.flatnonzero(solid & before)
    after = np.empty(size, dtype=bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= edge[1:]
    end = np.flatnonzero(solid & after) + 1
    doc = np.searchsorted(off, start, "right") - 1
    first = np.searchsorted(start, off, "left")
    value = np.empty(len(start), dtype=_U64)
    done = 0
    while done < len(start):  # blocks that end between words bound the memory
        stop = max(done + 1, int(np.searchsorted(end, start[done] + _BLOCK, "right")))
        lo, hi = int(start[done]), int(end[stop - 1])
        up, down = _tables(hi - lo)
        total = np.zeros(hi - lo + 1, dtype=_U64)
        np.cumsum((raw[lo:hi].astype(_U64) + _U64(1)) * up, out=total[1:])
        s, e = start[done:stop] - lo, end[done:stop] - lo
        value[done:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U64))
        done = stop
    return Words(start, end, doc, value, first)


def window_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of ``length`` consecutive entries from each position, by doubling."""
    if len(hashes) < length:
        return np.zeros(0, dtype=_U64)
    a, b = _U64(0xD6E8FEB86659FD93), _U64(0xA0761D6478BD642F)
    power, width = mix(hashes ^ _U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), 1
    out, have, rest = None, 0, length
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - have)
                out = mix(out[:n] * a + power[have : have + n] * b)
            have += width
        rest >>= 1
        if rest:
            power = mix(power[:-width] * a + power[width:] * b + _U64(width))
            width *= 2
    return out[: len(hashes) - length + 1]


def inside(words: Words, length: int) -> np.ndarray:
    """For each possible window start: does the window lie in one text?"""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    return words.doc[:n] == words.doc[length - 1 :]
