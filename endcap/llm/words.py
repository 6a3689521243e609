"""Hashes of words and of runs of words, over whole Arrow text columns at once.

Words are the runs of bytes other than space and 0x09-0x0D; in UTF-8 these bytes are
never part of another letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9,
                                     0x94D049BB133111EB))
_S = [np.uint64(x) for x in (27, 29, 30, 31, 32)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = (h ^ (h >> _S[2])) * _B
    h = (h ^ (h >> _S[0])) * _C
    return h ^ (h >> _S[3])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (nulls are empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else \
        np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and n else \
        np.empty(0, np.uint8)
    return buf, at - at[0]


def words_of(buf: np.ndarray, offsets: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of the first word of each row (n + 1)."""
    n = len(buf)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    letter = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    size = ends - starts
    h = mix(size.astype(np.uint64) * _A + _B)
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    rows = np.arange(len(starts))
    k = 0
    while len(rows):
        left = size[rows] - k
        cut = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        lane = (lanes[starts[rows] + k] << cut) + _A          # bytes past the word fall off
        h[rows] = mix((h[rows] ^ lane) * _C)
        rows = rows[left > 8]
        k += 8
    return h


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbours; runs may cross rows, see ``inside``."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for k in range(1, length):
        acc *= _B
        acc += h[k:n + k]
    return mix(acc + np.uint64(length))


def inside(first_word: np.ndarray, length: int) -> np.ndarray:
    """Whether the run of ``length`` words at each word lies within one row."""
    total = int(first_word[-1])
    n = max(0, total - length + 1)
    row_end = np.repeat(first_word[1:], np.diff(first_word))
    return np.arange(n) + length <= row_end[:n]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def slices(column: pa.Array, limit: int = 2 << 20) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    _, offsets = text_bytes(column)
    out, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        out.append((lo, hi))
        lo = hi
    return out


def per_row(values: np.ndarray, edges: np.ndarray, how=np.add, kind=np.int64) -> np.ndarray:
    """Reduction of each row's values; rows without values give 0."""
    out = np.zeros(len(edges) - 1, kind)
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        out[full] = how.reduceat(values, edges[full], dtype=kind)
    return out
