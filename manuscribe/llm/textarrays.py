"""Words and shingles of UTF-8 buffers as numpy arrays, without a Python object per word.

A word's hash is the sum of t[byte] * P**i over its bytes (mod 2**64, t a fixed
table of random 64-bit numbers), got from one running sum over the buffer and
the inverse powers of P, then mixed with the word's length. Two different words
share a hash with a chance of about 2**-58.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_K = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 20

#: U+0009 to U+000D and the space.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A random number for each byte value.
EXACT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z folded to a-z.
FOLDED = EXACT.copy()
FOLDED[65:91] = EXACT[97:123]

_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, CHUNK + 1), _P if kind == "p" else _INV, np.uint64)
        base[0] = 1
        _powers[kind] = np.cumprod(base, dtype=np.uint64)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about `most` bytes."""
    data, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words are maximal runs without separators; row r has words bounds[r]:bounds[r + 1]."""
    n = len(data)
    body = ~separators[data]
    first, last = body.copy(), body.copy()
    first[1:] &= ~body[:-1]
    last[:-1] &= ~body[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = body[cut]
    last[cut - 1] = body[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def running(data: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power("p", len(data))[: len(data)], out=s[1:])
    return s


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end) of the buffer whose running() this is."""
    h = (sums[ends] - sums[starts]) * _power("i", len(sums))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _K)


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = EXACT, separators: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, bounds by row)."""
    starts, ends, bounds = spans(data, offs, separators)
    return hashes(running(data, table), starts, ends), bounds


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle of n words, bounds by row).

    A row with fewer than n words but some has its whole sequence as one shingle.
    """
    counts = np.diff(bounds)
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(out_bounds[-1]), np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.ones(len(out), bool)
    whole[out_bounds[short]] = False
    m = len(h) - n + 1
    if m > 0:
        row = np.repeat(np.arange(len(counts)), counts)
        c = h[:m] + np.uint64(n)
        for j in range(1, n):
            c = mix(c * _K + h[j : m + j])
        out[whole] = c[row[:m] == row[n - 1 :]]
    for k in range(1, n):
        at = short[counts[short] == k]
        if len(at):
            c = h[bounds[at]] + np.uint64(k)
            for j in range(1, k):
                c = mix(c * _K + h[bounds[at] + j])
            out[out_bounds[at]] = mix(c)
    return out, out_bounds


def shingle_sets(column: pa.Array, n: int, table: np.ndarray = FOLDED) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a string column, in order."""
    for _, _, data, offs in chunks(column):
        h, bounds = words(data, offs, table)
        s, b = shingles(h, bounds, n)
        for r in range(len(b) - 1):
            yield np.unique(s[b[r] : b[r + 1]])
