"""Words and hashes of whole Arrow text columns, computed with numpy over UTF-8 bytes.

Words are runs of characters other than blank and U+0009 to U+000D, after A-Z is lower-cased. All of
these are single bytes in UTF-8, so bytes are enough to find them. A word's 64-bit hash is a polynomial
over random byte values, taken from running sums, then mixed; equal words have equal hashes anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Bytes of a piece whose arrays of words stay in a core's cache.
CACHED = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: As the text stands, for words that are told apart by case.
AS_IS = np.arange(256, dtype=np.uint8)
#: Bytes that are in no word where words are runs of digits, a to z and what is not ASCII, after A-Z is lower-cased.
PLAIN = np.ones(256, dtype=bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = PLAIN[128:] = False
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits look independent."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    kind = np.int32 if column.type == pa.string() else np.int64
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def pieces(column: pa.Array, size: int = CHUNK):
    """Cuts a column into row ranges of about `size` bytes: yields first row, past-last row, bytes, offsets from 0.

    A text longer than that makes a range of its own, so memory follows the longest text.
    """
    raw, offs = utf8(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = _BLANK, lower: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first and past-last byte of each word, in order; blank says which bytes are in no word, lower what each byte counts as."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    solid = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[lower[data]] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, rows, starts, ends


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words and their rows; a row with fewer words gives its whole sequence once."""
    n = len(hashes)
    if not n:
        return hashes, rows
    size = np.bincount(rows, minlength=int(rows[-1]) + 1)[rows]
    place = np.arange(n) - np.searchsorted(rows, rows)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        to = np.zeros(n, np.uint64)
        to[: n - k] = hashes[k:]
        out = np.where(place + k < size, mix(out + to + np.uint64(k + 1)), out)
    keep = (place + width <= size) | (place == 0)
    return out[keep], rows[keep]


def sets(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, rising within rows."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words, in order, each with one space after it, and where each word now starts and ends."""
    sizes = ends - starts + 1
    to = np.cumsum(sizes)
    begin = to - sizes
    at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(starts - begin, sizes)
    out = data[np.minimum(at, max(0, len(data) - 1))]
    out[to - 1] = 32
    return out, begin, to - 1


def rejoined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """The n rows' words, in order, joined by one space."""
    flat, _, last = joined(data, starts, ends)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    some = bounds[1:] > bounds[:-1]
    stay = np.ones(len(flat), bool)
    stay[last[bounds[1:][some] - 1]] = False
    sizes = np.bincount(rows, weights=ends - starts + 1, minlength=n).astype(np.int64) - some
    offs = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offs), pa.py_buffer(flat[stay])).cast(pa.string())
