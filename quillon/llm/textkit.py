"""Vectorised text primitives that the text operators share.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, the separators of
every word-based contract in this subpackage.  All of them are ASCII, so the split
works on UTF-8 bytes without decoding.  Hashes are polynomial (Rabin-Karp) sums
modulo 2**64 with an odd base, read off prefix sums: one pass whatever the length
of the word or window.  A final mix spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; temporary arrays take about 60 bytes for each.
CHUNK_BYTES = 1 << 20
_BLOCK = 1 << 16  # bytes whose values stay in a core's cache

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = np.zeros(256, bool)  # of a blank line
_SPACE[[0x20, 0x09, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift-multiply)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix64(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_BYTE_LOWER = BYTE[_LOWER]
#: A second value for each byte; hashes made of both are independent.
OTHER = mix64(BYTE ^ U(0x5851F42D4C957F2D))
_OTHER_LOWER = OTHER[_LOWER]
_pow = np.ones(1, U)
_ipow = np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _pow, _ipow
    if len(_pow) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, U(BASE))]), dtype=U)
            _ipow = np.cumprod(np.concatenate([[U(1)], np.full(m - 1, U(BASE_INV))]), dtype=U)
    return _pow[:n], _ipow[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many spans at once, mixed with the length."""
    p, ip = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values * p[: len(values)], out=s[1:], dtype=U)
        return sealed(s[end] - s[start], start, end, ip)


def sealed(sums: np.ndarray, start: np.ndarray, end: np.ndarray, ip: np.ndarray) -> np.ndarray:
    """Hashes of spans from the sums of their values times BASE**position; ip: BASE**-position."""
    with np.errstate(over="ignore"):
        return mix64(sums * ip[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def segment_sums(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of table[byte] * BASE**position between neighbours of `at`, positions in data that never fall.

    Where spans do not overlap this takes a third of the time of the prefix sums of span_hashes.
    """
    p, _ = powers(len(data) + 1)
    w = np.zeros(len(data) + 1, U)  # one more, as a segment may begin at the end
    with np.errstate(over="ignore"):
        for a in range(0, len(data), _BLOCK):
            b = min(a + _BLOCK, len(data))
            np.take(table, data[a:b], out=w[a:b], mode="clip")
            w[a:b] *= p[a:b]
        sums = np.add.reduceat(w, at)[:-1]
    sums[at[1:] == at[:-1]] = 0
    return sums


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every window of `width` values; empty when there are too few."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return span_hashes(values, at, at + width)


@dataclass
class Words:
    """Words of consecutive rows: word i of row r is at first[r] + i."""

    rows: range  # row numbers in the array that was given
    first: np.ndarray  # int64, len(rows) + 1
    hashes: np.ndarray  # uint64, one a word
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    data: np.ndarray  # uint8, the bytes of these rows
    others: np.ndarray | None = None  # uint64, second hashes of the words, if asked for


def _buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; a null is an empty string."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def words(arr: pa.Array, lower: bool, chunk: int = CHUNK_BYTES, twice: bool = False) -> Iterator[Words]:
    """Splits a string array into words, some rows at a time; rows are never cut.  `twice` makes second hashes, too."""
    arr = plain(arr)
    if not len(arr):
        return
    offsets, data = _buffers(arr)
    table = _BYTE_LOWER if lower else BYTE
    r = 0
    while r < len(arr):
        e = max(r + 1, int(np.searchsorted(offsets, offsets[r] + chunk, "right")) - 1)
        lo, hi = int(offsets[r]), int(offsets[e])
        b = data[lo:hi]
        cuts = offsets[r : e + 1] - lo
        sep = _SEP[b]
        begins = np.zeros(len(b) + 1, bool)
        begins[: len(b)] = ~sep
        ends = np.zeros(len(b) + 1, bool)
        ends[1:] = ~sep
        edge = np.zeros(len(b) + 1, bool)  # a row's first byte
        edge[cuts] = True
        # A word starts where a non-separator follows a separator or a row's edge.
        after_sep = np.ones(len(b) + 1, bool)
        after_sep[1:] = sep
        before_sep = np.ones(len(b) + 1, bool)
        before_sep[: len(b)] = sep
        start = np.flatnonzero(begins & (after_sep | edge))
        end = np.flatnonzero(ends & (before_sep | edge))
        first = np.searchsorted(start, cuts)
        others = span_hashes((_OTHER_LOWER if lower else OTHER)[b], start, end) if twice else None
        yield Words(range(r, e), first, span_hashes(table[b], start, end), start, end, b, others)
        r = e


@dataclass
class Lines:
    """Lines of consecutive rows, cut at line feeds: line i of row r is at first[r] + i."""

    rows: range
    first: np.ndarray
    start: np.ndarray  # byte positions in data, the line feed left out
    end: np.ndarray
    data: np.ndarray
    blank: np.ndarray  # bool: nothing but spaces, tabs and carriage returns


def lines(arr: pa.Array, chunk: int = CHUNK_BYTES) -> Iterator[Lines]:
    """Splits a string array into lines, some rows at a time; a null has none, an empty text has one."""
    arr = plain(arr)
    if not len(arr):
        return
    null = np.asarray(arr.is_null())
    offsets, data = _buffers(arr)
    r = 0
    while r < len(arr):
        e = max(r + 1, int(np.searchsorted(offsets, offsets[r] + chunk, "right")) - 1)
        lo, hi = int(offsets[r]), int(offsets[e])
        b = data[lo:hi]
        cuts = offsets[r : e + 1] - lo
        feeds = np.flatnonzero(b == 0x0A)
        inside = np.searchsorted(cuts, feeds, "right") - 1  # the row of each line feed; rows without bytes have none
        has = ~null[r:e]
        start = np.concatenate([cuts[:-1][has], feeds + 1])
        row = np.concatenate([np.flatnonzero(has), inside])
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        first = np.searchsorted(row, np.arange(e - r + 1))
        end = np.empty(len(start), np.int64)
        end[:-1] = start[1:] - 1
        last = first[1:][has] - 1
        end[last] = cuts[1:][has]
        blank = start == end
        unsure = np.flatnonzero(~blank)
        unsure = unsure[_SPACE[b[start[unsure]]]]
        if len(unsure):  # else each line's first byte shows that it is not blank
            solid = np.concatenate([[0], np.cumsum(~_SPACE[b])])
            blank[unsure] = solid[end[unsure]] == solid[start[unsure]]
        yield Lines(range(r, e), first, start, end, b, blank)
        r = e


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its row among the rows of `first`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_windows(w: Words, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the windows that lie within one row."""
    h = window_hashes(w.hashes if hashes is None else hashes, width)
    row = row_of(w.first)
    ok = np.flatnonzero(row[: len(h)] == row[width - 1 : width - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
    return ok, h[ok]


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each row's list."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
