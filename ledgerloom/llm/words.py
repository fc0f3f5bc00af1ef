"""Words of many texts as flat numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Texts come as Arrow string columns; the arrays are views of their buffers, cut into pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 500_000
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so that its powers have inverses modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, PIECE_BYTES + 65_536), base, np.uint64)
        factors[0] = 1
        known = _powers[base] = np.cumprod(factors)
    return known


_INVERSE = pow(_BASE, -1, 2**64)


def spans(data: np.ndarray, edges: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in `data`, and how many words lie before each edge (text boundaries).

    `gap` says of each byte whether it is between words.
    """
    inside = ~gap[data]
    begins, ends = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    at = edges[(edges > 0) & (edges < len(data))]
    begins[at] = inside[at]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:] | begins[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, edges)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):  # long texts in pieces, each ending with a word
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PIECE_BYTES)))
        low, high = int(starts[first]), int(stops[last - 1])
        n = high - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * _power_table(_BASE, n)[:n], out=sums[1:])
        a, b = starts[first:last] - low, stops[first:last] - low
        out[first:last] = mix((sums[b] - sums[a]) * _power_table(_INVERSE, n + 1)[a] + (b - a).astype(np.uint64) * _STEP)
        first = last
    return out


def windows(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n words; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = int(mix(np.array([seed + 1], np.uint64) * _STEP)[0]) | 1
    done, out, width, run = 0, None, 1, h
    while True:  # runs of 1, 2, 4, ... words put together as the binary digits of n ask for
        if n & width:
            piece = run[done:]
            size = len(h) - done - width + 1
            out = piece[:size].copy() if out is None else out[:size] + piece[:size] * np.uint64(pow(base, done, 2**64))
            done += width
        if done == n:
            return mix(out)
        run = run[:-width] + run[width:] * np.uint64(pow(base, width, 2**64))
        width *= 2


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, text edges) of pieces of a string column; null counts as empty.

    A piece holds whole rows and about `limit` bytes at most, or a single longer row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    where = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return values[where + np.arange(total)]
