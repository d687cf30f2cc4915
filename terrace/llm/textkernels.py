"""Column-at-a-time text work on Arrow buffers: words, hashes and ragged gathers, with no loop over rows or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; temporary arrays are some forty times as large.
SLICE_BYTES = 1 << 20

_U = np.uint64
_PRIME, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_INVERSE = _U(pow(int(_PRIME), -1, 1 << 64))
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: ASCII white space: space and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together, a longer row alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _MIX1
    x = x ^ (x >> _U(33))
    x = x * _MIX2
    return x ^ (x >> _U(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial over the buffer."""
    n = len(buf)
    if len(_powers[0]) < n:
        for k, p in enumerate((_PRIME, _INVERSE)):
            full = np.full(max(n, SLICE_BYTES), p, _U)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    run = np.zeros(n + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * _powers[0][:n], out=run[1:])
    h = (run[ends] - run[starts]) * _powers[1][np.minimum(starts, max(n - 1, 0))] if n else np.zeros(len(starts), _U)
    return mix(h + (ends - starts).astype(_U) * _MIX2)


def word_spans(buf: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between bytes that set ``apart``, and where each row's words begin among them."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = apart[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ~space & edge[:-1]
    first[1:] |= ~space[1:] & space[:-1]
    last = ~space & edge[1:]
    last[:-1] |= ~space[:-1] & space[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and where each row's words begin among them."""
    starts, ends, rows = word_spans(buf, offsets)
    return span_hashes(LOWER[buf], starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words (one shorter run where a row has fewer words, none where it has none)."""
    counts = np.diff(rows)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(rows), np.int64)
    np.cumsum(per, out=bounds[1:])
    first = ragged_positions(rows[:-1], per)
    left = np.repeat(counts, per)
    h = np.full(len(first), _U(width), _U)
    for k in range(width):
        more = k < left if len(left) and counts.min() < width else None
        word = words[np.minimum(first + k, max(len(words) - 1, 0))] if len(words) else np.empty(0, _U)
        step = mix(h * _PRIME + word)
        h = step if more is None else np.where(more, step, h)
    return h, bounds


def ragged_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start and length, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def binary_array(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The byte spans of ``data`` as an Arrow binary column."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    body = data[ragged_positions(starts, lengths)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
