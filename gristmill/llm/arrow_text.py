"""Vectorised text helpers for tasks that read Arrow batches.

A batch's text column is one UTF-8 buffer with row offsets; words, windows and
their 64-bit hashes are found on that buffer with numpy, a bounded slice of rows
at a time. Words are runs of bytes outside 0x09-0x0D and 0x20.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone.
SLICE_BYTES = 1 << 20

SPACES = b"\t\n\x0b\x0c\r "
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_TABLE = np.frombuffer(LOWER, np.uint8)

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _need_powers(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("_powers", _BASE), ("_inverse_powers", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of at most ``limit`` bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of the rows of a slice: byte spans, the row of each, first word of each row."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> Words:
    n = len(data)
    inside = np.empty(n + 1, bool)
    np.logical_not(is_space[data], out=inside[:n])
    inside[n] = False
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:n]
    cut = np.zeros(n + 1, bool)  # a row begins here
    cut[offsets[:-1]] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(starts, ends, row, first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _need_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _inverse_powers[starts])


def window_hashes(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window of ``size`` words within a row, the window's hash)."""
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    at = np.flatnonzero(words.row[:n] == words.row[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k]
    return at, mixed(total)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty rows give 0."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
