"""Vectorised text work on Arrow string columns: slices of bounded size, tokens, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = np.diff(offsets_of(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < batch.num_rows:
            ends = np.searchsorted(np.cumsum(sizes[at:]), limit, side="right")
            n = max(1, int(ends))
            yield batch.slice(at, n)
            at += n


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string array; nulls have no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    found = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return found[column.offset:column.offset + len(column) + 1].astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as one array, and the offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    offsets = offsets_of(column)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters, byte for byte."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    return out


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, SLICE_BYTES + 1024)
        held = np.ones(size, np.uint64)
        held[1:] = base
        np.cumprod(held, out=held)
        _powers[base] = held
    return held[:n]


class Spans:
    """Hashes of any byte spans of one array, from a prefix sum modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=self.sums[1:])
        self.inverse = _power(_BASE_INVERSE, len(data) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_classes(symbols: bool) -> np.ndarray:
    """0 for separators, 1 for letters, digits and all bytes of other scripts, 2 for ASCII symbols if wanted."""
    kinds = np.zeros(256, np.uint8)
    kinds[128:] = 1
    kinds[48:58] = kinds[65:91] = kinds[97:123] = 1
    if symbols:
        kinds[33:48] = kinds[58:65] = kinds[91:97] = kinds[123:127] = 2
    return kinds


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Runs of one class within a row: starts, ends, class, row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint8), none
    kinds = classes[data]
    cut = np.empty(len(data), bool)
    cut[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(data))
    real = kinds[at] > 0
    starts, ends, kind = at[real], ends[real], kinds[at[real]]
    return starts, ends, kind, np.searchsorted(offsets, starts, side="right") - 1
