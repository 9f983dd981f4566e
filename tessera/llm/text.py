"""Vectorised text primitives over Arrow string columns, shared by the operators of this package.

Texts stay UTF-8 bytes in the Arrow buffers; words, lines and hashes are found for whole blocks of
documents with numpy, so that no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes of `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at a time. A single longer document is a block of its own.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, BLOCK + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK):
    """Ranges of documents of at most `limit` bytes, or of one document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and document of each word `[^\\x20\\x09-\\x0D]+`."""
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    word = ~SPACE[data]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    begin[edge] = word[edge]
    edge = edge[edge > 0]
    stop[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def number_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As span_hashes, of spans of numbers below 2^32."""
    spread = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    spread *= _power_table(_BASE, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(spread, out=sums[1:])
    h = (sums[end] - sums[start]) * _power_table(_INVERSE, len(values) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span; A-Z count as a-z if `fold`."""
    table = _BYTE_FOLDED if fold else _BYTE
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power_table(_BASE, len(data)), out=sums[1:])
    h = (sums[end] - sums[start]) * _power_table(_INVERSE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class Counts:
    """Adds up counts by 64-bit key in bounded memory; `ready` yields partial sums to emit."""

    def __init__(self, limit: int = 3_000_000):
        self.limit, self.held, self.keys, self.sums = limit, 0, [], []

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.sums.append(n)
        self.held += len(k)

    def _merge(self) -> None:
        if len(self.keys) > 1:
            keys, n = np.concatenate(self.keys), np.concatenate(self.sums)
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.keys, self.sums = [keys[first]], [np.add.reduceat(n, first)]
        self.held = sum(map(len, self.keys))

    def ready(self, last: bool = False):
        if self.held > 2 * self.limit or last:
            self._merge()
            if (last or self.held > self.limit) and self.held:
                keys, n = self.keys[0], self.sums[0]
                for lo in range(0, len(keys), 200_000):
                    yield keys[lo : lo + 200_000], n[lo : lo + 200_000]
                self.keys, self.sums, self.held = [], [], 0
