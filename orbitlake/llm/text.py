"""Vectorised text primitives shared by the corpus operators.

Everything works on the UTF-8 buffer of an Arrow string column, in chunks of
bounded size, so a worker never holds more than a few times ``CHUNK_BYTES``
(or one document, when a single document is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 1 << 12
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

_space = np.zeros(256, bool)
_space[list(b" \t\n\r\f\v")] = True
SPACE = _space
_word = np.zeros(256, bool)
_word[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_word[128:] = True
WORD = _word
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


class Column:
    """Buffer view of an Arrow string array: ``data`` uint8, ``offsets`` int64, ``valid`` bool."""

    def __init__(self, array: pa.Array | pa.ChunkedArray):
        if isinstance(array, pa.ChunkedArray):
            array = array.combine_chunks()
            if isinstance(array, pa.ChunkedArray):
                array = array.chunk(0) if array.num_chunks else pa.array([], pa.string())
        n = len(array)
        self.valid = np.ones(n, bool) if not array.null_count else ~np.asarray(array.is_null())
        if array.null_count:
            array = array.fill_null("")
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        buffers = array.buffers()
        if n == 0 or buffers[1] is None:
            self.offsets = np.zeros(n + 1, np.int64)
            self.data = np.zeros(0, np.uint8)
            return
        raw = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
        self.offsets = raw[array.offset : array.offset + n + 1].astype(np.int64)
        self.data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.valid)

    def chunks(self, max_bytes: int = CHUNK_BYTES, max_rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of whole rows ``(lo, hi, bytes, offsets)`` of at most ``max_bytes`` (or one row) and ``max_rows``."""
        n, off, lo = len(self), self.offsets, 0
        while lo < n:
            hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + max_rows, n)
            yield lo, hi, self.data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (max(n, 1) - 1).bit_length()
            self.up, self.down = (self._table(b, size) for b in (_BASE, _INV))
        return self.up, self.down

    @staticmethod
    def _table(base: np.uint64, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Exclusive prefix polynomial hashes modulo 2**64 (length n+1)."""
    n = len(values)
    up, _ = _POWERS.get(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of every span ``[start, end)`` of the hashed values."""
    _, down = _POWERS.get(len(prefix))
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte Latin-1 letters."""
    out = _lower[data]
    if len(out) > 1:
        hit = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][hit] += 32
    return out


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` that don't cross a row boundary."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    inner = offsets[1:-1]
    at = inner[inner < n]
    first[at] |= member[at]
    at = inner[inner > 0] - 1
    last[at] |= member[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every folded alphanumeric word, and the number of words of each row."""
    low = fold(data)
    start, end = runs(WORD[low], offsets)
    hashes = span_hash(prefix_hash(low), start, end)
    counts = np.diff(np.searchsorted(start, offsets))
    return hashes, counts


def slots(counts: np.ndarray) -> np.ndarray:
    """Row number of each item, given the number of items of each row."""
    return np.repeat(np.arange(len(counts)), counts)


def strings(column: Column, lo: int, hi: int) -> list[str]:
    raw, off = column.data, column.offsets
    return [raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in range(lo, hi)]
