"""Numpy helpers that several operators share: texts of a batch as one byte array, words, lines and slice hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once inside a task. A longer text is a piece of its own; nothing is cut.
PIECE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _table() -> np.ndarray:
    return mix((np.arange(256, dtype=_U) + _U(1)) * _U(0xD1342543DE82EF95))


_BYTE = _table()
_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64; kept between pieces, not for outsized ones."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    size = max(n, PIECE_BYTES + (PIECE_BYTES >> 1))
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base & _MASK, dtype=_U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if size <= 2 * PIECE_BYTES:
        _POWERS["up"], _POWERS["down"] = out
    return out[0][:n], out[1][:n]


def slices(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (starts, ends) that gives 64-bit hashes of slices of an unsigned 64-bit array, by one rolling prefix sum."""
    up, down = _powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return lambda starts, ends: mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def window_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return slices(values)(starts, ends)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte slices ``data[s:e]``; equal bytes give equal hashes in any batch."""
    return slices(_BYTE[data])(starts, ends)


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """``byte_hashes`` of every slice of ``width`` bytes, with fewer copies."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, _U)
    np.multiply(_BYTE[data], up[:-1], out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    h = prefix[width:] - prefix[:-width]
    del prefix
    h *= down[: len(h)]
    h += _U(width * 0xA0761D6478BD642F & _MASK)
    return mix(h)


class Texts:
    """Texts laid end to end as UTF-8, each followed by a line feed that is not part of it.

    ``data`` holds the bytes; text ``i`` is ``data[start[i]:end[i]]``. Nulls are empty texts.
    """

    def __init__(self, texts: pa.Array):
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = b"\n".join(pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()) + b"\n" * (len(texts) > 0)
        self.data = np.frombuffer(flat, np.uint8)
        ends = np.cumsum(size + 1)
        self.start, self.end = ends - size - 1, ends - 1
        self.n = len(size)

    def space(self) -> np.ndarray:
        return (self.data == 32) | ((self.data >= 9) & (self.data <= 13))

    def of(self, at: np.ndarray) -> np.ndarray:
        """The number of the text each position (ascending) lies in."""
        cuts = np.searchsorted(at, self.start)
        return np.repeat(np.arange(self.n), np.diff(np.append(cuts, len(at))))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value per byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.end] - total[self.start]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every run of bytes other than space and 0x09 to 0x0D."""
        solid = ~self.space()
        edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return starts, ends, self.of(starts)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that each part holds about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    yield batch.slice(at)


def few(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is unpacked of one at once is bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z made lower case, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
