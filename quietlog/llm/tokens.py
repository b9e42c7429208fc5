"""Words of many texts at once, as positions and 64-bit hashes in numpy arrays.

Used inside Arrow batch functions. A batch is worked off in pieces of a megabyte
(never less than one text), so memory follows the longest text and not the batch, and a piece's arrays stay near the cores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def fresh(name: str, taken: list[str]) -> str:
    """A column name like `name` that is not taken (Spark does not tell upper from lower case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table of 256 flags: True for bytes between words."""
    flags = np.zeros(256, bool)
    for low, high in ranges:
        flags[low:high + 1] = True
    return flags


WHITE = separators((0x20, 0x20), (0x09, 0x0D))
# All ASCII but digits and lower-case letters: used after lower-casing.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=_U))
        return cls.up, cls.down


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans, from one running sum."""
    up, down = _Powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:len(values)], dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


@dataclass
class Texts:
    """A few texts: their bytes, the words in them, and which words belong to which text."""

    rows: slice          # of the batch
    data: np.ndarray     # bytes of all texts, one behind the other
    offsets: np.ndarray  # n + 1 places in data
    starts: np.ndarray   # first byte of every word
    ends: np.ndarray     # behind its last byte
    first: np.ndarray    # n + 1 places in starts

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_VALUES[self.data], self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> np.ndarray:
        """Places of the words at which k words of the same text begin."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.starts))
        return np.flatnonzero(left >= k)


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    values = column.buffers()[2]
    return offsets, np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cut a text column into (rows, offsets, bytes) of about `size` bytes, whole texts each."""
    offsets, data = binary(column)
    at = 0
    while at < len(offsets) - 1:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield slice(at, upto), offsets[at:upto + 1] - offsets[at], data[offsets[at]:offsets[upto]]
        at = upto


def words(column: pa.Array | pa.ChunkedArray, between: np.ndarray = WHITE, lower: bool = False,
          size: int = PIECE_BYTES) -> Iterator[Texts]:
    for rows, offsets, data in pieces(column, size):
        if lower:
            data = LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~between[data]
        begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges + 1]
        stops[edges - 1] = inside[edges]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        yield Texts(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets))
