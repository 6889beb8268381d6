"""Texts of an Arrow batch as numpy arrays, and polynomial fingerprints over them.

A fingerprint of the symbols s[a:b] is sum(s[a+i] * B**i) modulo 2**64 with an odd B, so that the fingerprints of all
ranges follow from one cumulative sum. Symbols are random 64-bit values (of a byte) or mixed ones (of a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Symbols handled at once; longer texts are cut into overlapping segments.
SEGMENT = 1 << 20
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
BYTE_SYMBOLS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
#: U+0020 and U+0009 to U+000D.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True

#: Powers are products of two: of an exponent's bits above and below this one. No table grows with the text.
LOW = 12
_powers: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(which: int, inverse: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """B ** (i << LOW) (or its inverse) for exponents up to most, and B ** i below 1 << LOW."""
    have = _powers.get((which, inverse))
    if have is None or len(have[0]) <= most >> LOW:
        base = pow(BASES[which], -1, 1 << 64) if inverse else BASES[which]
        tables = []
        for step, size in ((pow(base, 1 << LOW, 1 << 64), 1 << max(9, (most >> LOW).bit_length())), (base, 1 << LOW)):
            row = np.full(size, step, U64)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        _powers[which, inverse] = have = (tables[0], tables[1])
    return have


def power_range(which: int, inverse: bool, n: int, first: int = 0) -> np.ndarray:
    """The powers of n exponents in a row."""
    high, low = powers(which, inverse, first + n)
    a, b = first >> LOW, -(-(first + n) >> LOW) if n else 0
    return (high[a : max(a, b) + 1, None] * low).ravel()[first - (a << LOW) :][:n]


def power_at(which: int, inverse: bool, exponents: np.ndarray) -> np.ndarray:
    high, low = powers(which, inverse, int(exponents.max(initial=0)))
    return high[exponents >> LOW] * low[exponents & ((1 << LOW) - 1)]


class Fingerprints:
    """Of any ranges of one array of symbols."""

    def __init__(self, symbols: np.ndarray, which: int):
        self.which = which
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * power_range(which, False, len(symbols)), out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Of every range of that length, by its start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * power_range(self.which, True, n)) if n > 0 else np.zeros(0, U64)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * power_at(self.which, True, starts))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts (null: empty) end to end as bytes, and where each begins, with the end of the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-blank bytes, and the number of words before each text's end."""
    inside = ~BLANK[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value of each word's bytes."""
    return mixed(Fingerprints(BYTE_SYMBOLS[data], 0).ranges(starts, ends) + (ends - starts).astype(U64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z as a to z; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
