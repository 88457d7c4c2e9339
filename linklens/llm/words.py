"""Words of Arrow text columns as numpy arrays: places, hashes, windows.

Everything works on the UTF-8 bytes of a slice of documents, without a Python
object per word.  Hashes are polynomials modulo 2**64 over prefix sums, so that a
window of any length costs the same; they are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer document is a slice of its own.
SLICE = 1 << 21


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


#: [^\x20\x09-\x0D] and [^\x00-\x2F\x3A-\x60\x7B-\x7F] as sets of bytes.
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text starts and the last ends."""
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets.astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and bounds of consecutive texts of about `limit` bytes."""
    data, offsets = utf8(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            both = []
            for base in (self.base, self.inverse):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                both.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


class Rolling:
    """Hashes of stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def windows(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n]


#: Odd bases for bytes and, twice, for words.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x5851F42D4C957F2D, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


class Words:
    """The words of a slice of documents.

    starts, ends: places in bytes; first: number of the first word of each document,
    with the total at the end; doc: document of each word; hash: of its bytes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = NOT_BLANK, powers: Powers | None = None):
        self.data, self.bounds = data, bounds
        word = inside[data]
        edge = np.ones(len(data) + 1, dtype=bool)  # a word never reaches into the next document
        edge[1:-1] = ~word[:-1] | ~word[1:]
        edge[bounds] = True
        self.starts = np.flatnonzero(word & edge[:-1])
        self.ends = np.flatnonzero(word & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        if powers is not None:
            self.hash = mix(Rolling(data.astype(np.uint64) + np.uint64(1), powers).stretch(self.starts, self.ends))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return self.first[self.doc + 1] - np.arange(len(self.starts))


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values if width == n else np.minimum(values[:len(values) - (n - width)], values[n - width:])


class Bits:
    """A Bloom filter of fixed size over 64-bit hashes: 2**log2 bits, `k` places a hash."""

    def __init__(self, log2: int, data: bytes | None = None, k: int = 4):
        self.log2, self.k = log2, k
        self.data = np.zeros(1 << (log2 - 3), dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)

    def places(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(self.k):
            at = mix(hashes, 17 + i) >> np.uint64(64 - self.log2)
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self.places(hashes):
            np.bitwise_or.at(self.data, at, bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at, bit in self.places(hashes):
            out &= (self.data[at] & bit) != 0
        return out
