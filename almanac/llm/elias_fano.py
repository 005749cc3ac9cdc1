"""Elias-Fano encoding of ascending numbers, with a select directory."""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<QQB")
#: Every so many numbers, the directory says where the high part of one is.
SAMPLE = 128


def encode(values: np.ndarray) -> bytes:
    """``values`` ascend and are not negative. Needs about 2 + log2(largest / count) bits each.

    Layout: count, largest, width of the low parts; the low parts, packed; how many bytes the
    high parts take; the high parts in unary (number ``i`` sets bit ``high + i``); then the bit
    of every ``SAMPLE``-th number as 32 bits.
    """
    values = np.asarray(values, np.uint64)
    count = len(values)
    largest = int(values[-1]) if count else 0
    width = max(0, (largest // max(count, 1)).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    bits = (values >> np.uint64(width)).astype(np.int64) + np.arange(count)
    high = np.zeros(int(bits[-1]) + 1 if count else 0, np.uint8)
    high[bits] = 1
    packed = np.packbits(high, bitorder="little").tobytes()
    return b"".join(
        [
            HEADER.pack(count, largest, width),
            np.packbits(low.ravel(), bitorder="little").tobytes(),
            struct.pack("<Q", len(packed)),
            packed,
            bits[::SAMPLE].astype("<u4").tobytes(),
        ]
    )


class Sequence:
    """Reads encoded numbers without a table of them."""

    def __init__(self, data: bytes):
        self.count, self.largest, self.width = HEADER.unpack_from(data)
        at = HEADER.size
        size = (self.count * self.width + 7) // 8
        self._low = np.frombuffer(data, np.uint8, size, at)
        (high,) = struct.unpack_from("<Q", data, at + size)
        self._high = np.frombuffer(data, np.uint8, high, at + size + 8)
        self._sample = np.frombuffer(data, "<u4", offset=at + size + 8 + high)

    def __len__(self) -> int:
        return self.count

    def _low_part(self, i: int) -> int:
        first = i * self.width
        part = int.from_bytes(self._low[first // 8 : (first + self.width + 7) // 8].tobytes(), "little")
        return (part >> (first % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Number ``i``: from the directory to its bit, a few bytes further at most on average."""
        bit, left = int(self._sample[i // SAMPLE]), i % SAMPLE
        byte = bit // 8
        word = int(self._high[byte]) >> (bit % 8) << (bit % 8)
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = int(self._high[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        return (position - i) << self.width | self._low_part(i)

    def many(self, places: np.ndarray) -> np.ndarray:
        """``select`` of many places at once: all go from their directory entry to their bit in step."""
        places = np.asarray(places, np.int64)
        bit, left = self._sample[places // SAMPLE].astype(np.int64), places % SAMPLE
        byte = bit >> 3
        word = self._high[byte].astype(np.int64) & (0xFF << (bit & 7))
        ones = np.bitwise_count(word)
        behind = np.flatnonzero(ones <= left)
        while len(behind):
            left[behind] -= ones[behind]
            byte[behind] += 1
            word[behind] = self._high[byte[behind]]
            ones[behind] = np.bitwise_count(word[behind])
            behind = behind[ones[behind] <= left[behind]]
        for _ in range(7):
            word = np.where(left > 0, word & (word - 1), word)
            left = np.maximum(left - 1, 0)
        high = byte * 8 + np.bitwise_count((word & -word) - 1) - places
        first = places * self.width
        low = np.zeros(len(places), np.int64)
        padded = np.concatenate((self._low, np.zeros(8, np.uint8)))
        for k in range((self.width + 14) // 8):
            low |= padded[(first >> 3) + k].astype(np.int64) << (8 * k)
        return high << self.width | (low >> (first & 7)) & ((1 << self.width) - 1)

    def all(self) -> np.ndarray:
        bits = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))
        low = np.unpackbits(self._low, bitorder="little")[: self.count * self.width].reshape(self.count, self.width)
        parts = low.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return ((bits - np.arange(self.count)) << self.width) | parts
