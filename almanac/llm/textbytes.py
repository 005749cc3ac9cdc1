"""Whole texts as bytes: words, shingles and windows of an Arrow column, hashed with numpy.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D. Those are single bytes in UTF-8
that no other character contains, so splitting bytes splits characters. Hashes are 64 bits;
two of them with different seeds make 128 where texts are compared across a whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of text that are held as arrays at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18

_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * np.uint64(_GOLDEN) + b)


@lru_cache(maxsize=4)
def _seeded(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(seed))
    base = (seed * 2 + 1) * 0xD1342543DE82EF95 % 2**64 | 3
    return table, np.uint64(base), np.uint64(pow(base, -1, 2**64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, count: int) -> np.ndarray:
    """The first ``count`` powers; the longest asked for is kept."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < count:
        known = np.full(count, base, np.uint64)
        known[0] = 1
        _POWERS[int(base)] = known = np.multiply.accumulate(known)
    return known[:count]


class SpanHash:
    """64-bit hashes of byte spans ``[start, end)`` of one array, from its running sums."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        table, base, inverse = _seeded(seed)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * _powers(base, len(data) + 1)[:-1], out=self._sums[1:])
        self._back = _powers(inverse, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._back[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Some whole texts: their bytes, and where each starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> "Texts":
        return Texts(LOWER[self.data], self.offsets)

    def take(self, rows: np.ndarray) -> "Texts":
        sizes = np.diff(self.offsets)[rows]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return Texts(self.data[np.repeat(self.offsets[rows] - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes where ``inside`` (by byte value) holds, never
        across texts, and the first run of each text (one entry more than texts)."""
        in_run = inside[self.data]
        if len(in_run) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(in_run))]
        begins, stops = in_run.copy(), in_run.copy()
        begins[1:] &= ~in_run[:-1]
        begins[edges] = in_run[edges]
        stops[:-1] &= ~in_run[1:]
        stops[edges - 1] = in_run[edges - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, self.offsets)

    def words(self, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the first word of each text."""
        starts, ends, first = self.runs(~SPACE)
        return SpanHash(self.data, seed)(starts, ends), first


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """All texts of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def blocks(texts: Texts, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive rows of about ``limit`` bytes, with the rows they are."""
    row, n = 0, len(texts)
    while row < n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        low, high = texts.offsets[row], texts.offsets[end]
        yield row, end, Texts(texts.data[low:high], texts.offsets[row : end + 1] - low)
        row = end


def windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words of one text, and the first window of each text.

    Built from halves by doubling, so the cost is logarithmic in the width. Windows stay in
    order; a text with fewer words has none.
    """
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    out, covered, power, span = None, 0, words, 1
    while True:
        if width & span:
            out, covered = (power, span) if out is None else (pair(out[: len(out) - span], power[covered:]), covered + span)
            n = len(words) - covered + 1
            out = out[:n]
        span *= 2
        if span > width:
            break
        power = pair(power[: -span // 2], power[span // 2 :])
    per_text = np.maximum(np.diff(first) - width + 1, 0)
    before = np.concatenate(([0], np.cumsum(per_text)))
    ids = np.repeat(first[:-1] - before[:-1], per_text) + np.arange(before[-1])
    return out[ids], before


def shingle_run(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in text order, repeats included, and where each text's begin.

    A text with fewer than ``width`` words has its whole sequence as one; without words, none.
    """
    hashes, begin = windows(words, first, width)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    if not len(short):
        return hashes, begin
    whole = np.array([_whole(words[first[t] : first[t + 1]]) for t in short], np.uint64)
    hashes = np.insert(hashes, begin[short], whole)
    return hashes, begin + np.concatenate(([0], np.cumsum((count > 0) & (count < width))))


def distinct(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of each text, ascending, and where each text's begin."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.argsort(hashes)
    order = order[np.argsort(text[order], kind="stable")]
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(begin)))


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingle set of each text: distinct hashes, ascending."""
    return distinct(*shingle_run(words, first, width))


def _whole(words: np.ndarray) -> np.uint64:
    state = np.full(1, len(words), np.uint64)
    for i in range(len(words)):
        state = pair(state, words[i : i + 1])
    return state[0]
