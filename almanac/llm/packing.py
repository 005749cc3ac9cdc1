"""Best-fit packing into sequences of fixed length, by minimum bin slack.

Only the number of pieces of each length matters for the packing, and there are at most as many
lengths as a sequence has tokens. So the corpus is reduced to that histogram; bins are filled
there, one after the other, by a bitset subset-sum over the lengths still available; and bins
with the same content are made at once. Spark then deals the pieces to the bins by their rank
among pieces of equal length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .textbytes import blocks, texts_of
from .tokens import encoder

CAPACITY = 2048
END = np.zeros(1, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, words: bool, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id 0, cut only if longer than ``capacity``: ``doc_id``,
    ``piece``, ``start``, ``length``, ``ids_crc32``. A null or empty text is its end id alone."""

    def run(batches):
        encode = encoder(tokenizer, words)
        for batch in batches:
            strings, doc_ids = batch.column("text"), batch.column("doc_id")
            for low, _, texts in blocks(texts_of(strings)):
                ids, begin = encode(texts)
                raw, begin = ids.astype("<u4").tobytes(), begin.tolist()
                rows, numbers, starts, lengths, crcs = [], [], [], [], []
                for row in range(len(texts)):
                    size = begin[row + 1] - begin[row] + 1
                    for number, at in enumerate(range(0, size, capacity)):
                        length = min(capacity, size - at)
                        last = at + length == size
                        crc = zlib.crc32(raw[4 * (begin[row] + at) : 4 * (begin[row] + at + length - last)])
                        rows.append(low + row), numbers.append(number), starts.append(at)
                        lengths.append(length), crcs.append(zlib.crc32(END, crc) if last else crc)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Lengths and how often each, of the available ``counts``, that fill ``room`` the most.

    A number's bit ``s`` says that some combination has sum ``s``. Lengths enter from the
    longest on, in powers of two of copies; the search ends once ``room`` itself is reached.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in (np.flatnonzero(counts[: room + 1])[::-1]).tolist():
        copies, take = min(int(counts[length]), room // length), 1
        while copies > 0 and not reach >> room & 1:
            take = min(take, copies)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
            copies -= take
            take *= 2
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            left -= length * take
            used[length] = used.get(length, 0) + take
    return list(used.items())


def fill(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of bin in order: how many alike, and the lengths in one with their number.

    Each bin begins with the longest length left, so that long pieces don't pile up at the end,
    and takes the fullest combination for the rest. A kind is repeated while its pieces last;
    then at least one length has too few left for another, which bounds the number of kinds by
    the number of lengths times the logarithm of the capacity, whatever the corpus.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    kinds = []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        content = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        content[longest] = content.get(longest, 0) + 1
        alike = min(int(counts[length]) // n for length, n in content.items())
        for length, n in content.items():
            counts[length] -= n * alike
        kinds.append((alike, sorted(content.items(), reverse=True)))
    return kinds


class Places:
    """Where the piece of some rank among those of its length goes."""

    def __init__(self, kinds, capacity: int = CAPACITY):
        rows, used, first = [], np.zeros(capacity + 1, np.int64), 0
        for alike, content in kinds:
            offset = 0
            for length, n in content:
                rows.append((length, used[length], first, n, offset))
                used[length] += alike * n
                offset += length * n
            first += alike
        rows.sort()
        self.bins = first
        self.length, self.rank, self.first, self.copies, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.begin = np.searchsorted(self.length, np.arange(capacity + 2))

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            low, high = self.begin[length], self.begin[length + 1]
            own = np.flatnonzero(lengths == length)
            at = low + np.searchsorted(self.rank[low:high], ranks[own], side="right") - 1
            bins[own] = self.first[at] + (ranks[own] - self.rank[at]) // self.copies[at]
            offsets[own] = self.offset[at] + (ranks[own] - self.rank[at]) % self.copies[at] * length
        return bins, offsets


def ranked(cut: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of a piece among all of its length, from 0.

    A length that many pieces share is dealt to many groups by a hash; ranks are counted inside
    each group and moved by the sizes of the groups before it.
    """
    groups = max(64, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "piece", "ids_crc32"]
    dealt = cut.withColumn("deal", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "deal").orderBy(*order)
    numbered = dealt.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(sizes, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("place")).drop("deal", "before", "place")


def pack(docs: DataFrame, tokenizer: str, words: bool = True, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; the pieces of a sequence follow each other
    from 0 without a gap and together have at most ``capacity`` tokens.

    Null and empty texts are pieces of one token; repeated rows are packed each. Columns other
    than ``doc_id`` and ``text`` are left out. Texts are encoded once: the pieces, some numbers
    each, are written to the shared folder for the histogram and the placing.
    """
    cut = materialize(pieces(docs, tokenizer, words, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(fill(histogram, capacity), capacity)

    def run(batches):
        for batch in batches:
            bins, offsets = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bins), pa.array(offsets)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(cut).mapInArrow(run, columns)
