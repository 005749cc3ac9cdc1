"""Benchmark decontamination: size-partitioned MinHash finds short items inside long documents.

Items are grouped by size. For each group a document is seen as overlapping windows of about the
size of its items, so an item inside a long document still has a large share of some window. A
window and an item that have any of their minima in common are a candidate, whose containment is
then counted exactly over the whole document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .textbytes import blocks, distinct, mix, shingle_run, texts_of

HASHES = 48
#: Percent of an item's shingles that a contaminated document has.
CONTAINED = 80
#: Bytes of item texts in one broadcast block. More items make more blocks, not larger ones.
ITEM_BYTES = 4 << 20
SMALLEST = 8
BITS = 20
SHIFT = np.uint64(64 - BITS)

ODD = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def _key(minima: np.ndarray, k: int) -> np.ndarray:
    return mix(minima + np.uint64(k))


class Items:
    """An index of some items: minima by size group, and shingle sets."""

    def __init__(self, ids: list, column):
        texts = texts_of(column).lowered()
        runs, begin = shingle_run(*texts.words())
        self.ids = ids
        self.sets, self.begin = distinct(runs, begin)
        size = np.diff(begin)
        group = np.maximum(SMALLEST, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(group[size > 0]):
            own = np.flatnonzero((group == width) & (size > 0))
            keys = np.concatenate(
                [_key(np.array([(self.set(i) * odd).min() for i in own], np.uint64), k) for k, odd in enumerate(ODD)]
            )
            order = np.argsort(keys)
            table = np.zeros(1 << BITS, bool)
            table[keys >> SHIFT] = True
            self.groups.append((int(width), keys[order], np.tile(own, HASHES)[order], table))

    def set(self, i: int) -> np.ndarray:
        return self.sets[self.begin[i] : self.begin[i + 1]]

    def find(self, texts) -> list[tuple[int, int, int]]:
        """(text, item, shingles of the item in the text) with enough of them, in that order."""
        runs, begin = shingle_run(*texts.lowered().words())
        found: set[tuple[int, int]] = set()
        if not len(runs) or not self.groups:
            return []
        for k, odd in enumerate(ODD):
            minima, first, span = runs * odd, begin, 1
            for width, keys, owners, table in self.groups:  # ascending: halves of one group join to the next
                step = width // 2 // span
                minima, first = _coarser(minima, first, step)
                span *= step
                key = _key(_over_three(minima, first), k)
                hit = np.flatnonzero(table[key >> SHIFT])
                if len(hit):
                    low, high = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                    for piece, a, b in zip(hit[high > low], low[high > low], high[high > low]):
                        text = int(np.searchsorted(first, piece, side="right")) - 1
                        found.update((text, int(i)) for i in owners[a:b])
        out = []
        for text in sorted({t for t, _ in found}):
            whole = np.unique(runs[begin[text] : begin[text + 1]])
            for item in sorted(i for t, i in found if t == text):
                wanted = self.set(item)
                at = np.minimum(np.searchsorted(whole, wanted), len(whole) - 1)
                n = int((whole[at] == wanted).sum())
                if 100 * n >= CONTAINED * len(wanted):
                    out.append((text, item, n))
        return out


def _coarser(minima: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima of ``step`` neighbours each, counted from the beginning of every text."""
    if step == 1:
        return minima, first
    pieces = -(-np.diff(first) // step)
    after = np.concatenate(([0], np.cumsum(pieces)))
    starts = np.repeat(first[:-1] - after[:-1] * step, pieces) + np.arange(after[-1]) * step
    return np.minimum.reduceat(minima, starts), after


def _over_three(minima: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of each piece and the two after it in the same text."""
    out = minima.copy()
    for ahead in (1, 2):
        if len(minima) > ahead:
            end = np.zeros(len(minima), bool)
            for back in range(1, ahead + 1):
                last = first[1:] - back
                end[last[last >= first[:-1]]] = True
            out[:-ahead] = np.where(end[:-ahead], out[:-ahead], np.minimum(out[:-ahead], minima[ahead:]))
    return out


def search(docs: DataFrame, items: DataFrame, name: str = "matches") -> DataFrame:
    """Adds ``matches`` to each document: items (``item_id``, ``text``) of whose five-word shingles it
    has 80 percent or more, with the size of the item's set and how much was found.

    A-Z is lowered; an item or document with fewer than five words is one shingle; null and
    empty texts, and items without a word, match nothing. Rows stay as they are, in number and
    columns (a column of that name is replaced). Items reach the tasks in blocks of
    bounded size; every block sees all documents.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name])
    rows = items.select("item_id", "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // ITEM_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    kind = rows.schema["item_id"].dataType
    entry = T.StructType([T.StructField("item_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("n_found", T.LongType())])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(entry))])
    out = kept.withColumn(name, F.array().cast(T.ArrayType(entry)))
    for block in range(count):
        some = dealt.where(F.col("block") == block).orderBy("item_id", "text").toArrow()
        out = out.mapInArrow(_matcher(spark_broadcast(docs, some), name), schema)
    return out


def spark_broadcast(docs: DataFrame, some: pa.Table):
    """One block of items on every executor."""
    return docs.sparkSession.sparkContext.broadcast(Items(some["item_id"].to_pylist(), some["text"]))


def _matcher(block, name: str):
    def run(batches):
        items: Items = block.value
        for batch in batches:
            place = batch.schema.get_field_index(name)
            for low, high, texts in blocks(texts_of(batch.column("text"))):
                part = batch.slice(low, high - low)
                found = items.find(texts)
                if found:
                    lists = part.column(place).to_pylist()
                    for text, item, n in found:
                        size = int(items.begin[item + 1] - items.begin[item])
                        lists[text].append({"item_id": items.ids[item], "n_shingles": size, "n_found": n})
                    columns = list(part.columns)
                    columns[place] = pa.array(lists, part.schema.field(place).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return run
