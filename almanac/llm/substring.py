"""Substring dedup: words inside long passages that occur elsewhere are removed.

Anchors are fixed, non-overlapping blocks of words of every document. Any passage of
``2 * BLOCK - 1`` words contains a whole block of its own document, wherever it begins, so it is
enough to index the blocks and probe them with every rolling window of the block's length.
Around blocks that were hit, windows of the full length are compared exactly; neighbouring
repeated windows run together into the maximal repeats, which are removed.

Documents are dealt to groups by id, once; each pass reads that one shuffle again. A group sends
its window hashes in ascending order, packed by difference, to ranges of the hash space, and
gets one bit back for each. A passage with any number of copies is one entry a group there: no
pairs are made, no range or group grows with the number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ranges import cuts, pack, unpack
from .textbytes import SPACE, SpanHash, Texts, blocks, mix, texts_of, windows

WINDOW = 35
#: Text bytes in a group, and those whose hashes share a range.
GROUP_BYTES, RANGE_BYTES = 8 << 20, 24 << 20
ANCHOR_BITS = 48
SECOND = np.uint64(0x8CB92BA72F3D8DD7)
PACKED = "hop int, range int, dealt int, n long, keys binary, checks binary, many binary, anchor binary"
REPLY = "hop int, range int, dealt int, bits binary"


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Group:
    """The documents of one group in a fixed order, with their words and the windows asked about."""

    def __init__(self, table: pa.Table, window: int, ranges: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.window, self.block, self.ranges = window, (window + 1) // 2, ranges
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, texts in blocks(texts_of(self.table["text"])):
            found, first = texts.words()
            words.append(found)
            counts.append(np.diff(first))
        self.words, self.counts = np.concatenate(words), np.concatenate(counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        # documents shorter than a window can't hold a repeat
        self.long = np.flatnonzero(self.counts >= window)
        keep = np.repeat(self.counts >= window, self.counts)
        self.words = self.words[keep]
        self.starts = np.concatenate(([0], np.cumsum(self.counts[self.long])))

    def anchors(self):
        """Distinct hashes of all rolling windows of a block's length, the place of each window's among
        them, and whether a window is a block."""
        rolling, begin = windows(self.words, self.starts, self.block)
        keys, place = np.unique(rolling >> np.uint64(64 - ANCHOR_BITS), return_inverse=True)
        offset = np.arange(len(rolling)) - np.repeat(begin[:-1], np.diff(begin))
        return keys, place, offset % self.block == 0, begin

    def candidates(self, hit: np.ndarray):
        """Starts (in words) of full windows whose first whole block was hit, with two hashes of each
        distinct one in order, and the place of each among them."""
        _, place, is_block, begin = self.anchors()
        text = np.repeat(np.arange(len(self.long)), np.diff(begin))
        at = np.arange(len(place)) - np.repeat(begin[:-1] - self.starts[:-1], np.diff(begin))
        blocks_hit = at[is_block & hit[place]]
        low = np.maximum(blocks_hit - self.block + 1, self.starts[text[is_block & hit[place]]])
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, blocks_hit + 1, -1)
        wanted = np.cumsum(change)[:-1] > 0
        one, begin = windows(self.words, self.starts, self.window)
        two, _ = windows(mix(self.words ^ SECOND), self.starts, self.window)
        at = np.arange(len(one)) - np.repeat(begin[:-1] - self.starts[:-1], np.diff(begin))
        chosen = wanted[at]
        starts, one, two = at[chosen], one[chosen], (two[chosen] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order].astype(np.int64)) != 0)
        place = np.zeros(len(order), np.int64)
        place[order] = np.cumsum(fresh) - 1
        return starts, one[order][fresh], two[order][fresh], place

    def rows(self, hop: int, dealt: int, keys, bits, many, checks=None, anchor=None) -> pa.Table:
        edges = cuts(keys, bits, self.ranges)
        filled = np.flatnonzero(np.diff(edges))
        spans = [slice(edges[r], edges[r + 1]) for r in filled]
        nothing = [b""] * len(spans)
        return pa.table(
            {
                "hop": pa.array([hop] * len(spans), pa.int32()),
                "range": pa.array(filled, pa.int32()),
                "dealt": pa.array([dealt] * len(spans), pa.int32()),
                "n": pa.array(np.diff(edges)[filled], pa.int64()),
                "keys": pa.array([pack(keys[s]) for s in spans], pa.binary()),
                "checks": pa.array(nothing if checks is None else [checks[s].tobytes() for s in spans], pa.binary()),
                "many": pa.array([_bits(many[s]) for s in spans], pa.binary()),
                "anchor": pa.array(nothing if anchor is None else [_bits(anchor[s]) for s in spans], pa.binary()),
            }
        )

    def replied(self, replies: pa.Table, hop: int, keys: np.ndarray, bits: int) -> np.ndarray:
        """The bits that came back, in the order of the keys."""
        out = np.zeros(len(keys), bool)
        edges = cuts(keys, bits, self.ranges)
        for h, r, data in zip(replies["hop"].to_pylist(), replies["range"].to_pylist(), replies["bits"].to_pylist()):
            if h == hop:
                out[edges[r] : edges[r + 1]] = _mask(data, edges[r + 1] - edges[r])
        return out


def _answer(table: pa.Table) -> pa.Table:
    """One range: which entries occur more than once (and, for anchors, are a block somewhere)."""
    rows = table.to_pylist()
    keys = np.concatenate([unpack(r["keys"]) for r in rows])
    sizes = [r["n"] for r in rows]
    many = np.concatenate([_mask(r["many"], n) for r, n in zip(rows, sizes)])
    checked = bool(rows[0]["checks"])
    checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows]) if checked else np.zeros(len(keys), np.uint32)
    order = np.lexsort((checks, keys)) if checked else np.argsort(keys)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = np.diff(keys[order]) != 0
    if checked:
        fresh[1:] |= np.diff(checks[order].astype(np.int64)) != 0
    value = np.cumsum(fresh) - 1
    repeated = (np.bincount(value) > 1) | (np.bincount(value, many[order]) > 0)
    if not checked:
        anchor = np.concatenate([_mask(r["anchor"], n) for r, n in zip(rows, sizes)])
        repeated &= np.bincount(value, anchor[order]) > 0
    found = np.zeros(len(keys), bool)
    found[order] = repeated[value]
    out, at = [], 0
    for r, n in zip(rows, sizes):
        own = found[at : at + n]
        at += n
        if own.any():
            out.append((r["hop"], r["range"], r["dealt"], _bits(own)))
    columns = list(zip(*out)) or [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["hop", "range", "dealt", "bits"])


def _kept(texts: Texts, removed: np.ndarray) -> list[bytes]:
    """The words of each text that are not removed, joined by one space."""
    start, end, first = texts.runs(~SPACE)
    size = np.where(removed, 0, end - start + 1)
    after = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(start - after[:-1], size) + np.arange(after[-1])
    joined = texts.data[np.minimum(source, len(texts.data) - 1)] if len(source) else np.zeros(0, np.uint8)
    joined[after[1:][size > 0] - 1] = 0x20
    raw = joined.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(after[first[:-1]], after[first[1:]])]


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``n_words``, ``n_removed``, ``repeats`` (the removed
    stretches as words ``[start, end)``) and ``kept``, the words left, joined by one space.

    A word goes if a run of ``window`` words that covers it also begins at any other place, in
    the same document or another; all runs are judged on the input. Repeated rows are other
    places of each other. A null or empty text has no words and an empty ``kept``; null ids are
    allowed; columns other than these two are left out.
    """
    texts = docs.select("doc_id", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, ranges = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // RANGE_BYTES))
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("group")), F.lit(groups)).cast("int")
    dealt = texts.withColumn("dealt", key).repartition("dealt")

    def ask_anchors(key, table):
        group = Group(table, window, ranges)
        keys, place, is_block, _ = group.anchors()
        anchor = np.zeros(len(keys), bool)
        anchor[place[is_block]] = True
        return group.rows(1, key[0].as_py(), keys, ANCHOR_BITS, np.bincount(place, minlength=len(keys)) > 1, anchor=anchor)

    def ask_windows(key, table, replies):
        group = Group(table, window, ranges)
        hit = group.replied(replies, 1, group.anchors()[0], ANCHOR_BITS)
        _, one, two, place = group.candidates(hit)
        return group.rows(2, key[0].as_py(), one, 64, np.bincount(place, minlength=len(one)) > 1, checks=two)

    kind = texts.schema["doc_id"].dataType.simpleString()
    out_schema = f"doc_id {kind}, n_words long, n_removed long, repeats array<struct<start: long, end: long>>, kept string"

    def remove(key, table, replies):
        group = Group(table, window, ranges)
        covered = np.zeros(len(group.words) + 1, np.int64)
        if len(replies):
            hit = group.replied(replies, 1, group.anchors()[0], ANCHOR_BITS)
            starts, one, _, place = group.candidates(hit)
            starts = starts[group.replied(replies, 2, one, 64)[place]]
            covered[starts] += 1
            np.add.at(covered, starts + window, -1)
        gone = np.zeros(int(group.first[-1]), bool)
        gone[np.repeat(group.counts >= window, group.counts)] = np.cumsum(covered)[:-1] > 0
        text = np.repeat(np.arange(len(group.counts)), group.counts)
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        begin = np.ones(len(gone), bool)
        begin[1:] = text[1:] != text[:-1]
        opens = np.flatnonzero(gone & ((edge[:-1] == 1) | begin))
        last = np.ones(len(gone), bool)
        last[:-1] = begin[1:]
        closes = np.flatnonzero(gone & ((edge[1:] == -1) | last)) + 1
        origin = group.first[text[opens]]
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(text[opens], np.arange(len(group.counts) + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(opens - origin), pa.array(closes - origin)], names=["start", "end"]),
        )
        kept = []
        for low, high, part in blocks(texts_of(group.table["text"])):
            kept += _kept(part, gone[group.first[low] : group.first[high]])
        return pa.table(
            {
                "doc_id": group.table["doc_id"],
                "n_words": pa.array(group.counts, pa.int64()),
                "n_removed": pa.array(np.diff(np.concatenate(([0], np.cumsum(gone)))[group.first]), pa.int64()),
                "repeats": lists,
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    def answers(asked: DataFrame) -> DataFrame:
        return asked.groupBy("range").applyInArrow(_answer, REPLY).repartition("dealt")

    hits = answers(dealt.groupBy("dealt").applyInArrow(ask_anchors, PACKED))
    asked = dealt.groupBy("dealt").cogroup(hits.groupBy("dealt")).applyInArrow(ask_windows, PACKED)
    replies = hits.unionByName(answers(asked))
    return dealt.groupBy("dealt").cogroup(replies.groupBy("dealt")).applyInArrow(remove, out_schema)
