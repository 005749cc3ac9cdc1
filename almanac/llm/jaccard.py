"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size whose Jaccard similarity is at least ``THRESHOLD`` differ in few features.
For each band of sizes the feature domain is cut into first-level parts, and each part into
``PARTS``; subsets of ``PARTS - 1`` of those are enumerated, and a subset's features are a
signature. Sets that differ in ``h`` features share a known number of signatures, so each set may
leave out one signature less than that: it leaves out those that most sets have, in an order
that all sets agree on. No pair that links is lost.

Equal sets are one class before any signature is made. How often a signature occurs is found by
sending sorted, packed hashes to ranges of the hash space. Classes that share a signature are a
bucket of candidates, whose links ``buckets`` finds by exact comparison without making a row of
every pair; no link that joins two components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import Written, materialize
from . import buckets
from .ranges import cuts, pack, unpack
from .textbytes import blocks, mix, pair, shingles, texts_of

WIDTH = 5
#: Jaccard similarity in percent. Below, "9" and "5 / 4" follow from it.
THRESHOLD = 80
PARTS = 3
#: First-level parts for each feature in which two sets of a band may differ.
SPREAD = 0.7
BAND_RATIO = 1.5
KEY_BITS = 48
GROUP_BYTES, RANGE_BYTES = 8 << 20, 24 << 20
#: Features whose signatures are made at a time; a larger set is a slice of its own.
SLICE = 1 << 16


def _bands(largest: int) -> np.ndarray:
    """First size of each band, up to one band past ``largest``."""
    edges = [1]
    while edges[-1] <= largest * 5 // 4 + 1:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO) + 1))
    return np.array(edges)


class Signatures:
    """All signatures of some sets: hash, and set; and how many of them each must keep.

    They are made for some sets at a time, as a feature takes many times its bytes on the way.
    """

    def __init__(self, hashes: np.ndarray, begin: np.ndarray):
        parts, entries, low, sets = [], 0, 0, len(begin) - 1
        while low < sets or not parts:
            high = int(np.searchsorted(begin, begin[low] + SLICE, side="right")) - 1
            high = min(sets, max(high, low + 1))
            some = _Slice(hashes[begin[low] : begin[high]], begin[low : high + 1] - begin[low])
            parts.append((some.set + low, some.keep, some.hash, some.entry + entries))
            entries += len(some.keep)
            low = high
        self.set, self.keep, self.hash, self.entry = (np.concatenate(p) for p in zip(*parts))

    def kept(self, often: np.ndarray) -> np.ndarray:
        """Places of the signatures that a set keeps and shares with another.

        ``often`` has the logarithm of how many sets have a signature; those nobody else has come first.
        """
        many = np.flatnonzero(often > 0)
        alone = np.bincount(self.entry[often == 0], minlength=len(self.keep))
        order = many[np.lexsort((self.hash[many] >> np.uint64(64 - KEY_BITS), often[many], self.entry[many]))]
        first = np.searchsorted(self.entry[order], np.arange(len(self.keep)))
        rank = alone[self.entry[order]] + np.arange(len(order)) - first[self.entry[order]]
        return order[rank < self.keep[self.entry[order]]]


class _Slice:
    """The signatures of a few sets."""

    def __init__(self, hashes: np.ndarray, begin: np.ndarray):
        size = np.diff(begin)
        edges = _bands(int(size.max(initial=1)))
        own = np.searchsorted(edges, size, side="right") - 1
        reach = np.searchsorted(edges, size * 5 // 4, side="right") - 1
        # a set takes part in its own band and in those of larger sets it may link with
        entries = [(np.flatnonzero((size > 0) & (own + step <= reach)), step) for step in range(int((reach - own).max(initial=0)) + 1)]
        self.set = np.concatenate([e for e, _ in entries])
        band = np.concatenate([own[e] + step for e, step in entries])
        top = edges[band + 1] - 1
        most = 2 * top // 9
        parts = np.ceil(SPREAD * (most + 1)).astype(np.int64)
        n = size[self.set]
        differ = (n + np.minimum(n * 5 // 4, top)) // 9
        shared = np.where(differ <= parts, PARTS * parts - 2 * differ, 2 * parts - differ)
        self.keep = PARTS * parts - shared + 1
        # features of every entry, summed up by part; sums don't depend on order
        after = np.concatenate(([0], np.cumsum(n)))
        source = np.repeat(begin[self.set] - after[:-1], n) + np.arange(after[-1])
        feature = mix(hashes[source])
        entry = np.repeat(np.arange(len(n)), n)
        coarse = ((feature >> np.uint64(32)) * parts[entry].astype(np.uint64)) >> np.uint64(32)
        fine = ((feature & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS)) >> np.uint64(32)
        cells = np.concatenate(([0], np.cumsum(parts)))
        cell = (cells[entry] + coarse.astype(np.int64)) * PARTS + fine.astype(np.int64)
        order = np.argsort(cell, kind="stable")
        sums = np.zeros(int(cells[-1]) * PARTS, np.uint64)
        if len(cell):
            ordered = cell[order]
            heads = np.flatnonzero(np.diff(ordered, prepend=-1))
            sums[ordered[heads]] = np.add.reduceat(mix(feature[order]), heads)
        sums = sums.reshape(-1, PARTS)
        place = np.arange(len(sums)) - np.repeat(cells[:-1], parts)
        where = mix((np.repeat(band, parts) << 40 | place).astype(np.uint64))
        found = np.empty((len(sums), PARTS), np.uint64)
        for left_out in range(PARTS):
            state = where + np.uint64(left_out + 1)
            for part in range(PARTS):
                if part != left_out:
                    state = pair(state, sums[:, part])
            found[:, left_out] = state
        self.hash = found.ravel()
        self.entry = np.repeat(np.arange(len(n)), parts * PARTS)


def _class_of(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set; zero for an empty one."""
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(salt)), out=sums[1:])
        whole = mix((sums[begin[1:]] - sums[begin[:-1]]) ^ mix(np.diff(begin).astype(np.uint64)))
        out.append(np.where(np.diff(begin) > 0, whole, np.uint64(0)).astype(np.int64))
    return out[0], out[1]


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and the two hashes ``one``, ``two`` of its set."""

    def run(batches):
        for batch in batches:
            for low, high, texts in blocks(texts_of(batch.column("text"))):
                hashes, begin = shingles(*texts.lowered().words(), WIDTH)
                one, two = _class_of(hashes, begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(begin)), pa.array(one), pa.array(two)],
                    names=["doc_id", "n_shingles", "one", "two"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, one long, two long"
    )


ASKED = "range int, dealt int, n long, keys binary, counts binary"
REPLY = "range int, dealt int, often binary"
FOUND = "signature long, set long, n long, weight int, features binary, sketch array<long>"


class Group:
    """The sets that stand for their classes among the documents of one group, in a fixed order."""

    def __init__(self, table: pa.Table):
        told = table.filter(pc.is_valid(table["set"]))
        wanted = set(zip(told["doc_id"].to_pylist(), told["set"].to_pylist()))
        texts = table.filter(pc.is_null(table["set"])).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = texts.filter(pc.is_in(texts["doc_id"], told["doc_id"].combine_chunks()))
        ids = texts["doc_id"].to_pylist()
        hashes, sizes, names = [np.zeros(0, np.uint64)], [], []
        for low, _, part in blocks(texts_of(texts["text"])):
            found, begin = shingles(*part.lowered().words(), WIDTH)
            one, _ = _class_of(found, begin)
            for row, name in enumerate(one.tolist()):
                if (ids[low + row], name) in wanted:
                    wanted.remove((ids[low + row], name))
                    hashes.append(found[begin[row] : begin[row + 1]])
                    sizes.append(begin[row + 1] - begin[row])
                    names.append(name)
        self.names = np.array(names, np.int64)
        self.hashes, self.begin = np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))).astype(np.int64)
        self.signatures = Signatures(self.hashes, self.begin)
        self.keys, self.place = np.unique(self.signatures.hash >> np.uint64(64 - KEY_BITS), return_inverse=True)


def _count(table: pa.Table) -> pa.Table:
    """One range: the logarithm of how many sets have each signature, to every group that asked."""
    rows = table.to_pylist()
    keys = np.concatenate([unpack(r["keys"]) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], "<u2") for r in rows])
    _, value = np.unique(keys, return_inverse=True)
    often = np.log2(np.bincount(value, counts)).astype(np.uint8)[value]
    out, at = [], 0
    for r in rows:
        own = often[at : at + r["n"]]
        at += r["n"]
        if own.any():
            out.append((r["range"], r["dealt"], own.tobytes()))
    columns = list(zip(*out)) or [()] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["range", "dealt", "often"])


def _shared(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Signatures that a class keeps and shares, with its set; and the features of those classes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, ranges = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // RANGE_BYTES))
    key = F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups)).cast("int")
    rows = docs.select("doc_id", "text", F.lit(None).cast("long").alias("set")).unionByName(
        told.select("doc_id", F.lit(None).cast("string").alias("text"), F.col("one").alias("set"))
    )
    dealt = rows.withColumn("dealt", key).repartition("dealt")

    def ask(key, table):
        group = Group(table)
        edges = cuts(group.keys, KEY_BITS, ranges)
        counts = np.minimum(np.bincount(group.place, minlength=len(group.keys)), 65535).astype("<u2")
        filled = np.flatnonzero(np.diff(edges))
        spans = [slice(edges[r], edges[r + 1]) for r in filled]
        return pa.table(
            {
                "range": pa.array(filled, pa.int32()),
                "dealt": pa.array([key[0].as_py()] * len(spans), pa.int32()),
                "n": pa.array(np.diff(edges)[filled], pa.int64()),
                "keys": pa.array([pack(group.keys[s]) for s in spans], pa.binary()),
                "counts": pa.array([counts[s].tobytes() for s in spans], pa.binary()),
            }
        )

    def choose(key, table, replies):
        group = Group(table)
        edges = cuts(group.keys, KEY_BITS, ranges)
        often = np.zeros(len(group.keys), np.uint8)
        for r, data in zip(replies["range"].to_pylist(), replies["often"].to_pylist()):
            often[edges[r] : edges[r + 1]] = np.frombuffer(data, np.uint8)
        signatures = group.signatures
        kept = signatures.kept(often[group.place])
        own = signatures.set[signatures.entry[kept]]
        used = np.unique(own)
        features = [pack(np.unique(group.hashes[a:b] >> np.uint64(16))) for a, b in zip(group.begin[used], group.begin[used + 1])]
        sketches = pa.array([buckets.sketch(group.hashes[a:b]) for a, b in zip(group.begin[used], group.begin[used + 1])], pa.list_(pa.int64()))
        none = pa.nulls(len(used), pa.int64())
        return pa.table(
            {
                "signature": pa.chunked_array([pa.array(signatures.hash[kept].view(np.int64)), none]),
                "set": pa.chunked_array([pa.array(group.names[own]), pa.array(group.names[used])]),
                "n": pa.chunked_array([pa.array(np.diff(group.begin)[own]), pa.array(np.diff(group.begin)[used])]),
                "weight": pa.chunked_array([pa.array(np.bincount(own)[own] if len(own) else own, pa.int32()), pa.nulls(len(used), pa.int32())]),
                "features": pa.chunked_array([pa.nulls(len(kept), pa.binary()), pa.array(features, pa.binary())]),
                "sketch": pa.chunked_array([pa.nulls(len(kept), pa.list_(pa.int64())), sketches]),
            }
        )

    replies = dealt.groupBy("dealt").applyInArrow(ask, ASKED).groupBy("range").applyInArrow(_count, REPLY)
    return dealt.groupBy("dealt").cogroup(replies.groupBy("dealt")).applyInArrow(choose, FOUND)


def components_of(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the classes that link with another."""
    found = Written(_shared(docs, told), "signatures")
    features = Written(found.frame.where("signature is null").select("set", "n", "features", "sketch"), "features")
    members = found.frame.where("signature is not null").select(F.col("signature").alias("key"), "set", "n", "weight")
    kept = Written(buckets.once(members), "members")
    found.drop()
    roots = buckets.connect(kept.frame, features.frame)
    features.drop()
    kept.drop()
    return roots


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`classes`, written, and for each class (``one``, ``two``) of them its ``root``, the same for all
    classes of a component, and ``component_id``."""
    rows = materialize(classes(docs), "classes")
    told = rows.where("doc_id is not null and n_shingles > 0").groupBy("one", "two").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    roots = components_of(texts, told)
    # the smallest id of every component, for each class in it
    named = told.join(roots.select(F.col("node").alias("one"), "root"), "one", "left").withColumn("root", F.coalesce("root", "one"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows, named.join(least, "root").select("one", "two", "root", "component_id")


def join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles`` and ``component_id``, the smallest
    id it reaches by links of 80 percent Jaccard similarity of five-word shingle sets.

    A-Z is lowered; with fewer than five words the whole sequence is the one shingle. A null,
    empty or blank text has an empty set and is linked with nothing. Rows with equal sets, also
    repeated rows, are linked. A null id keeps a null component and links nothing. Columns
    other than these two are left out.
    """
    rows, label = grouped(docs)
    return rows.join(label, ["one", "two"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
