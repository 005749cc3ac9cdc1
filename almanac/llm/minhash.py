"""Near-duplicate detection by MinHash with tensored banding.

Instead of separate minhashes for every table, two small collections of ``BANDS`` bands of ``ROWS``
minhashes are made; a table is a pair of bands, one of each collection, and its key combines their
two hashes. ``BANDS ** 2`` tables so cost ``2 * BANDS * ROWS`` minhashes, the square root of what that
many tables of ``2 * ROWS`` own ones would. A pair of similarity 0.8 shares no table with a probability
of about 1e-6: ``1 - (1 - (1 - 0.8 ** 3) ** 20) ** 2``.

No row is made for a table: the sets of all tables with one band of the first collection are a
bucket, and a set meets the hub of a bucket only if both agree in a band of the second collection too;
what the hubs leave apart is compared in the whole bucket. Buckets with the same least set are one
unless they have little else in common, as are those that hold the same sets. So a set costs
at most ``BANDS`` rows, however many tables it shares with its copies, and far fewer in a group of
near copies; and none, if no different set has one of its bands in each collection.
Candidates are compared exactly on full sets (``buckets``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Written, materialize
from . import buckets
from .ranges import pack
from .textbytes import blocks, mix, pair, shingles, texts_of

WIDTH = 4
BANDS, ROWS = 20, 3
#: Sets of a bucket of several bands, as a multiple of those of its largest band, above which it is not made.
WIDEST = 2
#: Ids, of sixteen bytes each, that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, 4 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _SCALE = _SEEDS[: 2 * BANDS * ROWS], _SEEDS[2 * BANDS * ROWS :] | np.uint64(1)


def bands(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The band hashes of each set, none of them empty: first those of one collection, with an even
    number, then those of the other, with an odd one."""
    out = np.empty((2 * BANDS, len(begin) - 1), np.uint64)
    for band in range(2 * BANDS):
        state = np.full(len(begin) - 1, band, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            state = pair(state, np.minimum.reduceat((hashes ^ _FLIP[row]) * _SCALE[row], begin[:-1]))
        out[band] = state & ~np.uint64(1) | np.uint64(band >= BANDS)
    return out.T.view(np.int64)


def set_names(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set, which together are its name."""
    out = []
    for salt in (1, 2):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(salt)), out=sums[1:])
        out.append(mix((sums[begin[1:]] - sums[begin[:-1]]) ^ mix(np.diff(begin).astype(np.uint64))).view(np.int64))
    return out[0], out[1]


def signed(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, the two names ``one``, ``two`` of its set and its ``bands``; an empty set has null ones."""

    def run(batches):
        for batch in batches:
            for low, high, texts in blocks(texts_of(batch.column("text"))):
                hashes, begin = shingles(*texts.lowered().words(), WIDTH)
                size = np.diff(begin)
                filled = np.flatnonzero(size)
                # empty sets take no place among the hashes
                edges = np.append(begin[:-1][filled], begin[-1])
                at = np.full(len(size), -1)
                at[filled] = np.arange(len(filled))
                at = pa.array(at, mask=at < 0)
                columns = [pa.array(n) for n in set_names(hashes, edges)]
                listed = pa.FixedSizeListArray.from_arrays(pa.array(bands(hashes, edges).ravel() if len(filled) else np.zeros(0, np.int64)), 2 * BANDS)
                columns.append(listed.cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(size), *(c.take(at) for c in columns)],
                    names=["doc_id", "n_shingles", "one", "two", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, one long, two long, bands array<long>"
    )


def tables(classes: DataFrame) -> DataFrame:
    """Members (``key``, ``set``, ``n``, ``weight``, the number of tables it may share) of the tables of every band of the
    first collection that several sets have, without keys that hold the same sets as another.

    Bands with the same least set are one bucket, so near copies cost a few rows a set and not one
    for each band. A bucket of bands that have little in common would compare many more pairs than
    they do: above ``WIDEST`` times the sets of its largest band, its bands stay apart.
    """
    each = classes.select(F.col("one").alias("set"), "n", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("set").alias("low"), F.max("set").alias("high"), F.count(F.lit(1)).alias("sets")).where("low <> high")
    shared = Written(shared.select("band", "low", "sets"), "shared")
    own = each.join(shared.frame.select("band", "low"), "band").groupBy("set", "n").agg(F.collect_list(F.struct("band", "low")).alias("shared"))
    halves = own.select("set", "n", F.expr("filter(shared, b -> b.band & 1 = 0)").alias("left"), F.expr("size(filter(shared, b -> b.band & 1 = 1))").alias("right"))
    halves = halves.where("size(left) > 0 and right > 0").select("set", "n", (F.size("left") * F.col("right")).alias("weight"), "left")
    found = Written(halves, "tables")
    merged = Written(found.frame.select("set", "n", "weight", F.explode(F.array_distinct("left.low")).alias("key")), "merged")
    largest = shared.frame.where("band & 1 = 0").groupBy(F.col("low").alias("key")).agg(F.max("sets").alias("largest"))
    wide = merged.frame.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).join(largest, "key").where(F.col("sets") > WIDEST * F.col("largest"))
    wide = Written(wide.select("key"), "wide")
    members = merged.frame
    if not wide.frame.isEmpty():
        apart = found.frame.select("set", "n", "weight", F.explode("left").alias("b")).select("set", "n", "weight", "b.band", F.col("b.low").alias("key"))
        apart = apart.join(wide.frame, "key", "left_semi").select(F.col("band").alias("key"), "set", "n", "weight")
        members = members.join(wide.frame, "key", "left_anti").select("key", "set", "n", "weight").unionByName(apart)
    kept = materialize(buckets.once(members), "members")
    for written in (shared, found, merged, wide):
        written.drop()
    return kept


FEATURES = "set long, n long, features binary, sketch array<long>, shared array<long>"


def features(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Features, sketches and bands of the second collection (``shared``) of the ``wanted`` sets (``set``, ``doc_id``), from
    the texts of their documents."""

    def run(batches):
        for batch in batches:
            names = batch.column("set").to_numpy()
            for low, _, texts in blocks(texts_of(batch.column("text"))):
                hashes, begin = shingles(*texts.lowered().words(), WIDTH)
                one, _ = set_names(hashes, begin)
                # another row may have the id and not the set
                rows = np.flatnonzero(one == names[low : low + len(one)])
                sets = [hashes[begin[r] : begin[r + 1]] for r in rows]
                second = [bands(s, np.array([0, len(s)]))[0, BANDS:] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one[rows]),
                        pa.array(np.diff(begin)[rows]),
                        pa.array([pack(np.unique(s >> np.uint64(16))) for s in sets], pa.binary()),
                        pa.array([buckets.sketch(s) for s in sets], pa.list_(pa.int64())),
                        pa.array(second, pa.list_(pa.int64())),
                    ],
                    names=["set", "n", "features", "sketch", "shared"],
                )

    count = wanted.count()
    ids = F.broadcast(wanted) if count <= BROADCAST_IDS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = Written(texts.join(ids, "doc_id").select("set", "text").mapInArrow(run, FEATURES), "features")
    if found.frame.count() == count:
        return found.frame
    # rows that repeat an id and its text
    once = materialize(found.frame.dropDuplicates(["set"]), "features")
    found.drop()
    return once


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_shingles``, ``component_id``, the smallest id it reaches by
    links of 80 percent Jaccard similarity of four-word shingle sets, and ``kept``: whether it is that one.

    A-Z is lowered; with fewer than four words the whole sequence is the one shingle. A null,
    empty or blank text has an empty set, is linked with nothing and kept. Rows with equal sets,
    also repeated rows, are linked; rows that repeat the kept id are all kept. A null id has a
    null component, links nothing and is kept. Whole texts count, however long. Columns other
    than these two are left out.
    """
    written = Written(signed(docs), "signed")
    rows = written.frame
    classes = rows.where("doc_id is not null and one is not null").groupBy("one", "two").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("m"))
    classes = materialize(classes.select("one", "two", "m.doc_id", F.col("m.n_shingles").alias("n"), "m.bands"), "classes")
    members = tables(classes)
    # every set in a bucket is wanted once
    wanted = materialize(
        classes.select(F.col("one").alias("set"), "doc_id").join(members.select("set").distinct(), "set", "left_semi"), "wanted"
    )
    roots = buckets.connect(members, features(docs, wanted), few=buckets.BLOCK)
    named = classes.select("one", "two", "doc_id").join(roots.select(F.col("node").alias("one"), "root"), "one", "left")
    named = named.withColumn("root", F.coalesce("root", "one"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = named.join(least, "root").select("one", "two", "component_id")
    found = rows.select("doc_id", "n_shingles", "one", "two").join(label, ["one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
