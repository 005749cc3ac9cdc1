"""From buckets of candidate sets to connected components of exact links.

A bucket holds sets that may link with one another. Its members are compared exactly with one of
them, the hub; then those that are still in another component with a second one, and so on for a
few rounds, so a group of near copies of any size costs some comparisons a member and not one a
pair. Before features travel, a parity sketch of both sets must allow the link. What is still apart
in a bucket after that is compared in blocks of bounded size: every member outside the bucket's
largest component with all others, first by sketches alone; members for which a sketch allows a
link then get their features, and the same blocks find the links. Rows are members and links that
join parts of a block, never pairs. No link that joins two components is left out.

Members are ``key``, ``set``, ``n`` (size), ``weight`` (the first hub has most); features are ``set``, ``n``,
``features`` (packed ascending numbers), ``sketch`` and, if a set and a hub must also have one of some hashes
in common, those as ``shared``. Blocks compare all sets of a bucket, whatever they have in common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Written
from .components import components
from .ranges import unpack
from .textbytes import mix

#: Jaccard similarity in percent; "9" below follows from it: linked sets differ in a ninth of their sizes' sum at most.
THRESHOLD = 80
ROUNDS = 4
#: Comparisons with one hub that a task makes for it at a time, and members of a block.
SHARE, BLOCK = 256, 512
#: Numbers that a comparison of blocks holds at a time.
CHUNK = 1 << 21
LEAST_LONGS = 4


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of a set's features in each part of the domain, as bits; about one part a feature.

    A feature that only one of two sets has changes one bit at most, so sets with more different
    bits than the features they may differ in can't link. Half the parts are the two halves' sum.
    """
    longs = LEAST_LONGS
    while longs * 64 < len(hashes):
        longs *= 2
    cells = np.bincount((mix(hashes + np.uint64(3)) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _near(a: str, b: str) -> F.Column:
    """Whether two sizes allow a link."""
    return (F.col(a) * 100 >= F.col(b) * THRESHOLD) & (F.col(b) * 100 >= F.col(a) * THRESHOLD)


def _allowed(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose sketches, if equally long, and shared hashes allow a link."""
    tested = [c for c in ("shared",) if c in features.columns]
    for name in ("a", "b"):
        side = features.select(F.col("set").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "sketch", *tested)])
        pairs = pairs.join(side, name)
    differ = "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    if tested:
        pairs = pairs.where("arrays_overlap(shared_a, shared_b)")
    return pairs.where(f"size(sketch_a) <> size(sketch_b) or 9 * {differ} <= n_a + n_b").select("a", "b")


def linked(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) of sets that link, by exact comparison.

    Features of every ``a`` travel to its ``b``. A ``b`` with very many is met in several places.
    """
    per = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("places"))
    dealt = pairs.join(per, "b").withColumn("place", F.pmod(F.xxhash64("a"), F.col("places")).cast("int"))
    others = dealt.join(features.withColumnRenamed("set", "a"), "a").select("b", "place", "a", "n", "features")
    hubs = (
        per.select("b", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
        .join(features.withColumnRenamed("set", "b"), "b")
        .select("b", "place", F.lit(None).cast("long").alias("a"), "n", "features")
    )
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = others.unionByName(hubs).repartition(parts, "b", "place").sortWithinPartitions("b", "place", F.col("a").asc_nulls_first())

    def run(batches):
        hub, hub_n, hub_set = None, 0, None
        for batch in batches:
            left, right = [], []
            for b, a, n, data in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "n", "features"))):
                if a is None:
                    hub, hub_n, hub_set = b, n, unpack(data)
                    continue
                own = unpack(data)
                at = np.minimum(np.searchsorted(hub_set, own), len(hub_set) - 1)
                common = int((hub_set[at] == own).sum())
                if 100 * common >= THRESHOLD * (n + hub_n - common):
                    left.append(a), right.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def once(members: DataFrame) -> DataFrame:
    """Members without buckets of one set, and without buckets that hold the same sets as another."""
    content = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "set")).alias("y")]
    kept = members.groupBy("key").agg(*content).where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key"))
    return members.join(kept.select("key"), "key", "left_semi").select("key", "set", "n", "weight")


def connect(members: DataFrame, features: DataFrame, few: int = 0) -> DataFrame:
    """``node`` and ``root`` of every set that links with another. Frames should be written tables.

    Hubs are met only in buckets with more than ``few`` members outside their largest component;
    the others are left to the blocks, which compare them at once.
    """
    alive, used = members.withColumn("root", F.col("set")), None
    near = tried = roots = None
    for number in range(ROUNDS):
        crowded = alive
        if few:
            large = _sizes(alive).where(F.col("all") - F.col("major.c") > few).select("key")
            crowded = Written(alive.join(large, "key", "left_semi").select(*alive.columns), "crowded").frame
            if crowded.isEmpty():
                break
        order = F.struct("weight", "set") if number == 0 else F.struct(F.xxhash64("set", F.lit(number)), F.col("set"))
        hub = crowded.groupBy("key").agg(
            F.max_by(F.struct(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b")), order).alias("hub"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
        )
        hub = hub.where("low <> high").select("key", "hub.*")
        met = crowded.join(hub, "key").where((F.col("root") != F.col("root_b")) & _near("n", "n_b"))
        # one row for the two sets, whichever of them is the hub
        pairs = met.groupBy(F.greatest("set", "b").alias("x"), F.least("set", "b").alias("y")).agg(F.max("b").alias("b"))
        pairs = pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti")
        pairs = Written(pairs, "pairs").frame
        seen = pairs.select("x", "y")
        tried = seen if tried is None else tried.unionByName(seen)
        asked = pairs.select(F.when(F.col("x") == F.col("b"), F.col("y")).otherwise(F.col("x")).alias("a"), "b")
        # read several times: else every reader plans and makes these joins again
        asked = Written(_allowed(asked, features), "asked")
        more = Written(linked(asked.frame, features), "links").frame
        asked.drop()
        if more.isEmpty():
            if number:
                break
        else:
            near = more if near is None else near.unionByName(more)
            roots = components(near)
        alive, used = _still_apart(alive, roots, used)
    more = Written(_in_blocks(alive, features), "links").frame
    if near is None or not more.isEmpty():
        roots = components(more if near is None else near.unionByName(more))
    return roots


def _sizes(alive: DataFrame) -> DataFrame:
    """``key``, ``all`` members and the largest component (``major``: ``c`` members, ``root``) of every bucket."""
    parts = alive.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    return parts.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("major"))


def _still_apart(alive: DataFrame, roots: DataFrame | None, used: Written | None) -> tuple[DataFrame, Written]:
    """Members of buckets that hold several components, with their root, written; the table before it goes."""
    placed = alive
    if roots is not None:
        found = roots.select(F.col("node").alias("set"), F.col("root").alias("found"))
        placed = alive.join(found, "set", "left").withColumn("root", F.coalesce("found", "set")).drop("found")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    written = Written(placed.join(mixed.select("key"), "key", "left_semi").select(*alive.columns), "apart")
    if used is not None:
        used.drop()
    return written.frame, written


def _in_blocks(alive: DataFrame, features: DataFrame) -> DataFrame:
    """Links (``u``, ``v``) enough to connect what sets of one bucket and different components link."""
    buckets = _sizes(alive).where("all > major.c").select(
        "key",
        F.col("major.root").alias("major"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("all") - F.col("major.c")) / BLOCK).cast("int").alias("outside"),
    )
    rest = alive.join(buckets, "key").join(features.select("set", "sketch"), "set")
    deal = [F.pmod(F.xxhash64("set"), F.col(c)).cast("int") for c in ("outside", "blocks")]
    # members outside the largest component meet every block; every member meets all blocks of those
    left = rest.where(F.col("root") != F.col("major")).select(
        *HELD, deal[0].alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("asks")
    )
    right = rest.select(*HELD, F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("i"), deal[1].alias("j"), F.lit(False).alias("asks"))
    # a block is small and costly: as many tasks as the session has, whatever the bytes
    tasks = int(alive.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(tasks, "key", "i", "j").groupBy("key", "i", "j")
    allowed = Written(dealt.applyInArrow(_allowed_members, MEMBER), "allowed").frame
    held = allowed.join(features.select("set", "features"), "set").repartition(tasks, "key", "i", "j")
    return held.groupBy("key", "i", "j").applyInArrow(_links, "u long, v long").distinct()


HELD = ["key", "set", "n", "root", "sketch"]
MEMBER = "key long, set long, n long, root long, sketch array<long>, i int, j int, asks boolean"


class _Side:
    def __init__(self, rows: pa.Table):
        self.set, self.n, self.root = (rows[c].to_numpy() for c in ("set", "n", "root"))
        self.sketch = [np.array(s, np.int64).view(np.uint64) for s in rows["sketch"].to_pylist()]
        self.longs = np.array([len(s) for s in self.sketch], np.int64)

    def of(self, longs: int) -> tuple[np.ndarray, np.ndarray]:
        """Members whose sketch has so many longs, or twice as many, folded."""
        chosen = np.flatnonzero((self.longs == longs) | (self.longs == 2 * longs))
        rows = [self.sketch[i] if self.longs[i] == longs else self.sketch[i][:longs] ^ self.sketch[i][longs:] for i in chosen]
        return chosen, np.array(rows, np.uint64).reshape(len(chosen), longs)


def _possible(left: _Side, right: _Side):
    """Places (in each side) of the pairs of different components that sizes and sketches allow, some at a time."""
    for longs in np.unique(np.concatenate((left.longs, right.longs))).tolist():
        own, own_bits = left.of(longs)
        others, other_bits = right.of(longs)
        step = max(1, CHUNK // max(1, len(others) * longs))
        for low in range(0, len(own), step):
            some = own[low : low + step, None]
            differ = np.bitwise_count(own_bits[low : low + step, None, :] ^ other_bits[None, :, :]).sum(axis=2, dtype=np.int64)
            total = left.n[some] + right.n[others]
            least = np.minimum(left.n[some], right.n[others])
            fits = (9 * differ <= total) & (100 * least >= THRESHOLD * (total - least)) & (left.root[some] != right.root[others])
            i, j = np.nonzero(fits)
            yield some[i, 0], others[j]


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, _Side, _Side]:
    asks = table["asks"].to_numpy()
    own, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    return own, others, _Side(table.take(own)), _Side(table.take(others))


def _allowed_members(table: pa.Table) -> pa.Table:
    """The members of a block that have a possible pair."""
    own, others, left, right = _sides(table)
    used = np.zeros(len(table), bool)
    for i, j in _possible(left, right):
        used[own[i]] = used[others[j]] = True
    names = [field.split()[0] for field in MEMBER.split(", ")]
    return table.filter(pa.array(used)).select(names)


def _links(table: pa.Table) -> pa.Table:
    """Links between parts of a block: a pair that earlier ones already connect is not looked at."""
    own, others, left, right = _sides(table)
    data = table["features"].to_pylist()
    sets: dict[int, np.ndarray] = {}
    # the component of every member, those of the left side first
    part = np.unique(np.concatenate((left.root, right.root)), return_inverse=True)[1]
    mine, theirs = part[: len(own)], part[len(own) :]

    def features(row: int) -> np.ndarray:
        if row not in sets:
            sets[row] = unpack(data[row])
        return sets[row]

    u, v = [], []
    for i, j in _possible(left, right):
        members, first = np.unique(i, return_index=True)
        for a, asked in zip(members.tolist(), np.split(j, first[1:])):
            asked = asked[theirs[asked] != mine[a]]
            while len(asked):
                b, asked = int(asked[0]), asked[1:]
                x, y = features(int(own[a])), features(int(others[b]))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                if 100 * common >= THRESHOLD * int(left.n[a] + right.n[b] - common):
                    u.append(int(left.set[a])), v.append(int(right.set[b]))
                    part[part == mine[a]] = theirs[b]
                    asked = asked[theirs[asked] != mine[a]]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
