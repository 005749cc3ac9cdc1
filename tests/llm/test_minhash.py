import random

import numpy as np
import pyarrow as pa
import pytest
from brute import LOWER, WORD
from pyspark.sql import functions as F

from almanac.llm import buckets, minhash
from almanac.llm.ranges import pack


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)}) if w else set()


def plain(docs):
    sets = [(i, frozenset(shingle_set(t))) for i, t in docs]
    ids = sorted({i for i, _ in sets if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (x, a) in enumerate(known):
        for y, b in known[:k]:
            if 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((find(x), find(y)))
                root[high] = low
    return [(i, len(s), None if i is None else find(i) if s else i, i is None or not s or find(i) == i) for i, s in sets]


def found(spark, docs, **columns):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name, value in columns.items():
        frame = frame.withColumn(name, F.lit(value))
    rows = minhash.near_duplicates(frame).collect()
    return in_order((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def edited(words, share):
    return [random.choice(VOCABULARY) if random.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(400)]


def test_matches_brute_force(spark):
    random.seed(12)
    docs = []
    for _ in range(25):
        base = [random.choice(VOCABULARY) for _ in range(random.choice([1, 3, 4, 6, 12, 40, 150, 700]))]
        docs += [" ".join(edited(base, share)) for share in (0, 0, 0.01, 0.03, 0.05, 0.06, 0.1)]
    docs += [None, "", "  \n", "a b c", "A b  C", "a b c d", "a b c d e", "x " * 9, "x " * 12]
    docs = list(enumerate(docs))
    docs += [(3, docs[9][1]), (3, docs[3][1]), (None, docs[3][1]), (None, None), (4, docs[40][1])]
    assert found(spark, docs, n=1, bands="x", set=2, key="k") == in_order(plain(docs))


def test_a_chain_and_a_large_group_of_near_copies(spark):
    random.seed(13)
    base = [random.choice(VOCABULARY) for _ in range(200)]
    docs = [(i, " ".join(edited(base, 0.03))) for i in range(300)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(60):
        docs.append((1000 + i, " ".join(chain)))
        chain[(7 * i) % 100] = f"d{i}"
    assert found(spark, docs) == in_order(plain(docs))


def test_many_texts_with_one_template_and_no_link(spark, monkeypatch):
    # three quarters of each text are the same; the rest is its own, but for planted copies
    random.seed(14)
    template = [f"t{i}" for i in range(90)]
    docs = [(i, " ".join(template + [f"{i}x{k}" for k in range(30)])) for i in range(3000)]
    docs += [(5000 + i, docs[7 * i][1] + " more") for i in range(100)]
    want = {i: i for i, _ in docs} | {5000 + i: 7 * i for i in range(100)}
    assert {r[0]: r[2] for r in found(spark, docs)} == want


def test_blocks_compare_members_of_other_components(spark, monkeypatch):
    monkeypatch.setattr(buckets, "ROUNDS", 0)
    random.seed(15)
    base = [random.choice(VOCABULARY) for _ in range(90)]
    docs = [(i, " ".join(edited(base, 0.04))) for i in range(80)]
    assert found(spark, docs) == in_order(plain(docs))


def test_blocks_lose_no_pair():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 1200).astype(np.uint64)
    sets = [rng.choice(pool, n, replace=False) for n in (200, 255, 256, 257, 300, 511, 513, 600) for _ in range(3)]
    sets += [s[: int(len(s) * 0.95)] for s in sets]
    members = [[7, k, len(s), k, buckets.sketch(s).tolist(), 0, 0] for k, s in enumerate(sets)]
    names = [f.split()[0] for f in buckets.MEMBER.split(", ")]
    types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    rows = [[*m, asks, pack(np.unique(sets[m[1]] >> np.uint64(16)))] for m in members for asks in (True, False)]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*names, "features"])
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    allowed = buckets._allowed_members(table)
    assert linked and {i for pair in linked for i in pair} <= set(allowed["set"].to_pylist())
    found = buckets._links(table)
    got = {tuple(sorted(p, reverse=True)) for p in zip(found["u"].to_pylist(), found["v"].to_pylist())}
    assert got <= linked
    root = {i: i for i in range(len(sets))}

    def find(i):
        return i if root[i] == i else find(root[i])

    for x, y in got:
        root[find(x)] = find(y)
    assert all(find(x) == find(y) for x, y in linked)
    impossible = buckets._allowed_members(table.filter(pa.array([m[1] % 24 == 0 for m in members for _ in range(2)])))
    assert set(impossible["set"].to_pylist()) == {0, 24}


def test_bands_agree_about_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(60):
        whole = rng.integers(0, 1 << 62, 450).astype(np.uint64)
        a, b = np.sort(whole[:400]), np.sort(whole[50:])  # 350 of 450 in common
        out = minhash.bands(np.concatenate((a, b)), np.array([0, 400, 800]))
        assert set((out[0, : minhash.BANDS] & 1).tolist()) == {0} and set((out[0, minhash.BANDS :] & 1).tolist()) == {1}
        agree.append((out[0] == out[1]).mean())
    assert abs(np.mean(agree) - (350 / 450) ** minhash.ROWS) < 0.04


def test_a_very_long_text(spark):
    random.seed(16)
    long = [random.choice(VOCABULARY) for _ in range(200_000)]
    docs = [(1, " ".join(long)), (2, " ".join(edited(long, 0.02))), (3, " ".join(edited(long, 0.3))), (4, "short one")]
    assert found(spark, docs) == in_order(plain(docs))


@pytest.mark.parametrize("docs", [[], [(1, None)], [(None, "a b c d e")], [(2, "same"), (1, "same"), (1, "same")]])
def test_empty_tables_and_repeats(spark, docs):
    assert found(spark, docs) == in_order(plain(docs))


def test_a_set_costs_a_row_for_a_band_and_none_for_a_table(spark):
    random.seed(17)
    base = [random.choice(VOCABULARY) for _ in range(200)]
    docs = [(i, " ".join(edited(base, 0.01))) for i in range(150)]
    rows = minhash.signed(spark.createDataFrame(docs, "doc_id long, text string"))
    classes = rows.dropDuplicates(["one", "two"]).select("one", "two", "doc_id", F.col("n_shingles").alias("n"), "bands")
    members = minhash.tables(classes)
    per_set = [r["count"] for r in members.groupBy("set").count().collect()]
    assert len(per_set) > 100 and max(per_set) <= minhash.BANDS


def signed_classes(spark, docs):
    rows = minhash.signed(spark.createDataFrame(docs, "doc_id long, text string"))
    return rows.dropDuplicates(["one", "two"]).select("one", "two", "doc_id", F.col("n_shingles").alias("n"), "bands")


def test_near_copies_cost_a_few_rows_each(spark):
    random.seed(18)
    base = [random.choice(VOCABULARY) for _ in range(200)]
    classes = signed_classes(spark, [(i, " ".join(edited(base, 0.005))) for i in range(300)])
    members = minhash.tables(classes)
    sets = members.select("set").distinct().count()
    assert sets > 100 and members.count() < 6 * sets


@pytest.mark.parametrize("widest", [0, 2, 100])
def test_sets_that_share_a_table_share_a_bucket(spark, monkeypatch, widest):
    monkeypatch.setattr(minhash, "WIDEST", widest)
    random.seed(19)
    docs = []
    for _ in range(12):
        base = [random.choice(VOCABULARY) for _ in range(60)]
        docs += [" ".join(edited(base, share)) for share in (0, 0.02, 0.04, 0.08, 0.15, 0.25)]
    classes = signed_classes(spark, list(enumerate(docs)))
    bands = {r.one: (set(r.bands[: minhash.BANDS]), set(r.bands[minhash.BANDS :])) for r in classes.collect()}
    held = {}
    for r in minhash.tables(classes).collect():
        held.setdefault(r.set, set()).add(r.key)
    pairs = [(x, y) for x in bands for y in bands if x < y and bands[x][0] & bands[y][0] and bands[x][1] & bands[y][1]]
    assert pairs and all(held[x] & held[y] for x, y in pairs)


def test_bands_with_only_one_set_in_common_stay_apart(spark):
    # set 0 shares each band of the first collection with sets of its own; any two of those share none
    families, size = 8, 5
    rows = [(0, 0, 0, 5, [2 * b for b in range(minhash.BANDS)] + [1 + 2 * b for b in range(minhash.BANDS)])]
    for family in range(families):
        for k in range(size):
            name = 1 + family * size + k
            first = [2 * b if b == family else 1000 * name + 2 * b for b in range(minhash.BANDS)]
            rows.append((name, 0, name, 5, first + [1 + 2 * b for b in range(minhash.BANDS)]))
    classes = spark.createDataFrame(rows, "one long, two long, doc_id long, n long, bands array<long>")
    sizes = [r["count"] for r in minhash.tables(classes).groupBy("key").count().collect()]
    assert sorted(sizes) == [size + 1] * families
