"""Substring dedup, Jaccard join and decontamination against plain versions."""

import random
import tracemalloc

import numpy as np
import pytest
from brute import components as plain_components, contained, dedup as plain_dedup

from almanac import session
from almanac.llm import buckets, components, decontaminate, jaccard, substring

random.seed(8)
VOCABULARY = [f"W{i}" for i in range(400)]


def prose(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def changed(words, share):
    return [random.choice(VOCABULARY) if random.random() < share else w for w in words]


def corpus():
    passage, base = prose(60), prose(150)
    texts = [" ".join(prose(random.choice([3, 20, 80, 200]))) for _ in range(40)]
    texts += [" ".join(changed(base, share)) for share in (0.002, 0.01, 0.02, 0.03, 0.05) for _ in range(8)]
    texts += [" ".join(prose(random.randint(0, 40)) + passage[random.randint(0, 20) :] + prose(30)) for _ in range(15)]
    texts += [" ".join(base), " ".join(base).lower(), "\n".join(base), "a b c", "A  b c", "x", "loop " * 90, " ".join(passage * 3)]
    return texts + [None, "", " \n", "word"]


@pytest.mark.parametrize("window", [4, 9, 35])
def test_dedup_matches_a_plain_version(spark, window, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", 4000)
    monkeypatch.setattr(substring, "RANGE_BYTES", 6000)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, dealt int")
    got = {r.doc_id: r for r in substring.dedup(docs, window).collect()}
    for i, (n, gone, kept) in enumerate(plain_dedup(texts, window)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (n, gone, kept), i
        assert sum(s.end - s.start for s in got[i].repeats) == gone


def test_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    text = " ".join(f"u{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a " + text), (2, "b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed, r.kept) for r in substring.dedup(docs).collect()) == [(0, 50, "a"), (1, 50, ""), (1, 50, ""), (2, 0, "b c")]
    assert substring.dedup(docs.limit(0)).count() == 0


def joined(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}


def test_join_finds_every_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 4000)
    monkeypatch.setattr(jaccard, "RANGE_BYTES", 6000)
    monkeypatch.setattr(buckets, "SHARE", 3)
    rows = [(3 * i + 1, t) for i, t in enumerate(corpus())]
    random.shuffle(rows)
    got, expected = joined(spark, rows), plain_components(rows)
    assert {i: c for i, (_, c) in got.items()} == expected
    assert len(set(expected.values())) < len(expected)


def test_join_of_chains_ties_and_sizes(spark):
    # each text shares exactly eight of ten shingles' union with the next
    words = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 13])) for i in range(40)] + [(100, " ".join(words[:8])), (101, " ".join(words[:9])), (102, "a b"), (103, "A B"), (104, None), (105, "")]
    got = joined(spark, rows)
    assert {i: c for i, (_, c) in got.items()} == plain_components(rows)
    assert got[39][1] == 0 and got[103] == (1, 102) and got[104] == (0, 104)


def test_join_of_repeated_and_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.join(docs).collect()) == [(0, 0), (2, 2), (4, 2), (4, 2)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_many_texts_with_one_template_and_few_links(spark):
    # three quarters of each text are a template's: no pair of them links, and no pair may become a row
    random.seed(20)
    template = [f"t{i}" for i in range(90)]
    rows = [(i, " ".join(template + [f"{i}x{k}" for k in range(30)])) for i in range(5000)]
    rows += [(6000 + i, rows[9 * i][1] + " more") for i in range(50)]
    want = {i: i for i, _ in rows} | {6000 + i: 9 * i for i in range(50)}
    assert {i: c for i, (_, c) in joined(spark, rows).items()} == want


def test_signatures_of_many_sets_are_made_in_little_memory():
    rng = np.random.default_rng(22)
    begin = np.concatenate(([0], np.cumsum(rng.integers(0, 600, 2500))))
    hashes = rng.integers(0, 1 << 62, begin[-1]).astype(np.uint64)
    tracemalloc.start()
    whole = jaccard.Signatures(hashes, begin)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(hashes)
    for k in (0, 700, 2499):
        one = jaccard.Signatures(hashes[begin[k] : begin[k + 1]], np.array([0, begin[k + 1] - begin[k]]))
        assert sorted(one.hash.tolist()) == sorted(whole.hash[whole.set[whole.entry] == k].tolist())
        assert one.keep.tolist() == whole.keep[whole.set == k].tolist()


def test_join_of_a_very_long_text(spark):
    random.seed(21)
    long = [f"v{random.randrange(5000)}" for _ in range(150_000)]
    near = list(long)
    for at in range(0, len(near), 60):
        near[at] = "edited"
    rows = [(5, " ".join(long)), (4, " ".join(near)), (3, " ".join(long[:75_000])), (9, "short")]
    assert {i: c for i, (_, c) in joined(spark, rows).items()} == {5: 4, 4: 4, 3: 3, 9: 9}


def test_components_of_a_long_chain_a_star_and_noise(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (5, 4)]
    random.shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}


def test_items_inside_long_documents(spark, monkeypatch):
    items = [(i, " ".join(prose(random.choice([2, 4, 5, 9, 17, 40, 90])))) for i in range(30)] + [(90, None), (91, ""), (92, "only three words")]
    docs = []
    for i in range(60):
        words = prose(random.choice([0, 10, 400, 3000]))
        for _ in range(random.randint(0, 2)):
            item = random.choice(items)[1] or ""
            at = random.randint(0, len(words))
            words[at:at] = changed(item.split(), random.choice([0, 0, 0.01]))
        docs.append((i, " ".join(words).upper()))
    docs += [(60, None), (61, ""), (62, "Only THREE words"), (63, items[0][1])]
    for limit in (decontaminate.ITEM_BYTES, 700):
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", limit)
        frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, Matches int")
        found = decontaminate.search(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
        got = sorted((r.doc_id, m.item_id, m.n_shingles, m.n_found) for r in found for m in r.matches)
        assert got == contained(docs, items) and len(found) == len(docs)
    none = decontaminate.search(frame, spark.createDataFrame([], "item_id long, text string"))
    assert all(r.matches == [] for r in none.collect())


def test_hubs_and_stars_have_small_plans(spark, monkeypatch):
    # the driver plans each written table anew while it runs; joins repeated in one plan fill its memory
    joins = []

    class Counted(session.Written):
        def __init__(self, df, label):
            joins.append((label, df._jdf.queryExecution().optimizedPlan().toString().count("Join ")))
            super().__init__(df, label)

    monkeypatch.setattr(buckets, "Written", Counted)
    for name, value in (("Written", Counted), ("materialize", lambda df, label: Counted(df, label).frame)):
        monkeypatch.setattr(components, name, value, raising=False)
    random.seed(23)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(random.choice(words) if random.random() < 0.01 else w for w in words)) for i in range(60)]
    jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {"asked", "links", "stars"} <= {label for label, _ in joins}
    assert max(n for label, n in joins if label in ("asked", "links", "large", "stars")) <= 3, joins
