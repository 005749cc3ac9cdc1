import random

import numpy as np
import pyarrow as pa

from almanac.llm import toxicity
from almanac.llm.textbytes import texts_of

random.seed(6)
CLEAN = [f"{a}{b}" for a in ("ba", "ko", "mi", "re", "su") for b in ("lan", "tor", "ven", "dix")]
BAD = ["grunk", "snarfel"]


def made(n):
    rows = []
    for i in range(n):
        sentences = [" ".join(random.choice(CLEAN) for _ in range(8)) for _ in range(random.randint(1, 9))]
        toxic = int(random.random() < 0.3)
        if toxic:
            sentences[random.randrange(len(sentences))] += " " + random.choice(BAD) + random.choice(["", "s", "ig"])
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


def test_document_labels_teach_sentences(spark):
    rows = made(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i < 400] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = {i: (t, x) for i, t, x in rows if i >= 400}
    found = [r for r in toxicity.score(docs, model).collect() if r.doc_id in held]
    assert np.mean([r.predicted == held[r.doc_id][1] for r in found]) > 0.97
    for r in found:
        text = held[r.doc_id][0]
        for span in r.offending:
            assert any(bad in text[span.start : span.end] for bad in BAD)


def test_score_is_the_noisy_or_of_sentences():
    rows = made(200)
    model = toxicity.fit_rows(texts_of(pa.array([t for _, t, _ in rows])), np.array([x for _, _, x in rows], float))
    whole = toxicity._score(model, texts_of(pa.array(["balan tor. grunk ven! mivenø\nsnarfel"])), 0.7)[0][0]
    each = toxicity._score(model, texts_of(pa.array(["balan tor", " grunk ven", " mivenø", "snarfel"])), 0.7)[0]
    assert abs(whole - (1 - np.prod(1 - each))) < 1e-9


def test_nulls_empty_tables_and_columns(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "x", 5), (2, "", 4)], "doc_id long, text string, Score int")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    found = toxicity.score(docs, model).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found) and [list(r.asDict()) for r in found][0].count("score") == 1
    none = toxicity.score(docs.limit(0), toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert none.count() == 0


def test_training_sample_is_bounded(spark):
    rows = made(50)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    toxicity.fit(docs, labels, max_rows=10, max_bytes=100)


def test_one_long_text_or_one_repeated_id_does_not_end_the_sample(spark):
    rows = made(300)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    plain = toxicity.fit(docs, labels, max_bytes=100_000)
    assert len(plain.features)
    # whichever id comes first by its hash, make its text too long, then repeat it
    first = docs.selectExpr("doc_id", "xxhash64(cast(doc_id as string)) as h").orderBy("h").first().doc_id
    for size in (30_000, 200_000):
        longer = docs.selectExpr("doc_id", f"if(doc_id = {first}, repeat('balan ', {size} div 6), text) as text")
        assert len(toxicity.fit(longer, labels, max_bytes=100_000).features) > 0
    again = docs.unionByName(docs.where(f"doc_id = {first}").crossJoin(spark.range(2000)).select("doc_id", "text"))
    repeated = toxicity.fit(again, labels, max_bytes=100_000)
    assert np.array_equal(repeated.features, plain.features) and np.allclose(repeated.weights, plain.weights)


def test_without_both_labels_every_document_gets_the_rate(spark):
    docs = spark.createDataFrame([(1, "one. two. three."), (2, ""), (3, "four")], "doc_id long, text string")
    for told, rate in (([], 0.5), ([(1, 0), (2, 0)], 0.25), ([(3, 1)], 2 / 3)):
        model = toxicity.fit(docs, spark.createDataFrame(told, "doc_id long, toxic int"))
        found = toxicity.score(docs, model).collect()
        assert all(abs(r.score - rate) < 1e-9 and r.predicted == 0 and r.offending == [] for r in found)
    assert [r.n_sentences for r in found] == [3, 0, 1]


def test_a_very_long_text(spark):
    rows = made(200)
    model = toxicity.fit_rows(texts_of(pa.array([t for _, t, _ in rows])), np.array([x for _, _, x in rows], float))
    docs = spark.createDataFrame([(1, "balan tor. " * 200_000 + "grunk"), (2, "balan tor")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert found[1].n_sentences == 200_001 and found[1].score >= found[2].score
