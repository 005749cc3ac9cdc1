import random

from brute import personal
from pyspark.sql import functions as F

from almanac.llm import pii

random.seed(9)
BITS = ["a", "b.c", "@", "x@y.zz", "1", "12", "255", ".", "1.2.3.4", "300.1.1.1", "+1", "+49 (30) 123-4567", " ", "-", "4111111111111111", "4111 1111 1111 1111", "é", "😀", "\n", "_", "%", "(at)", "[dot]"]
TEXTS = ["".join(random.choice(BITS) for _ in range(random.randint(0, 25))) for _ in range(1500)]
TEXTS += ["", None, "1 " * 3000, "a@b.c " * 500, "9" * 20000, "a" * 20000 + "@", "000000255.1.1.01"]


def spans(rows, name):
    return [(s.start, s.k, s.end) for s in rows[name]]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id int, text string, Spans string, __m int")
    for row in pii.detect(docs, pii.Model("0D", (pii.NEVER,) * 4)).collect():
        assert spans(row, "base") == spans(row, "spans") == personal(TEXTS[row.doc_id]), TEXTS[row.doc_id]


def test_the_model_adds_disguised_spans_only(spark):
    texts = []
    for i in range(400):
        name = f"user{i}@mail{i % 7}.org"
        texts.append(random.choice([f"write to {name} now", f"value 300.{i}.1.2 here", f"net 10.0.{i % 250}.7 up", f"write to user{i} (at) mail.org now", f"ref 4111-1111-1111-{1000 + i} paid"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r for r in pii.detect(docs, pii.fit(docs)).collect()}
    for i, text in enumerate(texts):
        assert spans(found[i], "base") == personal(text)
        assert set(spans(found[i], "base")) <= set(spans(found[i], "spans"))
        if "(at)" in text:
            assert [text[a:b] for a, _, b in spans(found[i], "spans")] == [f"user{i} (at) mail.org"]
        if "300." in text:
            assert spans(found[i], "spans") == []


def test_a_rare_kind_among_many_candidates_keeps_its_spans(spark):
    texts = [f"sum {10**13 + 7919 * i} and 300.{i % 200}.1.2 done" for i in range(3000)]
    texts += [f"ref 4111-1111-1111-{1000 + i} paid" for i in range(60)]
    texts += [f"write to user{i} (at) mail{i}.org now" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = pii.fit(docs, max_candidates=400)
    assert model.thresholds[0] < pii.NEVER
    rare = pii.detect(docs.where("text like '%(at)%'"), model).collect()
    assert [len(r.spans) for r in rare] == [1] * 4


def _cover(text, found):
    """The text with every covered stretch replaced by the kind of its first span."""
    out, at = [], 0
    for start, k, end in found:
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _chosen(text, model_spans, base):
    """Candidates that no base span and no better candidate overlaps, by looking at all of them."""
    free = [c for c in model_spans if not any(b[0] < c[2] and c[0] < b[2] for b in base)]
    rank = lambda c: (c[3], c[2] - c[0], -c[0], -c[1])
    return [c[:3] for c in free if not any(o is not c and o[0] < c[2] and c[0] < o[2] and rank(o) > rank(c) for o in free)]


#: Takes every candidate; longer and rounder ones score more, so that kinds compete.
EAGER = pii.Model("(0.5D + (length(c.v) % 7) / 20D)", (0.5,) * 4)


def test_added_spans_and_redaction_match_plain_ones(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t and len(t) < 3500], "doc_id int, text string")
    wide = pii._candidates(pii._texts(docs)).select("doc_id", *[f"__w_{k}" for k in pii.KINDS])
    candidates = {
        r.doc_id: [(c.start, n, c.end, 0.5 + (len(c.v) % 7) / 20) for n, k in enumerate(pii.KINDS) for c in r[f"__w_{k}"]] for r in wide.collect()
    }
    found = pii.detect(docs, EAGER)
    added = 0
    for row in found.collect():
        base = personal(row.text)
        assert spans(row, "base") == base
        assert spans(row, "spans") == sorted(base + _chosen(row.text, candidates[row.doc_id], base)), row.text
        added += len(row.spans) - len(base)
    assert added > 300
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    for row in found.collect():
        assert clean[row.doc_id] == _cover(row.text, spans(row, "spans"))


def test_context_of_a_candidate_ends_at_its_neighbours(spark):
    text = "Call the office on 4111 1111 1111 1111x and 10.0.0.1 then 10.0.0.2"
    row = pii._candidates(pii._texts(spark.createDataFrame([(text,)], "text string"))).first()
    (card,) = row["__w_card"][:1]
    assert (text[card.start : card.end], card.before, card.after) == (card.v, "l the office on ", "x and 10")
    first, second = row["__w_ip"]
    assert (first.after, second.before) == (" then ", " then ")


def test_many_candidates_in_one_text(spark):
    import time

    part = "10.0.0.1, 4111111111111111, 300.1.1.1, u (at) m.org, a@b.cc, 4111-1111-1111-1112, "
    text = part * 4_000
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    found = pii.detect(docs, EAGER)
    row = pii.redact(found.withColumn("n", F.size("spans"))).first()
    assert time.time() - began < 90
    assert row.n == 24_000 and row.text.startswith("[IP], [CARD], [IP], [EMAIL], [EMAIL], [CARD], [IP]") and "1111" not in row.text
    few = docs.selectExpr("doc_id", f"substring(text, 1, {len(part) * 50}) as text")
    assert row.text[:1500] == pii.redact(pii.detect(few, EAGER)).first().text[:1500]


def test_redaction_and_listing(spark):
    text = "é a@b.cc, 10.0.0.1 and +1 (017) 555-7713."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean"), (1, text)], "doc_id int, text string")
    found = pii.detect(docs, pii.fit(docs.where("doc_id = 3")))
    row = found.where("doc_id = 1").select(pii.listed("spans").alias("s"), *[pii.count_of(k).alias(k) for k in pii.KINDS]).first()
    assert tuple(row) == ("email:2:8,ip:10:18,phone:23:40", 1, 1, 0, 1)
    clean = sorted((r.doc_id, r.text or "") for r in pii.redact(found).collect())
    assert clean == [(1, "é [EMAIL], [IP] and [PHONE]."), (1, "é [EMAIL], [IP] and [PHONE]."), (2, ""), (3, "clean")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(docs, pii.fit(docs)).count() == 0


def test_a_filter_on_what_was_found_does_not_copy_the_search(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd or 10.0.0.1"), (2, "nothing")], "doc_id int, text string")
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    for model in (pii.Model("0D", (pii.NEVER,) * 4), EAGER):
        found = pii.detect(docs, model)
        some = found.where("size(base) > 0")
        assert size(some) < 2 * size(found)
        assert [r.doc_id for r in some.collect()] == [1]
    clean = pii.redact(found)
    some = clean.where("text is not null")
    assert size(some) < 3 * size(clean) and some.count() == 2
