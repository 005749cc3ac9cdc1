import itertools
import random

import pytest
from brute import words
from pyspark.sql import functions as F

from almanac.llm import interaction

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    told = {}
    for i, q, x in labels:
        if i is not None:
            good, toxic = told.get(i, (False, False))
            told[i] = (good or q == 1, toxic or x == 1)
    lowest = {}
    for i, text, _ in docs:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text, w = text or "", words(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > lowest[text],
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, *told.get(i, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                failing = [r for r in own if letter in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == {letter} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
                removed_by[letter] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def found(spark, docs, labels, extra=()):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name in extra:
        frame, told = frame.withColumn(name, F.lit(0)), told.withColumn(name, F.lit("x"))
    rows = interaction.audit(interaction.cells(frame, told)).collect()
    assert all(r["filter"] == r.filter_order[r.step - 1] for r in rows)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in rows}
    assert len(got) == len(rows)
    return got


def test_every_order_matches_a_plain_version(spark):
    random.seed(11)
    some = [" ".join(random.choice(["a", "bb", "C", "DD", "e#", "Éa"]) for _ in range(random.choice([0, 3, 99, 100, 130]))) for _ in range(40)]
    some += [" ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}" for i in range(100)), "A" * 10 + "b" * 90, "A" * 11 + "b" * 89]
    some += ["", None, "  \n", "x" * 400_000, "y " * 150_000, " ".join(f"q{i % 80}" for i in range(100))]
    docs = [(i, random.choice(some), random.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(7, docs[7][1], "en"), (7, "other", "en"), (None, some[0], "en"), (None, some[0], "de"), (500, some[0], "fr")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    assert found(spark, docs, labels) == plain(docs, labels)


def test_one_text_in_a_third_of_all_rows(spark):
    docs = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(3000)]
    assert found(spark, docs, []) == plain(docs, [])


@pytest.mark.parametrize("docs", [[], [(3, None, None)]])
def test_empty_tables_and_clashing_names(spark, docs):
    got = found(spark, docs, [], extra=("mask", "part", "n", "digest", "good", "least"))
    assert got == plain(docs, []) and len(got) == 600 * len(docs)


def test_more_parts_than_one_recursion_may_return_by_default(spark):
    docs = [(i, "A" if i % 2 else "b", f"lang{i}") for i in range(3200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = interaction.audit(interaction.cells(frame, labels))
    assert out.agg(F.count(F.lit(1)), F.sum("removed")).first()[:] == (3200 * 600, 3200 * 120)  # every text is short and goes once an order
