import random

import pytest
from brute import quality as plain
from pyspark.sql import functions as F

from almanac.llm import quality

random.seed(5)
TEXTS = [" ".join(random.choice(["a", "b", "c#", "\n", "dd|", "\n\t"]) for _ in range(random.randint(0, 60))) for _ in range(150)]
TEXTS += [None, "", "   ", "x", "\n\n", "a b a b", "a a a a", "w " * 70_000, "line one\nline one\n line one"]
TEXTS += ["fluffy fox and a leaf", "f f f f", "\x0cabc def\x0c", "\x0b\x0cff\x0c f", "\x0c", "f", "\r\nfff \x0c\t"]


def test_measures_match_a_plain_version(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in quality.measure(docs).collect():
        assert tuple(row[m] for m in quality.MEASURES) == plain(TEXTS[row.doc_id]), row.doc_id


def test_windows_that_agree_in_leading_hash_bits_do_not_hide_repeats(spark):
    # Two windows "first x y" whose hashes share their upper 33 bits, in turn and far apart in a long text.
    keys = spark.range(400_000).selectExpr("concat('w', id) as w").selectExpr("w", "xxhash64(xxhash64(w), xxhash64('x'), xxhash64('y')) as k")
    pairs = keys.selectExpr("w", "k & shiftleft(-1L, 31) as bits").groupBy("bits").agg(F.sort_array(F.collect_list("w")).alias("w")).where("size(w) = 2")
    a, b = pairs.orderBy("bits").first()["w"]
    text = " ".join(f"{first} x y " + " ".join(f"f{n}_{i}" for i in range(17_000)) for n, first in enumerate((a, b, a, b)))
    found = quality.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert found["n_repeat_words"] == 12
    assert tuple(found[m] for m in quality.MEASURES) == plain(text)


def test_verdicts_follow_bits_and_policy(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, "short"), (3, None), (4, "spam eggs ham " * 40), (5, " ".join(f"w{i}$$$" for i in range(80))), (1, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    entries = quality.ledger(docs)
    judged = sorted((r.doc_id, r.failures, r.base_failed, r.kept) for r in quality.apply_policy(entries).collect())
    assert judged == [(1, 0, False, True), (1, 0, False, True), (2, 1, True, False), (3, 1, True, False), (4, 2, True, False), (5, 4, False, False)]
    lenient = quality.apply_policy(entries, quality.Policy(2, quality.BASE))
    assert {r.doc_id: r.kept for r in lenient.collect()}[5]
    alone = {r.rule: (r.n_failed, r.n_alone) for r in quality.ablation(entries).collect()}
    assert alone["too_short"] == (2, 2) and alone["symbols"] == (1, 1) and alone["word_length"] == (0, 0)


@pytest.mark.parametrize("rows", [[], [(1, "a b c", "x", 7)]])
def test_empty_tables_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, __words string, N_WORDS int")
    found = quality.apply_policy(quality.ledger(docs))
    assert found.columns.count("n_words") == 1 and "__words" not in found.columns
    assert found.count() == len(rows)
