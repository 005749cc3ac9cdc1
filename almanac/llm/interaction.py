"""How text filters interact: every order of them, what each step removes and for whom.

One pass marks each document with a bit for every filter that it fails. Documents are then counted
in cells of equal bits, at most ``2 ** filters`` a part, and all orders are walked over the cells by
a recursive CTE: each level extends every prefix of filters by one unused letter, joins the
cells of the part, carries the bits applied so far and emits what that step does. The walk's
size depends on the filters and parts alone, not on the documents.

Identical texts are found by their SHA-256, never by moving texts. Copies are counted per cell
before they meet, so a text that a third of all rows share costs a few rows a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .textbytes import Texts, blocks, distinct, texts_of

#: Bit ``i`` of a mask is the filter with the ``i``-th letter; the last is found across documents.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 100, 80, 10, "#$%&*|"
DUPLICATE = 1 << FILTERS.index("E")
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _per_text(texts: Texts, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each text have the flag."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[texts.offsets])


def own_failures(texts: Texts) -> np.ndarray:
    """Bits A to D of each text."""
    words, first = texts.words()
    n_words = np.diff(first)
    n_distinct = np.diff(distinct(words, first)[1])
    chars = _per_text(texts, (texts.data & 0xC0) != 0x80)
    fails = [
        n_words < MIN_WORDS,
        100 * n_distinct < MIN_DISTINCT * n_words,
        100 * _per_text(texts, _UPPER[texts.data]) > MAX_UPPER * chars,
        _per_text(texts, _SYMBOL[texts.data]) > 0,
    ]
    return sum(f.astype(np.int32) << bit for bit, f in enumerate(fails))


def _marked(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``part``, the text's ``digest`` and the bits of the filters on one text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text.alias("text"),
    )

    def run(batches):
        for batch in batches:
            mask = [own_failures(part) for _, _, part in blocks(texts_of(batch.column("text")))]
            mask = pa.array(np.concatenate([np.zeros(0, np.int32), *mask]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], mask], names=["doc_id", "part", "digest", "mask"])

    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by ``part`` (their ``lang``; null is the empty string) and ``mask``: ``n``, and how
    many are labelled good (``n_good``) and toxic (``n_toxic``).

    A null text is an empty one. Every row is a document; rows that repeat an id and a text are
    no copies of each other, and a null id is neither smaller nor larger than another. An id
    with several labels is good, or toxic, if any says so. Other columns are not read.
    """
    seen = _marked(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")}
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    alike = (
        seen.join(told, "doc_id", "left")
        .withColumns(flag)
        .groupBy("digest", "mask", "part", "good", "toxic")
        # of all rows of one id the count is known here, so the least id brings its rows along
        .agg(F.sum("n").alias("n"), F.min(own).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    )
    # at most a few rows of each text are left: one for each part and label
    lowest = F.min("least.doc_id").over(Window.partitionBy("digest"))
    first = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("lowest"), F.col("least.n")).otherwise(0)
    split = alike.withColumn("lowest", lowest).withColumn("first", first)
    either = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(DUPLICATE)).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
    )
    return (
        split.select("part", "good", "toxic", F.inline(either))
        .where("n > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
            F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
        )
    )


def _total(of: str, condition: str) -> str:
    """Sum of a measure over a part's cells that meet the condition."""
    return f"aggregate(c.cells, 0L, (s, x) -> s + if({condition}, x.{of}, 0L))"


_FAILS, _BEFORE = "x.mask & l.bit <> 0", "x.mask & w.applied <> 0"
#: What a step emits, over the cells of its part.
STEP = {
    "kept": _total("n", "x.mask & (w.applied | l.bit) = 0"),
    "removed": _total("n", f"{_FAILS} and not {_BEFORE}"),
    "redundant": _total("n", f"{_FAILS} and {_BEFORE}"),
    "unique_fails": _total("n", "x.mask = l.bit"),
    "good_lost": _total("n_good", f"{_FAILS} and not {_BEFORE}"),
    "toxic_lost": _total("n_toxic", f"{_FAILS} and not {_BEFORE}"),
}
_TYPE = "array<struct<step: int, filter: string, {}>>".format(", ".join(f"{c}: bigint" for c in STEP))


def audit(counted: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row per part, order of all filters and step, from :func:`cells`: the filter of the step and
    the measures of ``STEP``, and ``shapley``, what the filter removes summed over all orders.

    Orders grow as the factorial of the number of letters. Without documents there are no rows.
    """
    spark = counted.sparkSession
    # read once a level of the recursion
    packed = materialize(counted.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic"))).alias("cells")), "cells")
    bits = ", ".join(f"('{letter}', {1 << place})" for place, letter in enumerate(letters))
    measures = ", ".join(f"{sql} as {name}" for name, sql in STEP.items())
    walked = spark.sql(
        f"""
        with recursive letters(letter, bit) as (values {bits}),
        walk(part, filter_order, applied, steps) as (
          select part, '', 0, cast(array() as {_TYPE}) from {{packed}}
          union all
          select part, filter_order, applied, array_append(steps, named_struct('step', size(steps) + 1, 'filter', letter,
            {', '.join(f"'{c}', {c}" for c in STEP)}))
          from (select w.part, concat(w.filter_order, l.letter) as filter_order, w.applied | l.bit as applied, w.steps, l.letter, {measures}
            from walk w join letters l on w.applied & l.bit = 0 join {{packed}} c on c.part = w.part))
        select part, filter_order, inline(steps) from walk where size(steps) = {len(letters)} limit all""",
        packed=packed,
    )
    return walked.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
