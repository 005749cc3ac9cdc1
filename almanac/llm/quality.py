"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements.

A policy is a versioned bit mask over the ledger, so a verdict, a new policy version or an
ablation never reads the text again. All steps are SQL expressions inside one row: no shuffle,
no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rules in bit order with the condition that fails a text. New rules go to the end, so that
#: stored ledgers stay readable.
RULES = {
    "too_short": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
BASE = ("too_short", "repeated_words")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document under it."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


POLICY = Policy(1, tuple(RULES))

# Three-word windows as hashes. One sort of pairs of full hash and position makes equal windows
# neighbours at every size. Kept starts in order add three words each, less what overlaps.
_KEYS = """if(__n < 3, cast(array() as array<bigint>), transform(sequence(0, __n - 3),
    i -> xxhash64(get(__hash, i), get(__hash, i + 1), get(__hash, i + 2))))"""
_PAIRS = "sort_array(transform(__keys, (k, i) -> named_struct('k', k, 'i', i)))"
_STARTS = """sort_array(transform(filter(__pairs, (x, i) ->
    (i > 0 and x.k = get(__pairs, i - 1).k) or
    (i < size(__pairs) - 1 and x.k = get(__pairs, i + 1).k)), x -> x.i))"""
_COVERED = """aggregate(transform(__starts, (s, i) -> if(i = 0, 3, least(3, s - get(__starts, i - 1)))), 0L, (a, b) -> a + b)"""


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measurements of every text: ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_lines`` (with a word), ``n_dup_lines`` and ``n_repeat_words``, all long.

    A null or empty text has no words and zero everywhere. Columns that have one of these
    names, or start with two underscores, are replaced; others pass through, and repeated
    rows stay repeated.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*MEASURES, "failures") and not c.startswith("__")]
    trimmed = docs.select(*kept, F.expr("coalesce(text, '') as __text")).withColumn(
        "__trimmed", F.expr(r"trim(both ' \t\n\u000B\u000C\r' from __text)")
    )
    words = trimmed.withColumn(
        "__words",
        F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", SPACE)),
    )
    hashed = words.withColumns(
        {
            "__n": F.size("__words"),
            "__hash": F.expr("transform(__words, w -> xxhash64(w))"),
            "__lines": F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    ).withColumn("__keys", F.expr(_KEYS))
    paired = hashed.withColumn(
        "__pairs",
        F.expr(f"if(size(array_distinct(__keys)) = size(__keys), cast(array() as array<struct<k: bigint, i: int>>), {_PAIRS})"),
    )
    started = paired.withColumn("__starts", F.expr(_STARTS))
    return started.select(
        *kept,
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_COVERED).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements plus ``failures``: bit ``i`` is set when rule ``i`` of ``RULES`` fails."""
    bits = [f"if({fails}, {1 << i}L, 0L)" for i, fails in enumerate(RULES.values())]
    return measure(docs).withColumn("failures", F.expr(" | ".join(bits)))


def apply_policy(entries: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy_version`` to ledger rows."""
    base = Policy(0, BASE).mask
    return entries.select(
        "*",
        (F.col("failures").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        (F.col("failures").bitwiseAND(F.lit(base | policy.mask)) == 0).alias("kept"),
        F.lit(policy.version).alias("policy_version"),
    )


def ablation(entries: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects.

    One aggregation over the ledger; its map-side half leaves one row a task.
    """
    failed = F.col("failures").bitwiseAND(F.lit(policy.mask))
    counts = entries.agg(
        *[
            column
            for i, rule in enumerate(RULES)
            if rule in policy.rules
            for column in (
                F.count_if(failed.bitwiseAND(F.lit(1 << i)) != 0).alias(f"{rule}__failed"),
                F.count_if(failed == 1 << i).alias(f"{rule}__alone"),
            )
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.col(f"{rule}__failed").alias("n_failed"), F.col(f"{rule}__alone").alias("n_alone"))
            for rule in policy.rules
        ]
    )
    return counts.select(F.inline(rows))
