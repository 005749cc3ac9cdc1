"""Registries, usage counts and shares.

Names are counted per (subject, name) before any join or ranking, and totals come from
a second aggregation of those counts rather than from a window over one subject's labels.
No join is forced to broadcast: registries grow with the subjects, so adaptive execution
decides from the measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import is_json, med_names, months_back, parse_meds, round_half_up, split_list, strip
from .clean import filter_painful
from .skew import own_shuffle
from .stats import NO_MEDICATION

UNCATEGORIZED = "Uncategorized"
SPAN_MONTHS = {"1m": 1, "1y": 12}
#: Letters in the runs by which names are found inside texts.
GRAM = 3


def since(log: DataFrame, as_of, span: str) -> DataFrame:
    if span == "all":
        return log
    return log.where(F.col("date") >= months_back(F.lit(as_of).cast("date"), SPAN_MONTHS[span]))


def _count(names: DataFrame, key: str = "name") -> DataFrame:
    return names.groupBy("subject_id", key).agg(F.count(F.lit(1)).alias("uses"))


def trigger_counts(log: DataFrame) -> DataFrame:
    """Uses per subject and trigger name; repeats within one row count."""
    return _count(log.select("subject_id", F.explode(split_list(F.col("triggers"))).alias("name")))


def recorded_meds(log: DataFrame) -> Column:
    """Names from a valid JSON list, else from comma text in the same column.

    Other valid JSON holds no names. Lists are tried first, so they are parsed once.
    """
    text = F.col("medications")
    listed = F.transform(parse_meds(text), lambda m: m["name"])
    typed = F.when(~F.coalesce(is_json(text), F.lit(False)), split_list(text)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.coalesce(listed, typed), lambda n: n != "")


def medication_use_counts(log: DataFrame) -> DataFrame:
    """Uses over painful rows; a row without names counts once as none."""
    names = recorded_meds(log)
    none = F.array(F.lit(NO_MEDICATION))
    return _count(filter_painful(log).select("subject_id", F.explode(F.when(F.size(names) > 0, names).otherwise(none)).alias("name")))


def all_med_names(log: DataFrame) -> DataFrame:
    """G2 source: names from the legacy text and the JSON list, one row each."""
    both = F.concat(split_list(F.col("medication")), med_names(F.col("medications")))
    return log.select("subject_id", F.explode(both).alias("name"))


def distinct_names(log: DataFrame) -> DataFrame:
    """Set union of the names in both columns."""
    return all_med_names(log).distinct()


def with_share(counts: DataFrame, shown: DataFrame | None = None, key: str = "name") -> DataFrame:
    """Percent share of each label within its subject, and the chart label.

    Totals cover all of ``counts``; ``shown`` limits the rows that are labelled.
    """
    totals = own_shuffle(counts.groupBy("subject_id").agg(F.sum("uses").alias("total")), "subject_id")
    share = round_half_up(F.col("uses") / F.col("total") * 100, 0).cast("int")
    return (counts if shown is None else shown).join(totals, "subject_id").withColumns(
        {"share_pct": share, "label": F.concat(F.col(key), F.lit(" ("), share.cast("string"), F.lit("%)"))}
    )


def usage_topk(counts: DataFrame, k: int = 10, key: str = "name") -> DataFrame:
    """the k most used labels per subject, ties in label order."""
    order = Window.partitionBy("subject_id").orderBy(F.col("uses").desc(), F.col(key).asc())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def registry_by_lower_name(registry: DataFrame) -> DataFrame:
    """One category per case-folded name: that of the lowest id."""
    return registry.groupBy("subject_id", F.lower("name").alias("folded")).agg(
        F.min_by(F.struct("category"), "trigger_id").alias("first")
    ).select("subject_id", "folded", F.col("first.category").alias("category"))


def registry_lookup_ci(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the category of each name, ignoring case."""
    return (
        names.withColumn("folded", F.lower("name"))
        .join(registry_by_lower_name(registry), ["subject_id", "folded"], "left")
        .withColumn("category", F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(UNCATEGORIZED)))
        .drop("folded")
    )


def trigger_usage(log: DataFrame, registry: DataFrame, as_of, span: str = "1y", by_category: bool = False, k: int = 10) -> DataFrame:
    """Top labels (or categories) with their share of all uses.

    Labels are ranked before the totals are joined, so each task has cut a subject's
    labels to ``k`` before they meet.
    """
    counts = trigger_counts(since(log, as_of, span))
    if by_category:
        counts = (
            registry_lookup_ci(counts, registry)
            .groupBy("subject_id", F.col("category").alias("name"))
            .agg(F.sum("uses").alias("uses"))
        )
    return with_share(counts, usage_topk(counts, k))


def medication_usage(log: DataFrame, as_of, span: str = "1y") -> DataFrame:
    """D13."""
    return with_share(medication_use_counts(since(log, as_of, span)))


def _recount(registry: DataFrame, counts: DataFrame, only_unused: bool = False) -> DataFrame:
    """Counters replaced by the counts; ``only_unused`` limits that to subjects whose
    counters add up to zero."""
    joined = registry.join(counts, ["subject_id", "name"], "left")
    counted = F.coalesce("uses", "usage_count", F.lit(0).cast("bigint"))
    if only_unused:
        totals = registry.groupBy("subject_id").agg(F.sum(F.coalesce("usage_count", F.lit(0))).alias("total"))
        joined = joined.join(own_shuffle(totals, "subject_id"), "subject_id")
        counted = F.when(F.col("total") == 0, counted).otherwise(F.col("usage_count"))
    return joined.withColumn("usage_count", counted).select(*registry.columns)


def usage_recount_triggers(log: DataFrame, registry: DataFrame, only_unused: bool = False) -> DataFrame:
    """Usage counters rebuilt from the log; names never used keep their counter."""
    return _recount(registry, trigger_counts(log), only_unused)


def usage_recount_meds(log: DataFrame, registry: DataFrame, only_unused: bool = False) -> DataFrame:
    """Both the legacy text and the JSON list add up."""
    return _recount(registry, _count(all_med_names(log)), only_unused)


def legacy_med_counts(log: DataFrame) -> DataFrame:
    """All rows with non-blank text, text as typed."""
    return _count(log.where(strip(F.col("medication")) != "").select("subject_id", F.col("medication").alias("name")))


def category_group(registry: DataFrame, form: str = "page") -> DataFrame:
    """Registry rows in display order.

    The list page shows ``Uncategorized`` first, the entry form shows ``Other`` last.
    Rows carry their sort key instead of being gathered per category, so a category
    of any size stays spread out.
    """
    default, first = {"page": (UNCATEGORIZED, True), "form": ("Other", False)}[form]
    category = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(default))
    edge = category == default
    order = F.when(edge, 0).otherwise(1) if first else F.when(edge, 1).otherwise(0)
    return registry.select("subject_id", category.alias("category"), order.alias("category_order"), "name", "trigger_id").orderBy(
        "subject_id", "category_order", "category", "name", "trigger_id"
    )


def display_name_join(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Show the display name, or the generic one when there is none."""
    shown = registry.select("subject_id", "name", F.when(F.col("display_name") != "", F.col("display_name")).alias("shown"))
    return names.join(shown, ["subject_id", "name"], "left").withColumn("shown", F.coalesce("shown", "name"))


def _grams(chars: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a split text, in time linear in its length."""
    runs = chars
    for k in range(1, size):
        rest = F.slice(chars, k + 1, F.size(chars))
        runs = F.zip_with(runs, rest, lambda run, letter: F.concat(run, letter))
    return F.array_distinct(F.array_compact(runs))


def rarest_gram(registry: DataFrame) -> DataFrame:
    """Each registry name with the one of its runs of ``GRAM`` letters that fewest names of the subject have.

    A shorter name is its own run, so it meets texts by runs of its own length.
    """
    names = registry.where(F.col("name") != "").select("subject_id", "name").distinct()
    chars = F.split("name", "")
    runs = F.when(F.size(chars) < GRAM, F.array("name")).otherwise(_grams(chars, GRAM))
    each = names.select("subject_id", "name", F.explode(runs).alias("gram"))
    spread = each.groupBy("subject_id", "gram").agg(F.count(F.lit(1)).alias("names"))
    filed = each.join(spread, ["subject_id", "gram"]).groupBy("subject_id", "name")
    return filed.agg(F.min_by("gram", F.struct("names", "gram")).alias("gram"))


def _substring_hits(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Legacy text that contains a registry name anywhere, through an index by rare letter runs.

    A text asks with its distinct runs of one to ``GRAM`` letters, so it is at most ``GRAM`` rows a
    letter, whatever the names; only names filed under one of them are looked for in it.
    Texts stay behind while their runs meet the index, and come back to their candidates.
    """
    texts = (
        log.where(F.col("medication") != "")
        .groupBy("subject_id", F.col("medication").alias("text"))
        .agg(F.max("date").alias("last_use"))
        .withColumn("text_id", F.xxhash64("text"))
    )
    chars = F.split("text", "")
    runs = F.flatten(F.array(*[_grams(chars, size) for size in range(1, GRAM + 1)]))
    asked = texts.select("subject_id", "text_id", F.explode(runs).alias("gram"))
    candidates = asked.join(rarest_gram(registry), ["subject_id", "gram"]).select("subject_id", "text_id", "name")
    return (
        candidates.join(texts, ["subject_id", "text_id"])
        .where(F.contains("text", "name"))
        .groupBy("subject_id", "name")
        .agg(F.max("last_use").alias("last_use"))
    )


def last_use_join(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Last day each registry medication was used.

    A use is an exact name in the JSON list, or the name anywhere in the legacy text.
    Never-used medications are absent.
    """
    listed = (
        log.select("subject_id", "date", F.explode(F.array_distinct(med_names(F.col("medications")))).alias("name"))
        .groupBy("subject_id", "name")
        .agg(F.max("date").alias("last_use"))
    )
    uses = listed.unionByName(_substring_hits(log, registry)).groupBy("subject_id", "name").agg(F.max("last_use").alias("last_use"))
    return registry.join(uses, ["subject_id", "name"])


def med_due(log: DataFrame, registry: DataFrame, as_of, window_days: int = 7) -> DataFrame:
    """Periodic medications due within the window, overdue ones included."""
    day = F.lit(as_of).cast("date")
    periodic = registry.where((F.col("frequency") == "periodic") & (F.coalesce("period_days", F.lit(0)) != 0))
    return (
        last_use_join(log, periodic)
        .withColumn("next_due", F.date_add("last_use", F.col("period_days")))
        .where(F.col("next_due") <= F.date_add(day, window_days))
        .withColumn("due_days", F.datediff("next_due", day))
    )


def registry_anti_ci(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Names in the log that the registry lacks, ignoring case; one spelling each."""
    found = distinct_names(log).withColumn("folded", F.lower("name"))
    known = registry.select("subject_id", F.lower("name").alias("folded")).distinct()
    return (
        found.join(known, ["subject_id", "folded"], "left_anti")
        .withColumn("name", strip(F.col("name")))
        .where(F.col("name") != "")
        .groupBy("subject_id", F.lower("name").alias("folded"))
        .agg(F.min("name").alias("name"))
        .drop("folded")
    )


def registry_sort(registry: DataFrame) -> DataFrame:
    """most used first, then by name."""
    return registry.orderBy("subject_id", F.col("usage_count").desc(), F.col("name").asc())
