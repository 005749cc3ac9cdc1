"""Table changes as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import rename_in_list, split_list, strip, to_meds_json
from .clean import sanitize_entries, split_valid
from .skew import own_shuffle
from .usage import registry_anti_ci

LOG_KEY = ["subject_id", "date", "time"]
ROW_KEY = ["subject_id", "entry_id"]
#: Buckets in which new rows are numbered, each by one task at a time.
ID_BUCKETS = 1 << 16


def _spread_time(df: DataFrame) -> Column:
    """The time part of the key; rows with an incomplete key get a value of their own.

    They match nothing either way, but a shared null would send them all to one task.
    """
    whole = F.xxhash64(*[F.col(c) for c in df.columns]).cast("string")
    incomplete = F.col("date").isNull() | F.col("time").isNull()
    return F.when(incomplete, F.concat(F.lit("~"), whole)).otherwise(F.col("time"))


def _stored_keys(stored: DataFrame) -> DataFrame:
    keys = stored.select("subject_id", "date", F.col("time").alias("key_time"))
    return own_shuffle(keys.dropna().distinct(), "subject_id")


def anti_join_dedup(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose (subject, date, time) is not stored yet.

    Rows with a null key part are always new, and repeats inside ``incoming`` stay.
    Stored keys are distinct before the join, so a frequent key is one row there, and
    adaptive execution can split the incoming rows of a hot key.
    """
    return (
        incoming.withColumn("key_time", _spread_time(incoming))
        .join(_stored_keys(stored), ["subject_id", "date", "key_time"], "left_anti")
        .select(*incoming.columns)
    )


def flag_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """C2 keeping all rows: ``is_stored`` says whether the key exists already."""
    return (
        incoming.withColumn("key_time", _spread_time(incoming))
        .join(_stored_keys(stored).withColumn("is_stored", F.lit(True)), ["subject_id", "date", "key_time"], "left")
        .withColumn("is_stored", F.coalesce("is_stored", F.lit(False)))
        .select(*incoming.columns, "is_stored")
    )


def import_summary(flagged: DataFrame, stored: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Rows imported, skipped as duplicates, rejected, and stored afterwards, per subject."""
    moved = flagged.select("subject_id", F.col("is_stored").alias("skipped"), (~F.col("is_stored")).alias("imported"), F.lit(False).alias("rejected"))
    if rejected is not None:
        no, yes = F.lit(False), F.lit(True)
        moved = moved.unionByName(rejected.select("subject_id", no.alias("skipped"), no.alias("imported"), yes.alias("rejected")))
    counted = moved.groupBy("subject_id").agg(*[F.count_if(c).alias(f"{c}_rows") for c in ("imported", "skipped", "rejected")])
    held = stored.groupBy("subject_id").agg(F.count(F.lit(1)).alias("held"))
    zero = F.lit(0).cast("bigint")
    return counted.join(held, "subject_id", "full").select(
        "subject_id",
        *[F.coalesce(f"{c}_rows", zero).alias(f"{c}_rows") for c in ("imported", "skipped", "rejected")],
        (F.coalesce("held", zero) + F.coalesce("imported_rows", zero)).alias("total_rows"),
    )


def insert_entries(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L1: cleaned rows ready to append, and the rejected rows with reasons."""
    good, rejected = split_valid(sanitize_entries(incoming))
    legacy = {c: F.coalesce(F.col(c), F.lit("")) if c in good.columns else F.lit("") for c in ("medication", "dosage")}
    return good.withColumns(legacy), rejected


def encode_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L1: rows with their medication list as JSON text (H3), and the names whose use they count.

    Returns (rows, medication names, trigger names), one name a use. Only a list given as such
    counts medications; text in that column stays as it is and counts none.
    """
    absent = [c for c in ("medications", "triggers") if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else rows
    listed = isinstance(rows.schema["medications"].dataType, T.ArrayType)
    given = F.col("medications") if listed else F.array().cast("array<struct<name: string, dosage: string>>")
    names = F.filter(F.transform(given, lambda m: m["name"]), lambda n: n != "")
    meds = rows.select("subject_id", F.explode(names).alias("name"))
    triggers = rows.select("subject_id", F.explode(split_list(F.col("triggers"))).alias("name"))
    encoded = rows.withColumn("medications", to_meds_json(F.col("medications"))) if listed else rows
    return encoded, meds, triggers


def assign_entry_ids(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh ids above every stored one, which depend on the rows' values alone.

    Distinct rows are dealt to buckets by a hash and numbered inside each; a row's number times
    the number of buckets, plus its bucket, is its id. So no task orders all rows, equal rows are
    counted before they are shuffled, and a second read, another partitioning or a repeated task
    gives every row the same id. Ids have gaps. Columns must be of types that can be grouped.
    """
    last = stored.select(F.coalesce(F.max("entry_id"), F.lit(0))).scalar()
    given = [c for c in rows.columns if c != "entry_id"]
    counted = rows.groupBy(*given).agg(F.count(F.lit(1)).alias("__copies"))
    dealt = counted.withColumn("__bucket", F.pmod(F.xxhash64(*given), F.lit(ID_BUCKETS)))
    earlier = Window.partitionBy("__bucket").orderBy(*given).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("__before", F.coalesce(F.sum("__copies").over(earlier), F.lit(0)))
    each = numbered.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__copies") - 1)))
    number = (F.col("__before") + F.col("__copy")) * ID_BUCKETS + F.col("__bucket")
    return each.withColumn("entry_id", number + last + 1).select(*given, "entry_id")


def update_entries(log: DataFrame, changes: DataFrame, version: str | None = None, cleared: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L2: apply a change set by (subject, entry); returns the log and unmatched changes.

    Only the columns present in ``changes`` are touched; a null there means unchanged, unless
    the array column named by ``cleared`` lists that field, which then becomes null. Of several
    changes to one row the one with the greatest ``version`` counts; without a version column,
    or among equal ones, the greatest by its values, so the choice never depends on row order.
    """
    control = {c for c in (version, cleared) if c}
    supplied = [c for c in changes.columns if c in log.columns and c not in ROW_KEY and c not in control]
    values = F.struct(*[F.col(c) for c in supplied], *([F.col(cleared)] if cleared else []))
    order = F.struct(F.col(version), values) if version else values
    one = changes.groupBy(*ROW_KEY).agg(F.max_by(values, order).alias("change"))

    def changed(c: str) -> Column:
        kept = F.coalesce(F.col(f"change.{c}").cast(log.schema[c].dataType), F.col(c))
        if cleared:
            kept = F.when(F.coalesce(F.array_contains(F.col(f"change.{cleared}"), c), F.lit(False)), None).otherwise(kept)
        return kept.alias(c)

    updated = log.join(one, ROW_KEY, "left").select(*[changed(c) if c in supplied else F.col(c) for c in log.columns])
    return updated, changes.join(log.select(*ROW_KEY), ROW_KEY, "left_anti")


def delete_entries(log: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L3: the log without the given rows, and the keys that were not found."""
    wanted = keys.select(*ROW_KEY).distinct()
    return log.join(wanted, ROW_KEY, "left_anti"), wanted.join(log.select(*ROW_KEY), ROW_KEY, "left_anti")


def upsert_registry(registry: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """L4: apply ``op`` in {add, update, delete} by id; returns (registry, rejected).

    ``changes`` carries the registry columns plus ``op`` and at most one row per id.
    Rejected: empty names, names taken by another row, and ids that are not there.
    """
    columns = registry.columns
    ids = ["subject_id", key]
    cleaned = changes.withColumn("name", strip(F.col("name")))
    marked = registry.select(*ids, F.lit(True).alias("present"))
    staged = cleaned.join(marked, ids, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    # Names held by rows that this batch neither renames nor removes.
    kept = registry.join(changes.where(F.col("op") != "add").select(*ids), ids, "left_anti")
    taken = kept.select("subject_id", "name").distinct().withColumn("taken", F.lit(True))
    # Among the batch's own claims to one name the lowest id wins.
    first = (
        staged.where(F.col("op") != "delete").groupBy("subject_id", "name").agg(F.min(key).alias("first_id"))
    )
    judged = (
        staged.join(taken, ["subject_id", "name"], "left")
        .join(first, ["subject_id", "name"], "left")
        .withColumn(
            "reason",
            F.when((F.col("op") != "add") & ~F.col("present"), "not found")
            .when(F.col("op") == "delete", None)
            .when(F.coalesce(F.col("name"), F.lit("")) == "", "empty name")
            .when((F.col("op") == "add") & F.col("present"), "id exists")
            .when(F.coalesce("taken", F.lit(False)) | (F.col(key) != F.col("first_id")), "name exists"),
        )
    )
    accepted = judged.where(F.col("reason").isNull())
    touched = accepted.where(F.col("op") != "add").select(*ids)
    added = accepted.where(F.col("op") != "delete").select(*columns)
    result = registry.join(touched, ids, "left_anti").unionByName(added)
    return result, judged.where(F.col("reason").isNotNull()).select(*ids, "op", "name", "reason")


def rename_cascade(log: DataFrame, renames: DataFrame) -> DataFrame:
    """Rewrite the trigger text of every log row that holds a renamed item.

    ``renames`` is ``subject_id, old_name, new_name``. Several renames on one row apply
    together; of several new names for one item the alphabetically first one counts, and
    a null new name is none. Each distinct text of a subject is rebuilt once, with one pair
    per item it holds, and meets its rows again by the text itself, so neither row ids nor
    the size of the batch matter and a frequent text stays splittable.
    """
    chosen = renames.groupBy("subject_id", "old_name").agg(F.min(strip(F.col("new_name"))).alias("new_name"))
    texts = log.select("subject_id", "triggers").where("triggers is not null").distinct()
    parts = F.transform(F.split("triggers", ","), strip)
    rebuilt = (
        texts.withColumn("old_name", F.explode(F.array_distinct(parts)))
        .join(chosen.where("new_name is not null"), ["subject_id", "old_name"])
        .groupBy("subject_id", "triggers")
        .agg(F.map_from_entries(F.collect_list(F.struct("old_name", "new_name"))).alias("renamed"))
        .withColumn(
            "renamed_text", F.array_join(F.transform(parts, lambda t: F.coalesce(F.try_element_at(F.col("renamed"), t), t)), ", ")
        )
        .drop("renamed")
    )
    met = log.join(own_shuffle(rebuilt, "subject_id"), ["subject_id", "triggers"], "left")
    return met.withColumn("triggers", F.coalesce("renamed_text", "triggers")).select(*log.columns)


def rename_one(log: DataFrame, subject_id: int, old: str, new: str) -> DataFrame:
    """L5 for a single trigger of one subject: a plain projection."""
    text = F.when(F.col("subject_id") == subject_id, rename_in_list(F.col("triggers"), F.lit(old), F.lit(new)))
    return log.withColumn("triggers", text.otherwise(F.col("triggers")))


def increment_usage(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Add one per occurrence of an exact stripped name; unknown names are ignored."""
    counts = (
        names.select("subject_id", strip(F.col("name")).alias("name"))
        .groupBy("subject_id", "name")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    return (
        registry.join(counts, ["subject_id", "name"], "left")
        .withColumn("usage_count", F.col("usage_count") + F.coalesce("uses", F.lit(0).cast("bigint")))
        .select(*registry.columns)
    )


def import_registry(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows for names known only from the log."""
    return registry_anti_ci(log, registry).select(
        "subject_id", "name", F.lit("as_needed").alias("frequency"), F.lit(0).cast("bigint").alias("usage_count")
    )


def upsert_settings(changes: DataFrame, version: str = "version") -> DataFrame:
    """The latest value per (subject, key)."""
    return changes.groupBy("subject_id", "key").agg(F.max_by("value", version).alias("value"))
