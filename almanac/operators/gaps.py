"""Streaks, gaps and back-filled healthy days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .skew import own_shuffle

MAX_MISSING = 5


def logged_days(log: DataFrame) -> DataFrame:
    return log.select("subject_id", "date").where(F.col("date").isNotNull()).distinct()


def logging_streak(log: DataFrame, as_of) -> DataFrame:
    """Length of the run of logged days that ends at ``as_of`` or the day before."""
    day = F.lit(as_of).cast("date")
    w = Window.partitionBy("subject_id").orderBy("date")
    islands = (
        logged_days(log)
        .withColumn("island", F.date_sub("date", F.row_number().over(w)))
        .groupBy("subject_id", "island")
        .agg(
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
        )
    )
    # Entries dated after as_of may extend the island; only the part up to it counts.
    alive = (F.col("first_day") <= day) & (F.col("last_day") >= F.date_sub(day, 1))
    length = F.datediff(F.least(F.col("last_day"), day), F.col("first_day")) + 1
    return islands.groupBy("subject_id").agg(F.coalesce(F.max(F.when(alive, length)), F.lit(0)).alias("streak_days"))


def missing_days(log: DataFrame, as_of, limit: int = MAX_MISSING) -> DataFrame:
    """Days after the last entry through yesterday, at most the ``limit`` latest."""
    day = F.lit(as_of).cast("date")
    start = F.greatest(F.date_add("last_day", 1), F.date_sub(day, limit))
    end = F.date_sub(day, 1)
    return (
        log.groupBy("subject_id")
        .agg(F.max("date").alias("last_day"))
        .where(start <= end)
        .select("subject_id", F.explode(F.sequence(start, end)).alias("date"))
    )


def healthy_day_backfill(log: DataFrame, medications: DataFrame, as_of) -> DataFrame:
    """Pain-free entries at noon for the missing days, one row per daily medication.

    A subject without daily medications gets one row per day with a null name.
    """
    daily = medications.where(F.col("frequency") == "daily").select(
        "subject_id", F.col("name").alias("med_name"), F.col("default_dosage").alias("med_dosage")
    )
    return own_shuffle(missing_days(log, as_of), "subject_id").join(daily, "subject_id", "left").select(
        "subject_id",
        "date",
        F.lit("12:00").alias("time"),
        F.lit(0).alias("pain"),
        F.lit("3").alias("sleep"),
        F.lit("2").alias("activity"),
        F.lit("Retroactive Bulk Log").alias("notes"),
        "med_name",
        "med_dosage",
    )


def pack_entries(lines: DataFrame) -> DataFrame:
    """Back-filled lines as log rows: the medications of one entry become its JSON cell.

    A group here is a single entry, so its size is that of one stored list.
    """
    item = F.struct(F.col("med_name").alias("name"), F.coalesce("med_dosage", F.lit("")).alias("dosage"))
    keys = ["subject_id", "date", "time", "pain", "sleep", "activity", "notes"]
    return lines.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("med_name").isNotNull(), item)))).alias("medications")
    )
