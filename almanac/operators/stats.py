"""Descriptive statistics over episode days.

``day_profile`` reduces the log once to (subject, day); the summary tables read that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import blank_to_null, date_label, month_start, months_back, numeric_coerce, round_half_up, strip
from .clean import filter_painful
from .daily import max_row_per_day

NO_MEDICATION = "No Medication"
CLIENT_RANGES = {"1m": 1, "1y": 12, "2y": 24, "3y": 36}


def _day(as_of) -> Column:
    return F.lit(as_of).cast("date")


def day_profile(log: DataFrame) -> DataFrame:
    """Per subject and day: row count, painful-row totals and the episode's pain.

    The episode's pain is that of the day's latest painful row (E2).
    """
    pain = numeric_coerce(F.col("pain"))
    hurt = pain > 0
    latest = F.max_by(F.when(hurt, pain), F.when(hurt, F.struct(F.col("time"), -F.col("entry_id"))))
    return (
        log.where(F.col("date").isNotNull())
        .groupBy("subject_id", "date")
        .agg(F.count(F.lit(1)).alias("n_rows"), latest.alias("episode_pain"))
    )


def episode_days(log: DataFrame) -> DataFrame:
    """Distinct painful (subject, day) pairs."""
    return filter_painful(log).select("subject_id", "date").where(F.col("date").isNotNull()).distinct()


def yearly_counts(days: DataFrame) -> DataFrame:
    """D2."""
    return days.groupBy("subject_id", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("episode_days"))


def _by_month(days: DataFrame, style: str) -> DataFrame:
    return (
        days.groupBy("subject_id", month_start(F.col("date")).alias("month_start"))
        .agg(F.count(F.lit(1)).alias("episode_days"))
        .withColumn("label", date_label(F.col("month_start"), style))
    )


def monthly_counts_year(days: DataFrame, as_of) -> DataFrame:
    """D3: months of the as-of year; empty months are absent."""
    in_year = (F.col("date") >= F.trunc(_day(as_of), "year")) & (F.year("date") == F.year(_day(as_of)))
    return _by_month(days.where(in_year), "month")


def past_12m_counts(profile: DataFrame) -> DataFrame:
    """From twelve months before the subject's last logged day, painful or not."""
    last = F.max("date").over(Window.partitionBy("subject_id"))
    days = (
        profile.withColumn("last_date", last)
        .where(F.col("episode_pain").isNotNull() & (F.col("date") >= F.add_months("last_date", -12)))
    )
    return _by_month(days, "month_year")


def medication_counts(log: DataFrame) -> DataFrame:
    """Painful rows per legacy medication text; blank and null mean none was taken."""
    name = F.coalesce(blank_to_null(strip(F.col("medication"))), F.lit(NO_MEDICATION))
    return filter_painful(log).groupBy("subject_id", name.alias("medication")).agg(F.count(F.lit(1)).alias("uses"))


def pain_stats_daily(profile: DataFrame) -> DataFrame:
    """Mean and worst pain over episode days; 0 for a subject without any."""
    return profile.groupBy("subject_id").agg(
        F.coalesce(round_half_up(F.avg("episode_pain"), 1), F.lit(0.0)).alias("avg_pain"),
        F.coalesce(F.max("episode_pain").cast("int"), F.lit(0)).alias("max_pain"),
    )


def trend_daily(log: DataFrame, start: Column) -> DataFrame:
    """Worst pain per day from ``start`` on, pain-free days left out."""
    return (
        log.where(F.col("date") >= start)
        .groupBy("subject_id", "date")
        .agg(F.max(numeric_coerce(F.col("pain"))).alias("value"))
        .where(F.col("value") > 0)
        .select("subject_id", "date", date_label(F.col("date"), "short_day").alias("name"), "value", F.lit("pain").alias("type"))
    )


def trend_daily_30d(log: DataFrame, as_of) -> DataFrame:
    """D7."""
    return trend_daily(log, F.date_sub(_day(as_of), 30))


def trend_months(days: DataFrame) -> DataFrame:
    """Episode days per month with a label and a sort key in seconds."""
    return _by_month(days, "short_month_year").select(
        "subject_id",
        F.col("label").alias("name"),
        F.col("episode_days").alias("value"),
        F.lit("count").alias("type"),
        (F.datediff("month_start", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400).alias("sort_key"),
    )


def trend_monthly(log: DataFrame, as_of, span: str = "1y") -> DataFrame:
    """``1y`` starts on the first of the month twelve months back; anything else is all."""
    if span == "1y":
        log = log.where(F.col("date") >= month_start(months_back(_day(as_of), 12)))
    return trend_months(episode_days(log))


def trend_client(log: DataFrame, as_of, span: str = "1y") -> DataFrame:
    """The chart's own ranges; one month shows days, the others show months."""
    if span == "1m":
        start = months_back(_day(as_of), CLIENT_RANGES[span])
        days = max_row_per_day(log.where(F.col("date") >= start).select("subject_id", "entry_id", "date", "time", "pain"))
        return filter_painful(days).select(
            "subject_id",
            date_label(F.col("date"), "short_day").alias("name"),
            numeric_coerce(F.col("pain")).alias("value"),
            F.lit("pain").alias("type"),
        )
    if span != "all":
        log = log.where(F.col("date") >= months_back(_day(as_of), CLIENT_RANGES[span]))
    return trend_months(episode_days(log)).select("subject_id", "name", F.col("value").cast("double").alias("value"), "type")


def avg_days_per_month(log: DataFrame, as_of) -> DataFrame:
    """Episode days of the last year per month of history, at most twelve months."""
    day = _day(as_of)
    recent = (F.col("episode_pain").isNotNull()) & (F.col("date") >= months_back(day, 12)) & (F.col("date") <= day)
    first = F.min("date")
    span = (F.year(day) - F.year(first)) * 12 + F.month(day) - F.month(first) + 1
    return (
        day_profile(log)
        .groupBy("subject_id")
        .agg(
            F.count_if(recent).alias("episode_days_12m"),
            F.least(F.lit(12), F.greatest(F.lit(1), span)).alias("months"),
        )
        .withColumn("avg_days_per_month", round_half_up(F.col("episode_days_12m") / F.col("months"), 1))
    )


def pain_stats_all(log: DataFrame) -> DataFrame:
    """Mean and worst pain over all painful rows, not one per day."""
    pain = F.when(numeric_coerce(F.col("pain")) > 0, numeric_coerce(F.col("pain")))
    return log.groupBy("subject_id").agg(
        F.coalesce(round_half_up(F.avg(pain), 1), F.lit(0.0)).alias("avg_pain"),
        F.coalesce(F.max(pain), F.lit(0.0)).alias("max_pain"),
    )


def entries_since_training(log: DataFrame, trained: DataFrame, threshold: int = 5) -> DataFrame:
    """Rows dated after the subject's last training day (all rows if never trained).

    The log is counted per day first, so the join sees day-grain rows only.
    """
    per_day = log.groupBy("subject_id", "date").agg(F.count(F.lit(1)).alias("n"))
    fresh = F.col("last_trained").isNull() | (F.col("date") > F.col("last_trained"))
    return (
        per_day.join(trained.select("subject_id", "last_trained"), "subject_id", "left")
        .groupBy("subject_id")
        .agg(F.coalesce(F.sum(F.when(fresh, F.col("n"))), F.lit(0)).alias("entries_since_training"))
        .withColumn("needs_retraining", F.col("entries_since_training") >= threshold)
    )


def trend_average(chart: DataFrame) -> DataFrame:
    """Mean of a monthly chart's values."""
    return chart.groupBy("subject_id").agg(F.avg("value").alias("average_value"))


def logged_today(log: DataFrame, as_of) -> DataFrame:
    """D22."""
    return log.groupBy("subject_id").agg(F.coalesce(F.max(F.col("date") == _day(as_of)), F.lit(False)).alias("logged_today"))


def analysis_summary(log: DataFrame, as_of) -> DataFrame:
    """D2-D6 as one (subject, section, key, value) table.

    The sections D2, D3, D4 and D6 share the day profile; Spark reuses its exchange.
    """
    profile = day_profile(log)
    days = profile.where(F.col("episode_pain").isNotNull())
    stats = pain_stats_daily(profile)

    def section(df, name, key, value):
        return df.select("subject_id", F.lit(name).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    parts = [
        section(yearly_counts(days), "yearly_counts", F.col("year"), F.col("episode_days")),
        section(medication_counts(log), "medication_counts", F.col("medication"), F.col("uses")),
        section(monthly_counts_year(days, as_of), "monthly_counts", F.col("label"), F.col("episode_days")),
        section(past_12m_counts(profile), "past_12_months_counts", F.col("label"), F.col("episode_days")),
        section(stats, "avg_pain", F.lit(""), F.col("avg_pain")),
        section(stats, "max_pain", F.lit(""), F.col("max_pain")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
