"""From raw rows to one row per subject and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric_coerce

KEYS = ["subject_id", "date"]


def day_window():
    """The one window every daily series operator shares: one exchange, one sort."""
    return Window.partitionBy("subject_id").orderBy("date")


def daily_log_agg(log: DataFrame, carry=()) -> DataFrame:
    """Per day the worst pain, mean sleep and activity, first non-null of ``carry``.

    Only aggregates with a map-side half, so a subject with most of the rows sends one
    row per day and task. "First" follows ``entry_id``.
    """
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("entry_id"))).alias(c) for c in carry]
    return log.groupBy(*KEYS).agg(
        F.max(numeric_coerce(F.col("pain"))).alias("pain"),
        F.avg(numeric_coerce(F.col("sleep"))).alias("sleep"),
        F.avg(numeric_coerce(F.col("activity"))).alias("activity"),
        *firsts,
    )


def calendar_left_join(daily: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every day between ``first_date`` and ``last_date`` per subject, left-joined to
    the daily log."""
    spine = bounds.select("subject_id", F.explode(F.sequence("first_date", "last_date")).alias("date"))
    return spine.join(daily, KEYS, "left")


def subject_bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("subject_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def dense_timeline(log: DataFrame, weather: DataFrame | None = None, subject_location: DataFrame | None = None) -> DataFrame:
    """One row per day from the first to the last day known to the log or the weather.

    Days without a log entry get pain 0 and nulls elsewhere. Instead of building a
    calendar and joining it back, each logged day is expanded up to the day before the
    next one, so the only shuffles are the daily aggregation and the one by subject
    that every later window reuses. Weather bounds enter as two empty marker rows per
    subject.
    """
    rows = log.select(*KEYS, "pain", "sleep", "activity")
    if weather is not None:
        span = weather.groupBy("location_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        marks = subject_location.join(span, "location_id").select(
            "subject_id",
            F.explode(F.array("lo", "hi")).alias("date"),
            *[F.lit(None).cast(log.schema[c].dataType).alias(c) for c in ("pain", "sleep", "activity")],
        )
        rows = rows.unionByName(marks)
    daily = daily_log_agg(rows)
    following = F.lead("date").over(day_window())
    own = F.col("day") == F.col("date")
    return (
        daily.where(F.col("date").isNotNull())
        .withColumn("last_day", F.coalesce(F.date_sub(following, 1), F.col("date")))
        .withColumn("day", F.explode(F.sequence("date", "last_day")))
        .select(
            "subject_id",
            F.col("day").alias("date"),
            F.coalesce(F.when(own, F.col("pain")), F.lit(0.0)).alias("pain"),
            F.when(own, F.col("sleep")).alias("sleep"),
            F.when(own, F.col("activity")).alias("activity"),
        )
    )


def _best_row(df: DataFrame, order: Column) -> DataFrame:
    """One whole row per subject and day, chosen by a partial-aggregating ``max_by``."""
    rest = [c for c in df.columns if c not in KEYS]
    return (
        df.groupBy(*KEYS)
        .agg(F.max_by(F.struct(*rest), order).alias("row"))
        .select(*KEYS, *[F.col(f"row.{c}").alias(c) for c in rest])
    )


def first_per_day(df: DataFrame) -> DataFrame:
    """The row with the latest time; ties go to the lowest ``entry_id``."""
    return _best_row(df, F.struct(F.col("time"), -F.col("entry_id")))


def max_row_per_day(df: DataFrame) -> DataFrame:
    """The row with the worst pain; ties go to the latest time, then lowest id."""
    return _best_row(df, F.struct(numeric_coerce(F.col("pain")), F.col("time"), -F.col("entry_id")))


#: Log rows of a subject that serving looks back on, unless told otherwise.
HISTORY_ROWS = 60


def recent_rows(log: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """The last ``n`` rows per subject by date; rows without a date are no history.

    ``row_number() <= n`` lets Spark cut each task's rows to ``n`` per subject before
    the shuffle, so a hot subject stays small.
    """
    order = Window.partitionBy("subject_id").orderBy(F.col("date").desc(), F.col("entry_id").desc())
    dated = log.where(F.col("date").isNotNull())
    return dated.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def latest_location(log: DataFrame) -> DataFrame:
    """Coordinates of the newest located row per subject."""
    lat, lon = numeric_coerce(F.col("latitude")), numeric_coerce(F.col("longitude"))
    return (
        log.where(lat.isNotNull() & lon.isNotNull())
        .groupBy("subject_id")
        .agg(F.max_by(F.struct(lat.alias("lat"), lon.alias("lon")), F.struct("date", "time", "entry_id")).alias("at"))
        .select("subject_id", F.col("at.lat").alias("latitude"), F.col("at.lon").alias("longitude"))
    )
