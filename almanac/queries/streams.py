"""M1-M4: the streaming forms, replayed over the event table until nothing is left."""

from pyspark.sql import functions as F

from .. import streaming
from ..session import Written, scratch_path
from ..streaming.incremental import schema_with_batch, write_partitions
from .base import Tables, query, r, rounded, with_tables
from .bindings import LOG_SHORT
from .weather import COLUMNS, ROLLUP, TABLES


def event_stream(t: Tables):
    return (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.directory)
    )


def log_stream(t: Tables):
    event_stream(t).createOrReplaceTempView("almanac_event_stream")
    return t.spark.sql(LOG_SHORT.format(events="almanac_event_stream"))


def _store(t: Tables, path: str):
    """What is stored before the stream starts: the clicks of the same log."""
    write_partitions(t.log_short.where(F.col("triggers") == "click"), path, -1)


@query(
    "m1_stream_ingest_dedup",
    with_tables("log_short")
    + "select distinct subject_id, date, time from log_short s where not exists (select 1 from log_short k where k.triggers = 'click' "
    "and k.subject_id = s.subject_id and k.date = s.date and k.time = s.time)",
)
def stream_ingest_dedup(t: Tables):
    base = scratch_path(t.spark, "ingest")
    _store(t, f"{base}/store")
    stream = log_stream(t)
    streaming.ingest_dedup(stream, f"{base}/store", f"{base}/state", delay="40 days").awaitTermination()
    rows = t.spark.read.schema(schema_with_batch(stream.schema)).parquet(f"{base}/store")
    return rows.where(F.col("batch") >= 0).select("subject_id", "date", "time")


@query(
    "m2_stream_usage_counts",
    with_tables("log_short") + "select subject_id, triggers as name, count(*) as uses from log_short group by 1, 2",
)
def stream_usage_counts(t: Tables):
    emitted = streaming.drain(streaming.usage_counts(log_stream(t)), "update", "usage")
    return emitted.groupBy("subject_id", "name").agg(F.max_by("uses", "batch").alias("uses"))


# Append mode emits a day once the watermark (newest event less the delay) has passed
# its end.
_CLOSED = "date + 1 <= (select max(ts) - interval 1 day from events)"


@query(
    "m3_stream_daily_max",
    with_tables("log_short")
    + f"select subject_id, date, cast(max(pain) as double) as pain from log_short where {_CLOSED} group by 1, 2",
)
def stream_daily_max(t: Tables):
    return streaming.drain(streaming.daily_max(log_stream(t)), "append", "daily-max")


# The newest hour, less the delay, has passed the end of a closed day.
_HOURS_CLOSED = "date + 1 <= (select max(ts) - interval 1 day from weather_hourly)"


@query(
    "m4_stream_weather_rollup",
    with_tables(*TABLES, extra=ROLLUP)
    + "select location_id, date, n_hours, " + ", ".join(f"{r(c)} as {c}" for c in COLUMNS) + f" from rollup where {_HOURS_CLOSED}",
)
def stream_weather_rollup(t: Tables):
    hours = Written(t.weather_hourly, "hours")
    readings = t.spark.readStream.schema(hours.frame.schema).parquet(hours.path)
    emitted = streaming.drain(streaming.weather_rollup(readings, t.weather_day_fields), "append", "weather")
    hours.drop()
    return rounded(emitted.select("location_id", "date", "n_hours", *COLUMNS), *COLUMNS)
