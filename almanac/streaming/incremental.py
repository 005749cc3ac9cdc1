"""M1-M4: continuous ingest, usage counts, daily maxima and weather rollup.

Inputs are streaming DataFrames with a wall-clock event time ``ts``. Results go to files
in the shared folder, never through the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import numeric_coerce, split_list
from ..operators.maintain import anti_join_dedup
from ..operators.weather import finish_rollup, rollup_columns
from ..session import scratch_path
from ..sources.log import read_or_empty

DEDUP_KEY = ["subject_id", "date", "time"]


def with_event_time(stream: DataFrame, delay: str) -> DataFrame:
    """Watermarks need an instant: read the wall clock as UTC, whatever the session zone,
    so day windows start at midnight."""
    instant = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    return stream.withColumn("event_time", instant).withWatermark("event_time", delay)


def window_date() -> Column:
    return F.to_date(F.to_utc_timestamp("window.start", F.current_timezone()))


def write_partitions(rows: DataFrame, store_path: str, number: int) -> None:
    """Put rows into the store's folders by day and batch; the folders they fall into are replaced."""
    numbered = rows.withColumn("batch", F.lit(number))
    writer = numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "batch").parquet(store_path)


def stored_on(spark: SparkSession, store_path: str, schema: T.StructType, days: list) -> DataFrame:
    """The store's rows on some days; the other days' folders are not listed for reading."""
    return read_or_empty(spark, store_path, schema_with_batch(schema)).where(F.col("date").isin(days))


def ingest_dedup(stream: DataFrame, store_path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """M1: append rows whose (subject, date, time) is neither in the stream nor stored.

    The watermark bounds the state; the anti-join against the store catches what is older than
    the watermark. The store has a folder for every day and batch, and a batch meets only the
    folders of its own days, so its cost follows what arrives and not what is kept; the list of
    those days is at most the calendar. A replayed batch sees the batches before it as it did at
    first and replaces its own folders, so it cannot append twice. Rows without a date are
    always new.
    """
    schema = stream.schema
    fresh = with_event_time(stream, delay).dropDuplicatesWithinWatermark(DEDUP_KEY).drop("event_time")

    def append(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        days = [r["date"] for r in batch.where("date is not null").select("date").distinct().collect()]
        stored = stored_on(batch.sparkSession, store_path, schema, days).where(F.col("batch") < number)
        write_partitions(anti_join_dedup(batch, stored.select(*schema.names)), store_path, number)
        batch.unpersist()

    return (
        fresh.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def schema_with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])


def usage_counts(stream: DataFrame) -> DataFrame:
    """M2: running uses per subject and trigger (update or complete mode)."""
    return (
        stream.select("subject_id", F.explode(split_list(F.col("triggers"))).alias("name"))
        .groupBy("subject_id", "name")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def daily_max(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """M3: worst pain per subject and day, emitted once the day is past the watermark."""
    return (
        with_event_time(stream, delay)
        .groupBy("subject_id", F.window("event_time", "1 day"))
        .agg(F.max(numeric_coerce(F.col("pain"))).alias("pain"))
        .select("subject_id", window_date().alias("date"), "pain")
    )


def weather_rollup(stream: DataFrame, daily: DataFrame | None = None, delay: str = "1 day") -> DataFrame:
    """M4: hourly readings to D17's daily row, per location, emitted once the day is past the watermark.

    The aggregates, with their defaults for readings that are missing, are D17's own; the daily
    extremes and sunshine (``daily``) are a static table that each closed day meets by key.
    """
    rolled = (
        with_event_time(stream, delay)
        .groupBy("location_id", F.window("event_time", "1 day"))
        .agg(*rollup_columns())
        .withColumn("date", window_date())
        .drop("window")
    )
    return finish_rollup(rolled, daily)


def drain(result: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a streaming frame over what is available and return what it emitted.

    Append output is a plain file sink. Update output keeps one folder per batch;
    the caller reduces it to the latest row per key.
    """
    spark = result.sparkSession
    base = scratch_path(spark, label)
    writer = result.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    return read_or_empty(spark, f"{base}/out", result.schema if mode == "append" else schema_with_batch(result.schema))
