"""Hourly payloads to daily weather features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .clean import location_valid

# Stand-ins for missing readings.
DEFAULT_PRESSURE = 1015.0
DEFAULT_HUMIDITY = 50.0

HOURLY_FIELDS = (
    "temperature_2m",
    "relative_humidity_2m",
    "surface_pressure",
    "precipitation",
    "wind_speed_10m",
)
DAILY_FIELDS = ("temperature_2m_max", "temperature_2m_min", "sunshine_duration")
# Column order of the stored daily table.
DAILY_COLUMNS = [
    "location_id", "date", "tavg", "tmin", "tmax", "pres", "pres_change", "prcp", "wspd", "tsun",
    "average_humidity", "midday_humidity", "latitude", "longitude",
]


def _explode(payloads: DataFrame, part: str, fields) -> DataFrame:
    arrays = F.arrays_zip(*[F.col(f"{part}.{c}").alias(c) for c in ("time", *fields)])
    return payloads.select("location_id", F.explode(arrays).alias("r")).select(
        "location_id", "r.time", *[f"r.{c}" for c in fields]
    )


def explode_forecast(payloads: DataFrame) -> DataFrame:
    """Parallel arrays -> one row per location and hour."""
    rows = _explode(payloads, "hourly", HOURLY_FIELDS)
    return rows.select("location_id", F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"), *HOURLY_FIELDS)


def explode_forecast_daily(payloads: DataFrame) -> DataFrame:
    """A7 for the daily arrays of the same payload."""
    rows = _explode(payloads, "daily", DAILY_FIELDS)
    return rows.select("location_id", F.to_date("time").alias("date"), *DAILY_FIELDS)


def rollup_columns() -> list[Column]:
    """D17's aggregates over the hours of a day, batch or stream; ``midday_humidity`` may still be null."""
    return [
        F.count(F.lit(1)).alias("n_hours"),
        F.coalesce(F.avg("temperature_2m"), F.lit(0.0)).alias("tavg"),
        F.coalesce(F.min("temperature_2m"), F.lit(0.0)).alias("tmin"),
        F.coalesce(F.max("temperature_2m"), F.lit(0.0)).alias("tmax"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("prcp"),
        F.coalesce(F.avg("wind_speed_10m"), F.lit(0.0)).alias("wspd"),
        F.coalesce(F.avg("surface_pressure"), F.lit(DEFAULT_PRESSURE)).alias("pres"),
        F.coalesce(F.avg("relative_humidity_2m"), F.lit(DEFAULT_HUMIDITY)).alias("average_humidity"),
        F.max(F.when(F.hour("ts") == 12, F.col("relative_humidity_2m"))).alias("midday_humidity"),
    ]


def finish_rollup(rolled: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """The rest of D17: the noon humidity falls back to the mean, daily extremes win over hourly ones."""
    rolled = rolled.withColumn("midday_humidity", F.coalesce("midday_humidity", "average_humidity"))
    if daily is None:
        return rolled.withColumn("tsun", F.lit(0.0))
    return (
        rolled.join(daily, ["location_id", "date"], "left")
        .withColumns(
            {
                "tmin": F.coalesce("temperature_2m_min", "tmin"),
                "tmax": F.coalesce("temperature_2m_max", "tmax"),
                "tsun": F.coalesce(F.col("sunshine_duration"), F.lit(0.0)) / 60.0,
            }
        )
        .drop(*DAILY_FIELDS)
    )


def weather_daily_rollup(hourly: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """A day's hours to one feature row; daily extremes win over hourly ones."""
    return finish_rollup(hourly.groupBy("location_id", F.to_date("ts").alias("date")).agg(*rollup_columns()), daily)


def humidity_daily(hourly: DataFrame) -> DataFrame:
    """Mean humidity and the noon reading; null when there is none."""
    return hourly.groupBy("location_id", F.to_date("ts").alias("date")).agg(
        F.avg("relative_humidity_2m").alias("average_humidity"),
        F.max(F.when(F.hour("ts") == 12, F.col("relative_humidity_2m"))).alias("midday_humidity"),
    )


def pressure_change_3h(hourly: DataFrame) -> DataFrame:
    """Pressure against the row three back; the first three rows have no change.

    Runs over all hours, so trimming to a forecast window comes afterwards.
    """
    w = Window.partitionBy("location_id").orderBy("ts")
    known = F.when(F.col("surface_pressure") != 0, F.col("surface_pressure"))
    filled = F.coalesce(known, F.lit(DEFAULT_PRESSURE))
    return hourly.withColumn("pressure_change_3h", F.coalesce(filled - F.lag(filled, 3).over(w), F.lit(0.0)))


def pressure_change_24h(rollup: DataFrame) -> DataFrame:
    """Change of the daily mean; 0 unless the day before is there in full."""
    w = Window.partitionBy("location_id").orderBy("date")
    full = (F.lag("n_hours").over(w) >= 24) & (F.lag("date").over(w) == F.date_sub("date", 1))
    return rollup.withColumn(
        "pres_change", F.when(full, F.col("pres") - F.lag("pres").over(w)).otherwise(F.lit(0.0))
    )


def forecast_features(hourly: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """D17 + E11: the daily feature row the scorers use."""
    return pressure_change_24h(weather_daily_rollup(hourly, daily))


def weather_missing_keys(log: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct (date, latitude, longitude) of the log that the cache lacks."""
    keys = ["date", "latitude", "longitude"]
    wanted = location_valid(log).select(*keys).distinct()
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def union_weather(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """G1: append fresh rows to the cache in the stored column order."""
    both = cache.unionByName(fresh, allowMissingColumns=True)
    return both.select(*[c for c in DAILY_COLUMNS if c in both.columns])


def daily_weather_lookup(targets: DataFrame, weather: DataFrame) -> DataFrame:
    """Features of each (location, target_date)."""
    return targets.join(weather.withColumnRenamed("date", "target_date"), ["location_id", "target_date"], "left")
