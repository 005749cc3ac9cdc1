"""Weather scans, landed payloads and the daily cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.weather import union_weather
from ..schemas import FORECAST_PAYLOAD, WEATHER_DAILY, WEATHER_HOURLY
from .log import read_or_empty


def scan_weather(spark: SparkSession, path: str) -> DataFrame:
    """The daily weather table; missing means empty."""
    return read_or_empty(spark, path, WEATHER_DAILY)


def scan_weather_hourly(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, WEATHER_HOURLY)


def scan_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    """A6 from CSV; a header picks the columns, the schema their types."""
    return spark.read.option("header", True).schema(WEATHER_DAILY).csv(path)


def parse_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Landed forecast text -> the nested arrays :func:`explode_forecast` reads."""
    return raw.select("location_id", F.from_json(column, FORECAST_PAYLOAD).alias("p")).select("location_id", "p.*")


def append_weather(cache: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """Append to the cache in the stored column order, one folder per year."""
    combined = union_weather(cache, fresh)
    combined.withColumn("year", F.year("date")).write.mode("error").partitionBy("year").parquet(path)
    return combined
