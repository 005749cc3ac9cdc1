"""Projections, filters and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import (
    activity_label,
    blank_to_null,
    med_names,
    months_back,
    numeric_coerce,
    parse_meds,
    severity_label,
    sleep_label,
    to_meds_json,
    valid_date,
    valid_time,
)

# Keys accepted from older clients, and the column they belong to.
RENAMED_KEYS = {
    "Pain_Level": "Pain Level",
    "Physical_Activity": "Physical Activity",
    "weather_pressure": "pressure",
}
# History ranges in days; one year is a calendar shift.
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90, "180d": 180}
DEFAULT_RANGE = "30d"
GEO = ("latitude", "longitude")


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """B1: exactly the columns of ``schema``; unknown ones go, missing ones are typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def require_columns(df: DataFrame, required) -> DataFrame:
    """Raise ``ValueError`` naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def clean_geo(value: Column) -> Column:
    """Text coordinates: ``unknown`` (any case), blank and ``[]`` are null."""
    text = value.cast("string")
    return F.when(~((F.lower(text) == "unknown") | blank_to_null(text).isNull() | (text == "[]")), value)


def sanitize_entries(df: DataFrame) -> DataFrame:
    """B2: fold old key names into the current ones and null placeholder coordinates."""
    for old, new in RENAMED_KEYS.items():
        if old in df.columns:
            df = df.drop(new).withColumnRenamed(old, new)
    geo = {c: clean_geo(F.col(f"`{c}`")) for c in df.columns if c.lower() in GEO}
    return df.withColumns(geo) if geo else df


def valid_pain(pain: Column) -> Column:
    number = numeric_coerce(pain)
    return number.isNotNull() & number.between(0, 10)


def validate_pain(df: DataFrame) -> DataFrame:
    """Numeric pain within 0..10; all other rows are dropped."""
    return df.where(valid_pain(F.col("pain"))).withColumn("pain", numeric_coerce(F.col("pain")))


def validate_date_time(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (null = accepted); the first failing test names the reason."""
    date, time = F.coalesce(F.col("date"), F.lit("")), F.coalesce(F.col("time"), F.lit(""))
    reason = (
        F.when(~date.rlike(r"^\d{4}-\d{2}-\d{2}$"), "invalid date format")
        .when(valid_date(date).isNull(), "invalid date")
        .when(~time.rlike(r"^\d{2}:\d{2}$"), "invalid time format")
        .when(valid_time(time).isNull(), "invalid time")
    )
    return df.withColumn("reject_reason", reason)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with a real date column, and the quarantine with its reasons."""
    checked = validate_date_time(df)
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason").withColumn("date", F.to_date("date"))
    return good, checked.where(F.col("reject_reason").isNotNull())


def read_sanitize(df: DataFrame) -> DataFrame:
    """Make stored rows safe to serve.

    Pain is truncated to a whole number (0 if unreadable), the medication list is a
    valid list (empty if not), coordinates are numbers or null, null text is ``''``.
    """
    empty = F.array().cast("array<struct<name:string,dosage:string>>")
    out = {
        "pain": F.coalesce(F.col("pain").try_cast("double").try_cast("int"), F.lit(0)),
        "medications": F.coalesce(parse_meds(F.col("medications")), empty),
        **{c: F.col(c).try_cast("double") for c in GEO},
    }
    kept = set(out) | {"subject_id", "entry_id"}
    texts = {
        f.name: F.coalesce(F.col(f.name), F.lit(""))
        for f in df.schema
        if f.name not in kept and isinstance(f.dataType, T.StringType)
    }
    return df.withColumns({**out, **texts})


def migrate_legacy_meds(df: DataFrame) -> DataFrame:
    """Fill a null JSON list from non-empty legacy text (kept whole, not split)."""
    legacy = to_meds_json(
        F.array(F.struct(F.col("medication").alias("name"), F.coalesce(F.col("dosage"), F.lit("")).alias("dosage")))
    )
    todo = F.col("medications").isNull() & (F.col("medication") != "")
    return df.withColumn("medications", F.when(todo, legacy).otherwise(F.col("medications")))


def filter_painful(df: DataFrame) -> DataFrame:
    """Pain above zero; unreadable pain fails."""
    return df.where(numeric_coerce(F.col("pain")) > 0)


def drop_bad_dates(df: DataFrame) -> DataFrame:
    """Text dates become dates, rows without a real one are dropped."""
    if isinstance(df.schema["date"].dataType, T.StringType):
        df = df.withColumn("date", F.try_to_date("date", "yyyy-MM-dd"))
    return df.where(F.col("date").isNotNull())


def range_start(as_of, span: str) -> Column:
    day = F.lit(as_of).cast("date")
    if span == "1y":
        return months_back(day, 12)
    return F.date_sub(day, RANGE_DAYS.get(span, RANGE_DAYS[DEFAULT_RANGE]))


def range_filter(df: DataFrame, as_of, span: str = DEFAULT_RANGE) -> DataFrame:
    """Rows on or after the start of the range; an unknown range means 30 days."""
    return df.where(F.col("date") >= range_start(as_of, span))


def label_decode(df: DataFrame, scheme: str = "current") -> DataFrame:
    """B11 with H19: add label columns for sleep, activity and pain."""
    return df.withColumns(
        {
            "sleep_label": sleep_label(F.col("sleep"), scheme),
            "activity_label": activity_label(F.col("activity"), scheme),
            "severity": severity_label(numeric_coerce(F.col("pain"))),
        }
    )


def location_valid(df: DataFrame) -> DataFrame:
    """Rows whose two coordinates are numbers."""
    return df.withColumns({c: numeric_coerce(F.col(c)) for c in GEO}).dropna(subset=list(GEO))


def with_med_names(df: DataFrame) -> DataFrame:
    """H2 as a table column."""
    return df.withColumn("med_names", med_names(F.col("medications")))
