"""Table layouts: one explicit StructType per table, plus fixed defaults."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(spec: str) -> T.StructType:
    """``"name type, name type"`` to a StructType; usable before a session exists."""
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOG = _struct(
    "subject_id bigint, entry_id bigint, date date, time string, pain int, "
    "medication string, dosage string, medications string, sleep string, activity string, "
    "triggers string, notes string, location string, timezone string, "
    "latitude double, longitude double"
)

# The same log before cleaning: everything the user typed is still text.
RAW_LOG = T.StructType(
    [
        f if f.name in ("subject_id", "entry_id") else T.StructField(f.name, T.StringType())
        for f in LOG
    ]
)

WEATHER_DAILY = _struct(
    "location_id bigint, date date, tavg double, tmin double, tmax double, pres double, "
    "pres_change double, prcp double, wspd double, tsun double, average_humidity double, "
    "midday_humidity double, latitude double, longitude double"
)

WEATHER_HOURLY = _struct(
    "location_id bigint, ts timestamp_ntz, temperature_2m double, relative_humidity_2m double, "
    "surface_pressure double, precipitation double, wind_speed_10m double"
)

WEATHER_DAILY_FIELDS = _struct(
    "location_id bigint, date date, temperature_2m_max double, temperature_2m_min double, "
    "sunshine_duration double"
)

# Text form, because only ``from_json`` reads it.
FORECAST_PAYLOAD = (
    "hourly struct<time: array<string>, temperature_2m: array<double>, "
    "relative_humidity_2m: array<double>, surface_pressure: array<double>, "
    "precipitation: array<double>, wind_speed_10m: array<double>>, "
    "daily struct<time: array<string>, temperature_2m_max: array<double>, "
    "temperature_2m_min: array<double>, sunshine_duration: array<double>>"
)

MEDICATIONS = _struct(
    "subject_id bigint, med_id bigint, name string, display_name string, "
    "default_dosage string, frequency string, period_days int, usage_count bigint"
)

TRIGGERS = _struct(
    "subject_id bigint, trigger_id bigint, name string, usage_count bigint, "
    "is_system_default boolean, category string"
)

SETTINGS = _struct("subject_id bigint, key string, value string")

# Setting keys and their defaults.
PRIOR_DEFAULTS = {
    "baseline_risk": 0.1,
    "weather_sensitivity": 0.5,
    "sleep_sensitivity": 0.5,
    "strain_sensitivity": 0.5,
}
TEMP_UNIT_DEFAULT = "C"

# Columns that must be present before an import is accepted.
REQUIRED_IMPORT_COLUMNS = ("date", "time", "pain")

# Column names used by exported files, and the names used here.
EXPORT_NAMES = {
    "id": "entry_id",
    "Date": "date",
    "Time": "time",
    "Pain Level": "pain",
    "Medication": "medication",
    "Dosage": "dosage",
    "Medications": "medications",
    "Sleep": "sleep",
    "Physical Activity": "activity",
    "Triggers": "triggers",
    "Notes": "notes",
    "Location": "location",
    "Timezone": "timezone",
    "Latitude": "latitude",
    "Longitude": "longitude",
}
