"""Scans, imports, stores and the model registry."""

from pyspark.sql import functions as F

from ..operators import maintain, usage
from ..operators.clean import conform_schema
from ..operators.daily import dense_timeline
from ..operators.weather import explode_forecast, explode_forecast_daily, union_weather
from ..plans import scoring, training
from ..schemas import EXPORT_NAMES, LOG
from ..session import scratch_path
from ..sources import log as log_source
from ..sources import weather as weather_source
from .base import SETTINGS, TIMELINE, Tables, query, r, rounded, with_tables

LOG_COLUMNS = ", ".join(f.name for f in LOG)
# Imported rows have no id yet.
IMPORT_COLUMNS = ", ".join(f.name for f in LOG if f.name != "entry_id")


@query("a1_scan_log", with_tables("log") + f"select {LOG_COLUMNS} from log")
def scan_log(t: Tables):
    path = scratch_path(t.spark, "log")
    t.log.write.parquet(path)
    return log_source.scan_log(t.spark, path)


@query(
    "a1_scan_log_missing",
    with_tables("log") + "select subject_id, count(*) as n_rows from log group by subject_id",
)
def scan_log_missing(t: Tables):
    # A store that is not there yet adds nothing to one that is.
    absent = log_source.scan_log(t.spark, scratch_path(t.spark, "absent"))
    both = absent.unionByName(conform_schema(t.log, LOG))
    return both.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "a2_scan_entries_range",
    with_tables("log")
    + "select subject_id, entry_id, date, time, pain from log where date between date '1998-03-01' and date '2000-02-29' "
    "order by date desc, time desc",
)
def scan_entries_range(t: Tables):
    return log_source.scan_entries_range(t.log, "1998-03-01", "2000-02-29").select(
        "subject_id", "entry_id", "date", "time", "pain"
    )


INCOMING = """judged as (
  select *, case when regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') then try_cast(date as date) end as day,
    coalesce(try_cast(pain as double) between 0 and 10, false) as pain_ok from raw_log),
checked as (select * from judged where pain_ok and day is not null),
flagged as (
  select c.*, k.time is not null as is_stored from checked c
  left join (select distinct subject_id, date, time from log) k
    on c.subject_id = k.subject_id and c.day = k.date and c.time = k.time)"""

# A CSV cell cannot tell an empty text from a missing one: both come back as null.
IMPORTED = """select subject_id, day as date, time, true as has_fresh_id,
  cast(trunc(try_cast(pain as double)) as int) as pain, nullif(medication, '') as medication, nullif(dosage, '') as dosage, medications, sleep, activity, triggers, notes,
  location, timezone, try_cast(latitude as double) as latitude, try_cast(longitude as double) as longitude
from flagged where not is_stored"""


def _export(t: Tables):
    back = {v: k for k, v in EXPORT_NAMES.items()}
    return t.raw_log.withColumnsRenamed({c: back.get(c, c) for c in t.raw_log.columns})


def _csv(t: Tables):
    path = scratch_path(t.spark, "csv")
    # Keep text exactly: inner blanks, empty strings and quotes inside JSON.
    _export(t).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).option("escape", '"').csv(path)
    return path


@query("a3_ingest_csv", with_tables("raw_log", "log", extra=INCOMING) + IMPORTED)
def ingest_csv(t: Tables):
    rows, _ = log_source.ingest_csv(t.spark, _csv(t), t.log)
    return _fresh_ids(t, rows)


def _fresh_ids(t: Tables, rows):
    """Whether each row has an id above all stored ones, in place of the id."""
    last = t.log.select(F.max("entry_id")).scalar()
    return rows.withColumn("has_fresh_id", F.coalesce(F.col("entry_id") > last, F.lit(False))).drop("entry_id")


SUMMARY = """select i.subject_id, cast(count(*) filter (where not is_stored) as bigint) as imported_rows,
  cast(count(*) filter (where is_stored) as bigint) as skipped_rows, cast(max(x.n) as bigint) as rejected_rows,
  cast(max(h.n) + count(*) filter (where not is_stored) as bigint) as total_rows
from flagged i join (select subject_id, count(*) as n from log group by subject_id) h on i.subject_id = h.subject_id
join (select subject_id, count(*) filter (where not pain_ok or day is null) as n from judged group by subject_id) x on i.subject_id = x.subject_id
group by i.subject_id"""


@query("d20_import_summary", with_tables("raw_log", "log", extra=INCOMING) + SUMMARY)
def import_summary(t: Tables):
    _, summary = log_source.prepare_import(_export(t), t.log)
    return summary


@query(
    "a4_ingest_store",
    with_tables("log_short", "log")
    + """select s.subject_id, s.date, s.time, s.pain, s.triggers, true as has_fresh_id from log_short s
    where not exists (select 1 from log m where m.subject_id = s.subject_id and m.date = s.date and m.time = s.time)""",
)
def ingest_store(t: Tables):
    rows, _ = log_source.ingest_store(t.log_short, t.log)
    return _fresh_ids(t, rows).select("subject_id", "date", "time", "pain", "triggers", "has_fresh_id")


@query(
    "a5_union_stores",
    with_tables("log") + f"select {LOG_COLUMNS} from log",
)
def union_stores(t: Tables):
    root = scratch_path(t.spark, "stores")
    # One folder per store, the layout register_store writes one at a time.
    t.log.write.partitionBy("subject_id").parquet(root)
    return log_source.union_stores(t.spark, root)


WEATHER_COLUMNS = ("tavg", "tmin", "tmax", "pres", "prcp", "wspd", "tsun", "average_humidity", "midday_humidity", "latitude", "longitude")
WEATHER_SELECT = "location_id, date, " + ", ".join(f"{r(c)} as {c}" for c in WEATHER_COLUMNS)


@query("a6_scan_weather", with_tables("weather_daily") + f"select {WEATHER_SELECT} from weather_daily")
def scan_weather(t: Tables):
    path = scratch_path(t.spark, "weather")
    t.weather_daily.write.parquet(path)
    return rounded(weather_source.scan_weather(t.spark, path).drop("pres_change"), *WEATHER_COLUMNS)


def payloads(t: Tables):
    """Landed forecast text: one payload per location and day, as the service returns it."""
    fields = ("temperature_2m", "relative_humidity_2m", "surface_pressure", "precipitation", "wind_speed_10m")
    hour = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *fields)
    hourly = t.weather_hourly.groupBy("location_id", F.to_date("ts").alias("date")).agg(
        F.array_sort(F.collect_list(hour)).alias("h")
    )
    daily_fields = ("temperature_2m_max", "temperature_2m_min", "sunshine_duration")
    joined = hourly.join(t.weather_day_fields, ["location_id", "date"], "left")
    arrays = F.struct(*[F.col(f"h.{c}").alias(c) for c in ("time", *fields)])
    days = F.when(
        F.col("temperature_2m_max").isNotNull(),
        F.struct(F.array(F.col("date").cast("string")).alias("time"), *[F.array(c).alias(c) for c in daily_fields]),
    )
    options = {"ignoreNullFields": "false"}
    return joined.select(
        "location_id", F.to_json(F.struct(arrays.alias("hourly"), days.alias("daily")), options).alias("payload")
    )


HOURLY = ("temperature_2m", "relative_humidity_2m", "surface_pressure", "precipitation", "wind_speed_10m")


@query(
    "a7_explode_forecast",
    with_tables("weather_hourly") + "select location_id, ts, " + ", ".join(f"{r(c)} as {c}" for c in HOURLY) + " from weather_hourly",
)
def explode(t: Tables):
    return rounded(explode_forecast(weather_source.parse_payloads(payloads(t))), *HOURLY)


@query(
    "a7_explode_forecast_daily",
    with_tables("weather_day_fields")
    + f"select location_id, date, {r('temperature_2m_max')} as temperature_2m_max, "
    f"{r('temperature_2m_min')} as temperature_2m_min, {r('sunshine_duration')} as sunshine_duration from weather_day_fields",
)
def explode_daily(t: Tables):
    rows = explode_forecast_daily(weather_source.parse_payloads(payloads(t)))
    return rounded(rows, "temperature_2m_max", "temperature_2m_min", "sunshine_duration")


@query(
    "a8_write_timeline",
    with_tables("log", "weather_daily", "subject_location", extra=TIMELINE)
    + "select subject_id, date, pain, cast(year(date) as int) as year from timeline",
)
def write_timeline(t: Tables):
    path = scratch_path(t.spark, "timeline")
    log_source.write_timeline(dense_timeline(t.log, t.weather_daily, t.subject_location), path)
    return t.spark.read.parquet(path).select("subject_id", "date", "pain", "year")


APPENDED = f"""select {WEATHER_SELECT}, cast(year(date) as int) as year from weather_daily
union all select location_id, date, {r('tavg')}, {r('tmin')}, {r('tmax')}, {r('pres')}, {r('prcp')}, {r('wspd')}, null,
  {r('average_humidity')}, null, null, null, cast(year(date) as int) from (
  select location_id, cast(ts as date) as date, avg(temperature_2m) as tavg, min(temperature_2m) as tmin,
    max(temperature_2m) as tmax, avg(surface_pressure) as pres, sum(precipitation) as prcp, avg(wind_speed_10m) as wspd,
    avg(relative_humidity_2m) as average_humidity from weather_hourly group by 1, 2)"""


def _fresh(t: Tables):
    return t.weather_hourly.groupBy("location_id", F.to_date("ts").alias("date")).agg(
        F.avg("temperature_2m").alias("tavg"), F.min("temperature_2m").alias("tmin"), F.max("temperature_2m").alias("tmax"),
        F.avg("surface_pressure").alias("pres"), F.sum("precipitation").alias("prcp"),
        F.avg("wind_speed_10m").alias("wspd"), F.avg("relative_humidity_2m").alias("average_humidity"),
    )


@query("a9_append_weather", with_tables("weather_daily", "weather_hourly") + APPENDED)
def append_weather(t: Tables):
    path = scratch_path(t.spark, "cache")
    weather_source.append_weather(t.weather_daily, _fresh(t), path)
    return rounded(t.spark.read.parquet(path).drop("pres_change"), *WEATHER_COLUMNS)


@query(
    "g1_union_weather",
    with_tables("weather_daily", "weather_hourly") + f"select location_id, date, tmin, {r('pres_change')} as pres_change, latitude from ("
    + "select location_id, date, tmin, pres_change, latitude from weather_daily union all "
    "select location_id, cast(ts as date), min(temperature_2m), null, null from weather_hourly group by 1, 2)",
)
def union_weather_query(t: Tables):
    both = union_weather(t.weather_daily, _fresh(t)).select("location_id", "date", "tmin", "pres_change", "latitude")
    return rounded(both, "pres_change")


@query("a10_scan_settings", with_tables("settings_changes", extra=SETTINGS) + "select * from priors")
def scan_settings(t: Tables):
    return scoring.scan_settings(maintain.upsert_settings(t.settings_changes))


@query(
    "a11_model_retention",
    with_tables("model_registry")
    + "select model_name, version, cast(row_number() over (partition by model_name order by version desc) as int) as age_rank, "
    "row_number() over (partition by model_name order by version desc) <= 2 as is_kept from model_registry",
)
def model_retention(t: Tables):
    return training.model_retention(t.model_registry).select("model_name", "version", "age_rank", "is_kept")


@query(
    "f1_history_sort",
    with_tables("log")
    + "select subject_id, entry_id, date, time, pain, position from (select *, cast(row_number() over "
    "(partition by subject_id order by date desc, time desc, entry_id) as int) as position from log) where position <= 50",
)
def history_sort(t: Tables):
    return log_source.history_sort(t.log, 50).select("subject_id", "entry_id", "date", "time", "pain", "position")


@query(
    "f2_registry_sort",
    with_tables("medications") + "select subject_id, med_id, name, usage_count from medications order by usage_count desc, name",
)
def registry_sort(t: Tables):
    return usage.registry_sort(t.medications).select("subject_id", "med_id", "name", "usage_count")
