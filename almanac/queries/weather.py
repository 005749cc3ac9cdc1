"""Weather rollups and lookups."""

from pyspark.sql import functions as F

from ..operators import weather
from .base import Tables, query, r, rounded, with_tables

ROLLUP = """rollup as (
  select h.location_id, h.date, n_hours, tavg, coalesce(d.temperature_2m_min, h.tmin) as tmin, coalesce(d.temperature_2m_max, h.tmax) as tmax,
    prcp, wspd, pres, average_humidity, coalesce(noon, average_humidity) as midday_humidity, coalesce(d.sunshine_duration, 0.0) / 60.0 as tsun
  from (select location_id, cast(ts as date) as date, count(*) as n_hours, avg(temperature_2m) as tavg, min(temperature_2m) as tmin,
      max(temperature_2m) as tmax, sum(precipitation) as prcp, avg(wind_speed_10m) as wspd, coalesce(avg(surface_pressure), 1015.0) as pres,
      coalesce(avg(relative_humidity_2m), 50.0) as average_humidity, max(relative_humidity_2m) filter (where hour(ts) = 12) as noon
    from weather_hourly group by 1, 2) h
  left join weather_day_fields d on d.location_id = h.location_id and d.date = h.date),
changed as (select *, case when lag(n_hours) over w >= 24 and lag(date) over w = date - 1 then pres - lag(pres) over w else 0.0 end as pres_change
  from rollup window w as (partition by location_id order by date))"""

COLUMNS = ("tavg", "tmin", "tmax", "prcp", "wspd", "pres", "average_humidity", "midday_humidity", "tsun")
TABLES = ("weather_hourly", "weather_day_fields")


@query(
    "d17_weather_daily_rollup",
    with_tables(*TABLES, extra=ROLLUP) + "select location_id, date, n_hours, " + ", ".join(f"{r(c)} as {c}" for c in COLUMNS) + " from rollup",
)
def daily_rollup(t: Tables):
    return rounded(weather.weather_daily_rollup(t.weather_hourly, t.weather_day_fields), *COLUMNS)


@query(
    "d18_humidity_daily",
    with_tables("weather_hourly")
    + f"select location_id, cast(ts as date) as date, {r('avg(relative_humidity_2m)')} as average_humidity, "
    f"{r('max(relative_humidity_2m) filter (where hour(ts) = 12)')} as midday_humidity from weather_hourly group by 1, 2",
)
def humidity_daily(t: Tables):
    return rounded(weather.humidity_daily(t.weather_hourly), "average_humidity", "midday_humidity")


HOURLY = """hourly as (select *, coalesce(coalesce(nullif(surface_pressure, 0), 1015)
  - lag(coalesce(nullif(surface_pressure, 0), 1015), 3) over (partition by location_id order by ts), 0.0) as pressure_change_3h from weather_hourly)"""


@query("e10_pressure_change_3h", with_tables("weather_hourly", extra=HOURLY) + f"select location_id, ts, {r('pressure_change_3h')} as pressure_change_3h from hourly")
def change_3h(t: Tables):
    return rounded(weather.pressure_change_3h(t.weather_hourly).select("location_id", "ts", "pressure_change_3h"), "pressure_change_3h")


@query(
    "e11_pressure_change_24h",
    with_tables(*TABLES, extra=ROLLUP) + f"select location_id, date, {r('pres_change')} as pres_change from changed",
)
def change_24h(t: Tables):
    rows = weather.forecast_features(t.weather_hourly, t.weather_day_fields)
    return rounded(rows.select("location_id", "date", "pres_change"), "pres_change")


@query(
    "c5_weather_missing_keys",
    with_tables("log", "weather_daily")
    + "select distinct date, latitude, longitude from log l where latitude is not null and longitude is not null and not exists ("
    "select 1 from weather_daily w where w.date = l.date and w.latitude = l.latitude and w.longitude = l.longitude)",
)
def missing_keys(t: Tables):
    return weather.weather_missing_keys(t.log, t.weather_daily)


@query(
    "c12_daily_weather_lookup",
    with_tables("weather_hourly", "weather_day_fields", "subject_location_short", extra=ROLLUP)
    + "select s.subject_id, s.target_date, " + ", ".join(f"{r('c.' + c)} as {c}" for c in ("tavg", "pres", "pres_change")) + " from ("
    "select subject_id, location_id, cast(unnest(generate_series(date '2024-01-27', date '2024-02-02', interval 1 day)) as date) as target_date "
    "from subject_location_short) s left join changed c on c.location_id = s.location_id and c.date = s.target_date",
)
def weather_lookup(t: Tables):
    from ..plans.scoring import forecast_targets

    targets = forecast_targets(t.subject_location_short, "2024-01-27")
    rows = weather.daily_weather_lookup(targets, weather.forecast_features(t.weather_hourly, t.weather_day_fields))
    return rounded(rows.select("subject_id", "target_date", "tavg", "pres", "pres_change"), "tavg", "pres", "pres_change")
