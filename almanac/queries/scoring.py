"""Rule scores and forecasts."""

from pyspark.sql import functions as F

from ..operators import maintain, timeseries
from ..operators.features import circadian_prior, inference_features
from ..operators.weather import forecast_features
from ..plans import endpoints, scoring
from .base import FEATURES, SETTINGS, TIMELINE, Tables, query, r, rounded, rules_level, weather_score, with_tables
from .bindings import FORECAST_START
from .features import features_of, prior_sql
from .timeline import TABLES
from .weather import HOURLY, ROLLUP


def settings_of(t: Tables):
    return scoring.scan_settings(maintain.upsert_settings(t.settings_changes))


DEFAULT_RISK = "0.1 + case when pain_lag_1 > 2 then 0.08 else 0.0 end"

DAILY_RISK_SQL = (
    with_tables("log", extra=TIMELINE.replace(
        """union all
    select l.subject_id, min(w.date), max(w.date) from subject_location l join weather_daily w using (location_id)
      where l.subject_id in (select subject_id from log) group by l.subject_id""", ""))
    + f"select subject_id, date, pain, {r('p', 2)} as probability, {rules_level('p')} as risk_level from ("
    f"select *, cast({DEFAULT_RISK} as double) as p from (select *, lag(pain) over (partition by subject_id order by date) as pain_lag_1 from timeline))"
)


@query("daily_risk", DAILY_RISK_SQL)
def daily_risk(t: Tables):
    """The flagship: dense timeline, lags, default-prior rules, one row per subject-day."""
    from ..operators.daily import dense_timeline

    rows = scoring.daily_risk(timeseries.pain_lags(dense_timeline(t.log)))
    return rows.select("subject_id", "date", "pain", "probability", "risk_level")


def _daily_probability(delta: str, lag: str) -> str:
    return (
        f"least(greatest(coalesce(b.baseline_risk, 0.1) + {weather_score(delta, 8.0, 'f.prcp', 'f.average_humidity')} "
        f"* coalesce(b.weather_sensitivity, 0.5) * 0.5 "
        f"+ case when {lag} > 2 then coalesce(b.baseline_risk, 0.1) * 0.8 else 0.0 end, 0.0), 1.0)"
    )


@query(
    "j1_heuristic_daily",
    with_tables(*TABLES, "settings_changes", extra=FEATURES + ", " + SETTINGS)
    + f"select subject_id, date, {r('p')} as raw_probability, {r('w', 2)} as weather_contribution, {r('boost', 2)} as cluster_boost, {rules_level('p')} as risk_level from ("
    f"select f.subject_id, f.date, {weather_score('f.pres_change', 8.0, 'f.prcp', 'f.average_humidity')} as w, "
    "case when f.pain_lag_1 > 2 then coalesce(b.baseline_risk, 0.1) * 0.8 else 0.0 end as boost, "
    f"{_daily_probability('f.pres_change', 'f.pain_lag_1')} as p from features f left join priors b on b.subject_id = f.subject_id)",
)
def heuristic_daily(t: Tables):
    rows = scoring.daily_risk(features_of(t), settings_of(t))
    columns = ("subject_id", "date", "raw_probability", "weather_contribution", "cluster_boost", "risk_level")
    return rounded(rows.select(*columns), "raw_probability")


@query(
    "c10_hour_prior_join",
    with_tables("log_short", "weather_hourly", "subject_location_short", extra=prior_sql("log_short"))
    + f"select s.subject_id, h.ts, {r('coalesce(p.prior, 0.1)')} as prior from weather_hourly h join subject_location_short s on s.location_id = h.location_id "
    "left join hour_priors p on p.subject_id = s.subject_id and p.hour = hour(h.ts)",
)
def hour_prior_join(t: Tables):
    hours = t.weather_hourly.select("location_id", "ts").join(t.subject_location_short, "location_id")
    rows = scoring.hour_prior_join(hours, circadian_prior(t.log_short))
    return rounded(rows.select("subject_id", "ts", "prior"), "prior")


# J2 rows: every hour of every subject's location, priors from the last 60 log rows.
RECENT60 = """recent60 as (select * from (select *, row_number() over (partition by subject_id order by date desc, entry_id desc) as rn
  from log_short) where rn <= 60)"""
_W = weather_score("h.pressure_change_3h", 3.0, "h.precipitation", "h.relative_humidity_2m") + " * 0.5"


def _scored(factor: str = "1.0", join: str = "", places: str = "subject_location_short") -> str:
    return f"""scored as (select *, {r(r("p", 2) + " * 100", 1)} as risk_score, {rules_level('p')} as risk_level from (
  select subject_id, location_id, ts, temperature_2m, relative_humidity_2m, w, prior, factor,
    least(greatest((w * 0.6 + prior * 0.4 + case when w > 0.5 and prior > 0.5 then 0.2 else 0.0 end) * factor, 0.0), 1.0) as p from (
    select s.subject_id, h.*, coalesce(p.prior, 0.1) as prior, {_W} as w, {factor} as factor
    from hourly h join {places} s on s.location_id = h.location_id
    left join hour_priors p on p.subject_id = s.subject_id and p.hour = hour(h.ts) {join})))"""


HOURS = HOURLY + ", " + RECENT60 + ", " + prior_sql("recent60")
SHORT = ("log_short", "weather_hourly", "subject_location_short")


@query(
    "j2_heuristic_hourly",
    with_tables(*SHORT, extra=HOURS + ", " + _scored())
    + f"select subject_id, ts, {r('p')} as raw_probability, {r('w', 2)} as heuristic_weather, {r('prior', 2)} as circadian_risk, risk_level from scored",
)
def heuristic_hourly(t: Tables):
    rows = scoring.hourly_scores(t.weather_hourly, t.log_short, t.subject_location_short)
    return rounded(
        rows.select("subject_id", "ts", "raw_probability", "heuristic_weather", "circadian_risk", "risk_level"), "raw_probability"
    )


RECENCY = """asked as (select s.subject_id, h.ts from weather_hourly h join subject_location_short s on s.location_id = h.location_id),
recency as (select a.subject_id, a.ts, max(d.dose_ts) as last_dose, date_diff('second', max(d.dose_ts), a.ts) / 3600.0 as recency_hours
  from asked a left join doses d on d.subject_id = a.subject_id and d.dose_ts <= a.ts group by 1, 2)"""


def _recency(t: Tables):
    hours = t.weather_hourly.select("location_id", "ts").join(t.subject_location_short, "location_id")
    return scoring.medication_recency(hours, t.doses)


@query(
    "j3_medication_recency",
    with_tables("weather_hourly", "subject_location_short", "doses", extra=RECENCY)
    + f"select subject_id, ts, last_dose, {r('recency_hours')} as recency_hours from recency",
)
def medication_recency(t: Tables):
    return rounded(_recency(t), "recency_hours")


_SHIELD = (
    "case when q.recency_hours < 2.0 then 0.1 when q.recency_hours < 6.0 then 0.1 + (q.recency_hours - 2.0) * 0.225 else 1.0 end"
)


@query(
    "j2_heuristic_hourly_shielded",
    with_tables(
        *SHORT, "doses",
        extra=HOURS + ", " + RECENCY + ", " + _scored(_SHIELD, "left join recency q on q.subject_id = s.subject_id and q.ts = h.ts"),
    )
    + f"select subject_id, ts, {r('p')} as raw_probability, {r('factor', 2)} as mitigation_factor from scored",
)
def heuristic_hourly_shielded(t: Tables):
    rows = scoring.hourly_scores(t.weather_hourly, t.log_short, t.subject_location_short, _recency(t))
    return rounded(rows.select("subject_id", "ts", "raw_probability", "mitigation_factor"), "raw_probability")


# Daily rule scores of the short log: the anchors of the calibration.
SHORT_WEATHER = """short_targets as (select l.subject_id, l.location_id, cast(unnest(generate_series({first}, {last}, interval 1 day)) as date) as target_date
  from subject_location_short l),
short_recent as (select subject_id, date, arg_max(pain, entry_id) as pain from recent60 group by 1, 2),
anchors as (select *, """ + r(r("p", 2) + " * 100", 1) + """ as daily_score, """ + rules_level("p") + """ as level from (
  select t.subject_id, t.target_date, """ + _daily_probability("f.pres_change", "coalesce(q.pain, 0)") + """ as p
  from short_targets t left join changed f on f.location_id = t.location_id and f.date = t.target_date
    left join priors b on b.subject_id = t.subject_id
    left join short_recent q on q.subject_id = t.subject_id and q.date = t.target_date - 1))"""


def anchors_sql(first: str, last: str) -> str:
    return SHORT_WEATHER.format(first=f"date '{first}'", last=f"date '{last}'")


SHORT_ALL = (*SHORT, "weather_day_fields", "settings_changes")


def short_features(t: Tables, start: str, days: int):
    weather = forecast_features(t.weather_hourly, t.weather_day_fields)
    return inference_features(t.log_short, scoring.forecast_targets(t.subject_location_short, start, days), weather)


@query(
    "j6_predict_day_rules",
    with_tables(*SHORT_ALL, extra=RECENT60 + ", " + ROLLUP + ", " + SETTINGS + ", " + anchors_sql("2024-01-20", "2024-01-26"))
    + "select subject_id, target_date, daily_score as probability, level as risk_level, 0.0::double as predicted_pain, 'Heuristic' as source from anchors",
)
def predict_day_rules(t: Tables):
    rows = endpoints.prediction_future(short_features(t, "2024-01-20", 7), settings_of(t))
    return rows.select("subject_id", "target_date", "probability", "risk_level", "predicted_pain", "source")


@query(
    "j7_weekly_forecast",
    with_tables(*SHORT_ALL, extra=RECENT60 + ", " + ROLLUP + ", " + SETTINGS + ", " + anchors_sql("2024-01-29", "2024-02-04"))
    + "select subject_id, target_date as date, daily_score as risk_probability, level as risk_level, 0.0::double as predicted_pain from anchors",
)
def weekly_forecast(t: Tables):
    weather = forecast_features(t.weather_hourly, t.weather_day_fields)
    return endpoints.prediction_forecast(t.log_short, t.subject_location_short, weather, "2024-01-29", settings_of(t))


_CALIBRATED = """calibrated as (select *,
  case when daily_score > 30 and daily_score > peak then
    least(risk_score * least(case when peak > 5 then daily_score / peak else 1.0 end, 2.5), 99.0) end as lifted from (
  select *, max(risk_score) over (partition by subject_id, cast(ts as date)) as peak from windowed))"""
_FINAL = (
    f"select subject_id, ts, case when lifted is null then risk_score else {r('lifted', 1)} end as risk_score, "
    "case when lifted is null then risk_level when lifted >= 60 then 'High' when lifted >= 30 then 'Moderate' else 'Low' end as risk_level"
)
_DERIVED_ANCHOR = "(subject_id % 10) * 11.0 + day(ts) % 4"


@query(
    "c11_daily_anchor_join",
    with_tables(*SHORT, "log_short", extra="a as (select subject_id, date, least(cast(sum(pain) as double), 100.0) as daily_score from log_short group by 1, 2)")
    + "select s.subject_id, h.ts, a.daily_score from weather_hourly h join subject_location_short s on s.location_id = h.location_id "
    "left join a on a.subject_id = s.subject_id and a.date = cast(h.ts as date)",
)
def daily_anchor_join(t: Tables):
    daily = t.log_short.groupBy("subject_id", "date").agg(F.least(F.sum("pain").cast("double"), F.lit(100.0)).alias("daily_score"))
    hours = t.weather_hourly.select("location_id", "ts").join(t.subject_location_short, "location_id")
    return scoring.daily_anchor_join(hours, daily).select("subject_id", "ts", "daily_score")


@query(
    "j4_calibrate_hourly",
    with_tables(*SHORT, extra=HOURS + ", " + _scored() + f", windowed as (select *, {_DERIVED_ANCHOR} as daily_score from scored), " + _CALIBRATED)
    + _FINAL + " from calibrated",
)
def calibrate_hourly(t: Tables):
    rows = scoring.hourly_scores(t.weather_hourly, t.log_short, t.subject_location_short).withColumns(
        {"date": F.to_date("ts"), "daily_score": F.pmod("subject_id", F.lit(10)) * 11.0 + F.day("ts") % 4}
    )
    return scoring.calibrate_hourly(rows).select("subject_id", "ts", "risk_score", "risk_level")


def _forecast_sql(places: str = "subject_location_short", extra: str = "") -> str:
    return (
        with_tables(
            *SHORT_ALL,
            extra=extra + HOURS + ", " + ROLLUP + ", " + SETTINGS + ", " + anchors_sql("2024-01-20", "2024-01-21") + ", " + _scored(places=places)
            + f", windowed as (select s.*, a.daily_score from scored s left join anchors a on a.subject_id = s.subject_id and a.target_date = cast(s.ts as date) "
            f"where s.ts >= timestamp '{FORECAST_START}' and s.ts < timestamp '{FORECAST_START}' + interval 24 hour), " + _CALIBRATED,
        )
        + _FINAL
        + f", {r('temperature_2m')} as temp, {r('relative_humidity_2m')} as humidity from calibrated"
    )


def _forecast(t: Tables, places, default_location: int | None = None):
    daily = scoring.predict_day(short_features(t, "2024-01-20", 2), settings_of(t)).select(
        "subject_id", F.col("target_date").alias("date"), F.col("probability").alias("daily_score")
    )
    rows = endpoints.prediction_hourly(t.weather_hourly, t.log_short, places, daily, FORECAST_START, default_location=default_location)
    return rounded(rows.select("subject_id", "ts", "risk_score", "risk_level", "temp", "humidity"), "temp", "humidity")


@query("j5_hourly_forecast", _forecast_sql())
def hourly_forecast(t: Tables):
    return _forecast(t, t.subject_location_short)


# Every fourth subject has not told where it is.
_PLACED = """placed as (select distinct l.subject_id, case when l.subject_id % 4 = 0 then 1 else s.location_id end as location_id
  from log_short l left join subject_location_short s on s.subject_id = l.subject_id), """


@query("j5_hourly_forecast_default_place", _forecast_sql("placed", _PLACED))
def hourly_forecast_default_place(t: Tables):
    return _forecast(t, t.subject_location_short.where("subject_id % 4 <> 0"), default_location=1)
