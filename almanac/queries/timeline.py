"""The dense timeline and its windows."""

from pyspark.sql import functions as F

from ..operators import daily, features, timeseries
from .base import COMBINED, DAILY, FEATURES, FILL_COLUMNS, FILLED, LAG_SQL, ROLL_SQL, TIMELINE, Tables, query, r, rounded, with_tables

TABLES = ("log", "weather_daily", "subject_location")


def timeline_of(t: Tables):
    return daily.dense_timeline(t.log, t.weather_daily, t.subject_location)


def combined_of(t: Tables):
    return features.timeline_weather_join(timeline_of(t), t.weather_daily, t.subject_location)


@query(
    "c1_calendar_left_join",
    with_tables("log", extra=DAILY)
    + "select s.subject_id, s.date, d.pain from (select subject_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date "
    "from log group by subject_id) s left join daily d on s.subject_id = d.subject_id and s.date = d.date",
)
def calendar_left_join(t: Tables):
    days = daily.daily_log_agg(t.log)
    return daily.calendar_left_join(days, daily.subject_bounds(t.log)).select("subject_id", "date", "pain")


@query(
    "e1_dense_timeline",
    with_tables(*TABLES, extra=TIMELINE) + f"select subject_id, date, pain, {r('sleep')} as sleep, {r('activity')} as activity from timeline",
)
def dense_timeline(t: Tables):
    return rounded(timeline_of(t), "sleep", "activity")


@query(
    "c3_timeline_weather_join",
    with_tables(*TABLES, extra=COMBINED)
    + f"select subject_id, date, pain, {r('tmax')} as tmax, {r('pres')} as pres, {r('prcp')} as prcp from combined",
)
def timeline_weather_join(t: Tables):
    return rounded(combined_of(t).select("subject_id", "date", "pain", "tmax", "pres", "prcp"), "tmax", "pres", "prcp")


@query("e4_pain_lags", with_tables(*TABLES, extra=TIMELINE) + f"select subject_id, date, {LAG_SQL} from timeline")
def pain_lags(t: Tables):
    return timeseries.pain_lags(timeline_of(t)).drop("pain", "sleep", "activity")


ROLLS = [f"pain_rolling_mean_{n}" for n in timeseries.ROLLING]


@query(
    "e5_pain_rolling",
    with_tables(*TABLES, extra=TIMELINE)
    + "select subject_id, date, " + ", ".join(f"{r(c)} as {c}" for c in ROLLS) + f" from (select subject_id, date, {ROLL_SQL} from timeline)",
)
def pain_rolling(t: Tables):
    return rounded(timeseries.pain_rolling(timeline_of(t)).drop("pain", "sleep", "activity"), *ROLLS)


@query(
    "e6_weather_fill",
    with_tables(*TABLES, extra=FILLED) + "select subject_id, date, " + ", ".join(f"{r(c)} as {c}" for c in FILL_COLUMNS) + " from filled",
)
def weather_fill(t: Tables):
    return rounded(timeseries.weather_fill(combined_of(t)).select("subject_id", "date", *FILL_COLUMNS), *FILL_COLUMNS)


_W = "over (partition by subject_id order by date)"


@query(
    "e7_pressure_delta",
    with_tables(*TABLES, extra=FILLED)
    + f"select subject_id, date, {r('pres_change')} as pres_change, {r('pres_change_lag1')} as pres_change_lag1 from ("
    f"select subject_id, date, pres - lag(pres) {_W} as pres_change, lag(pres, 1) {_W} - lag(pres, 2) {_W} as pres_change_lag1 from filled)",
)
def pressure_delta(t: Tables):
    rows = timeseries.pressure_delta(timeseries.weather_fill(combined_of(t), ("pres",)))
    return rounded(rows.select("subject_id", "date", "pres_change", "pres_change_lag1"), "pres_change", "pres_change_lag1")


@query(
    "e8_tavg_lag1",
    with_tables(*TABLES, extra=FILLED) + f"select subject_id, date, {r('x')} as tavg_lag1 from (select subject_id, date, lag(tavg) {_W} as x from filled)",
)
def tavg_lag1(t: Tables):
    rows = timeseries.tavg_lag1(timeseries.weather_fill(combined_of(t), ("tavg",)))
    return rounded(rows.select("subject_id", "date", "tavg_lag1"), "tavg_lag1")


@query(
    "e9_warmup_trim",
    with_tables(*TABLES, extra=TIMELINE)
    + f"select subject_id, date, pain from (select *, row_number() {_W} as rn from timeline) where rn > 30",
)
def warmup_trim(t: Tables):
    return timeseries.warmup_trim(timeline_of(t)).select("subject_id", "date", "pain")


RECENT = """recent as (select subject_id, date, arg_max(pain, entry_id) as pain from (
  select *, row_number() over (partition by subject_id order by date desc, entry_id desc) as rn from log) where rn <= 60
  group by subject_id, date),
targets as (select subject_id, cast(unnest(generate_series(min(date) + 1, min(date) + 14, interval 1 day)) as date) as target_date
  from recent group by subject_id)"""


def _at(k: int) -> str:
    return f"coalesce(max(r.pain) filter (where r.date = t.target_date - {k}), 0)"


def _mean(n: int) -> str:
    return f"coalesce(sum(r.pain) filter (where r.date between t.target_date - {n} and t.target_date - 1), 0) / {n}"


E12 = (
    "select t.subject_id, t.target_date, "
    + ", ".join(f"cast({_at(k)} as double) as pain_lag_{k}" for k in timeseries.LAGS)
    + ", "
    + ", ".join(f"{r(_mean(n))} as pain_rolling_mean_{n}" for n in timeseries.ROLLING)
    + " from targets t left join recent r on r.subject_id = t.subject_id group by 1, 2"
)


def inference_targets(t: Tables):
    """Fourteen days from the start of each subject's recent rows."""
    first = daily.recent_rows(t.log.select("subject_id", "entry_id", "date")).groupBy("subject_id").agg(F.min("date").alias("first_day"))
    return first.select(
        "subject_id", F.explode(F.sequence(F.date_add("first_day", 1), F.date_add("first_day", 14))).alias("target_date")
    )


@query("e12_inference_lags", with_tables("log", extra=RECENT) + E12)
def inference_lags(t: Tables):
    return rounded(timeseries.inference_lags(t.log, inference_targets(t)), *ROLLS)


@query(
    "c4_lag_lookup",
    with_tables("log", extra=RECENT)
    + f"select t.subject_id, t.target_date, cast({_at(5)} as double) as pain_5_days_before from targets t "
    "left join recent r on r.subject_id = t.subject_id group by 1, 2",
)
def lag_lookup(t: Tables):
    joined = inference_targets(t).join(timeseries.history_map(t.log), "subject_id", "left")
    value = timeseries.lag_lookup(F.col("history"), F.col("target_date"), 5)
    return joined.select("subject_id", "target_date", value.alias("pain_5_days_before"))


@query(
    "c13_latest_location",
    with_tables("log")
    + "select subject_id, latitude, longitude from (select *, row_number() over (partition by subject_id order by date desc, time desc, entry_id desc) as rn "
    "from log where latitude is not null and longitude is not null) where rn = 1",
)
def latest_location(t: Tables):
    return daily.latest_location(t.log)


@query(
    "e16_sequence_windows",
    with_tables(*TABLES, extra=FEATURES)
    + f"select subject_id, date, seq as pains, {r('pain_log')} as target, {r('pres_sum')} as pres_sum from (select subject_id, date, pain_log, "
    "string_agg(cast(cast(pain as int) as varchar), ',' order by date) over w as seq, sum(pres) over w as pres_sum, count(*) over w as n "
    "from features where pain > 0 window w as (partition by subject_id order by date rows between 7 preceding and 1 preceding)) where n = 7",
)
def sequence_windows(t: Tables):
    rows = timeseries.sequence_windows(features.build_features(combined_of(t)), ("pain", "pres"))
    pains = F.array_join(F.transform("sequence", lambda s: s["pain"].cast("int").cast("string")), ",")
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, s: acc + s["pres"])
    return rounded(rows.select("subject_id", "date", pains.alias("pains"), "target", total.alias("pres_sum")), "target", "pres_sum")


SPLIT = """numbered as (select subject_id, date, row_number() over (partition by subject_id order by date) - 1 as pos,
  count(*) over (partition by subject_id) as n from timeline),
folded as (select n1.*, f.fold, n - (5 - f.fold + 1) * (n // 6) as start, n // 6 as size
  from numbered n1, (select unnest([1, 2, 3, 4, 5]) as fold) f where n // 6 > 0)"""


@query(
    "e18_ts_split",
    with_tables(*TABLES, extra=TIMELINE + ", " + SPLIT)
    + "select subject_id, date, cast(fold as int) as fold, cast(pos as int) as position, case when pos < start then 'train' else 'test' end as role "
    "from folded where pos < start + size",
)
def ts_split(t: Tables):
    return timeseries.ts_split(timeline_of(t)).select("subject_id", "date", "fold", "position", "role")
