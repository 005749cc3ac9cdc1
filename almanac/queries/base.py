"""Query registration, table access and the SQL fragments of the checks."""

from __future__ import annotations

import string
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import round_half_up
from .bindings import AS_OF, BASE, DERIVED


@dataclass(frozen=True)
class Query:
    run: Callable[["Tables"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


class Tables:
    """The supplied tables and the ones bound to them, read on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory, self._seen = spark, directory.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
            elif name in DERIVED:
                text = DERIVED[name]
                bound = self.spark.sql(text, **{n: getattr(self, n) for n in _inputs(text)})
                self._seen[name] = bound.select(*[_wall_clock(bound, f.name) for f in bound.schema])
            else:
                raise AttributeError(name)
        return self._seen[name]


def _wall_clock(df: DataFrame, name: str):
    """``date_trunc`` returns zoned timestamps; the tables hold wall-clock ones."""
    zoned = df.schema[name].dataType == T.TimestampType()
    return F.col(name).cast("timestamp_ntz") if zoned else F.col(name)


def _inputs(text: str) -> set[str]:
    return {field for _, field, _, _ in string.Formatter().parse(text) if field}


def with_tables(*names: str, extra: str = "") -> str:
    """``with`` clause defining the derived tables a check needs, in dependency order."""
    done: dict[str, str] = {}

    def add(name):
        if name in done or name in BASE:
            return
        inputs = _inputs(DERIVED[name])
        for other in sorted(inputs):
            add(other)
        done[name] = DERIVED[name].format(**{n: n for n in inputs})

    for name in names:
        add(name)
    clauses = [f"{name} as ({text})" for name, text in done.items()]
    if extra:
        clauses.append(extra)
    return "with " + ",\n".join(clauses) + "\n"


def r(expression: str, digits: int = 6) -> str:
    """The rounding rule of :func:`round_half_up`, as SQL text."""
    scale = 10**digits
    return f"(floor(({expression})*{scale}+0.500000001)/{scale})"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c).cast("double"), digits) for c in columns})


DAY = f"date '{AS_OF}'"
MONTHS_BACK_12 = f"cast({DAY} - interval 12 month as date)"

# Shared check fragments -----------------------------------------------------------------

LEGACY_NAMES = "list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"
JSON_NAMES = (
    "case when json_valid({c}) then case when json_type({c}) = 'ARRAY' then "
    "list_filter(json_extract_string({c}, '$[*].name'), lambda x: x is not null) else [] end else [] end"
)


def legacy_names(column: str) -> str:
    return f"coalesce({LEGACY_NAMES.format(c=column)}, [])"


def json_names(column: str) -> str:
    return f"coalesce({JSON_NAMES.format(c=column)}, [])"


EPISODE_DAYS = "days as (select distinct subject_id, date from log where pain > 0)"
FIRST_PER_DAY = """first_rows as (
  select * from (select *, row_number() over (partition by subject_id, date order by time desc, entry_id) as rn
    from log where pain > 0) where rn = 1)"""

DAILY = """daily as (
  select subject_id, date, cast(max(pain) as double) as pain, avg(try_cast(sleep as double)) as sleep,
    avg(try_cast(activity as double)) as activity
  from log group by subject_id, date)"""

# Dense calendar over log and weather bounds, built the textbook way.
TIMELINE = DAILY + """,
bounds as (
  select subject_id, min(lo) as lo, max(hi) as hi from (
    select subject_id, min(date) as lo, max(date) as hi from log group by subject_id
    union all
    select l.subject_id, min(w.date), max(w.date) from subject_location l join weather_daily w using (location_id)
      where l.subject_id in (select subject_id from log) group by l.subject_id)
  group by subject_id),
spine as (
  select subject_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date from bounds),
timeline as (
  select s.subject_id, s.date, coalesce(d.pain, 0.0) as pain, d.sleep, d.activity
  from spine s left join daily d on s.subject_id = d.subject_id and s.date = d.date)"""

COMBINED = TIMELINE + """,
combined as (
  select t.*, l.location_id, w.tavg, w.tmin, w.tmax, w.pres, w.prcp, w.wspd, w.tsun, w.average_humidity, w.midday_humidity
  from timeline t left join subject_location l on t.subject_id = l.subject_id
    left join weather_daily w on w.location_id = l.location_id and w.date = t.date)"""


def _fill(column: str) -> str:
    order = "partition by subject_id order by date"
    return (
        f"coalesce(last_value({column} ignore nulls) over ({order} rows between unbounded preceding and current row), "
        f"first_value({column} ignore nulls) over ({order} rows between current row and unbounded following)) as {column}"
    )


FILL_COLUMNS = ("tavg", "tmin", "tmax", "prcp", "wspd", "pres", "tsun")
FILLED = COMBINED + """,
filled as (
  select subject_id, date, pain, sleep, activity, average_humidity, midday_humidity,
    """ + ",\n    ".join(_fill(c) for c in FILL_COLUMNS) + """
  from combined)"""

_W = "over (partition by subject_id order by date)"


def rolling(n: int, column: str = "pain") -> str:
    frame = f"over (partition by subject_id order by date rows between {n} preceding and 1 preceding)"
    return f"case when count({column}) {frame} = {n} then avg({column}) {frame} end"


LAG_SQL = ", ".join(f"lag(pain, {k}) {_W} as pain_lag_{k}" for k in (1, 2, 3, 7))
ROLL_SQL = ", ".join(f"{rolling(n)} as pain_rolling_mean_{n}" for n in (3, 7, 30))

FEATURES = FILLED + f""",
derived as (
  select * exclude (tavg), (tmax + tmin) / 2 as tavg, tmax - tmin as tdiff,
    coalesce(average_humidity, 0.0) * ((tmax + tmin) / 2) as humid_tavg from filled),
lagged as (
  select *, {LAG_SQL}, {ROLL_SQL},
    pres - lag(pres) {_W} as pres_change, lag(pres, 1) {_W} - lag(pres, 2) {_W} as pres_change_lag1,
    lag(tavg) {_W} as tavg_lag1, row_number() {_W} as day_number
  from derived),
features as (
  select *, isodow(date) - 1 as day_of_week, month(date) as month,
    sin(2*pi()*(isodow(date)-1)/7) as day_of_week_sin, cos(2*pi()*(isodow(date)-1)/7) as day_of_week_cos,
    sin(2*pi()*month(date)/12) as month_sin, cos(2*pi()*month(date)/12) as month_cos,
    cast(pain > 0 as int) as pain_binary, ln(1 + pain) as pain_log
  from lagged where day_number > 30)"""

SETTINGS = """settings as (
  select subject_id, key, arg_max(value, version) as value from settings_changes group by subject_id, key),
priors as (
  select subject_id,
    coalesce(try_cast(max(value) filter (where key = 'baseline_risk') as double), 0.1) as baseline_risk,
    coalesce(try_cast(max(value) filter (where key = 'weather_sensitivity') as double), 0.5) as weather_sensitivity,
    coalesce(try_cast(max(value) filter (where key = 'sleep_sensitivity') as double), 0.5) as sleep_sensitivity,
    coalesce(try_cast(max(value) filter (where key = 'strain_sensitivity') as double), 0.5) as strain_sensitivity,
    coalesce(max(value) filter (where key = 'temp_unit'), 'C') as temp_unit,
    lower(coalesce(max(value) filter (where key = 'force_heuristic_mode'), 'false')) = 'true' as force_heuristic_mode
  from settings group by subject_id)"""


def weather_score(delta: str, full: float, prcp: str, humidity: str) -> str:
    return (
        f"least(least(abs(coalesce({delta}, 0.0)) / {full}, 1.0) "
        f"+ case when coalesce({prcp}, 0.0) > 0.5 then 0.3 else 0.0 end "
        f"+ case when coalesce({humidity}, 50.0) > 70 then 0.2 else 0.0 end, 1.0)"
    )


def rules_level(p: str) -> str:
    return f"case when {p} < 0.3 then 'Low' when {p} < 0.7 then 'Moderate' else 'High' end"
