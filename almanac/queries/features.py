"""Feature frames, priors, correlations and weights."""

from pyspark.sql import functions as F

from ..operators import correlation, features
from .base import FEATURES, Tables, query, r, rounded, with_tables
from .timeline import RECENT, TABLES, combined_of, inference_targets

PLAIN = ("day_of_week", "month", "pain_binary")
MEASURED = [c for c in features.FEATURES if c not in PLAIN]


def features_of(t: Tables):
    return features.build_features(combined_of(t))


@query(
    "i1_build_features",
    with_tables(*TABLES, extra=FEATURES)
    + "select subject_id, date, pain, cast(day_of_week as int) as day_of_week, cast(month as int) as month, pain_binary, "
    + ", ".join(f"{r(c)} as {c}" for c in [*MEASURED, "pain_log"])
    + " from features",
)
def build_features(t: Tables):
    columns = [*MEASURED, "pain_log"]
    return rounded(features_of(t).select("subject_id", "date", "pain", *PLAIN, *columns), *columns)


_TARGET_WEATHER = """served as (select t.*, s.location_id, w.tmax, w.tmin, w.tavg, w.average_humidity, w.pres
  from targets t join subject_location s on s.subject_id = t.subject_id
    left join weather_daily w on w.location_id = s.location_id and w.date = t.target_date)"""
_I2 = {
    "tdiff": "coalesce(tmax, 25.0) - coalesce(tmin, 15.0)",
    "humid_tavg": "coalesce(average_humidity, 50.0) * coalesce(tavg, 20.0)",
    "tavg_lag1": "coalesce(tavg, 20.0)",
    "pres": "pres",
}


@query(
    "i2_inference_features",
    with_tables("log", "weather_daily", "subject_location", extra=RECENT + ", " + _TARGET_WEATHER)
    + "select s.subject_id, s.target_date, "
    + ", ".join(f"{r('any_value(' + v + ')')} as {k}" for k, v in _I2.items())
    + ", cast(coalesce(max(r.pain) filter (where r.date = s.target_date - 1), 0) as double) as pain_lag_1, "
    "2.0::double as sleep, 1.5::double as activity, 0.0::double as pres_change_lag1, cast(isodow(s.target_date) - 1 as int) as day_of_week "
    "from served s left join recent r on r.subject_id = s.subject_id group by 1, 2",
)
def inference_features(t: Tables):
    targets = inference_targets(t).join(t.subject_location, "subject_id")
    rows = features.inference_features(t.log, targets, t.weather_daily)
    return rounded(
        rows.select("subject_id", "target_date", *_I2, "pain_lag_1", "sleep", "activity", "pres_change_lag1", "day_of_week"), *_I2
    )


# A past day inside every subject's history: serving it must give what training saw.
PARITY_DAY = "2001-03-14"
_SERVED = [c for c in MEASURED if c not in ("sleep", "activity")]


@query(
    "i2_serving_parity",
    with_tables(*TABLES, extra=FEATURES)
    + "select subject_id, date as target_date, cast(day_of_week as int) as day_of_week, cast(month as int) as month, "
    + ", ".join(f"{r(c)} as {c}" for c in _SERVED)
    + f" from features where date = date '{PARITY_DAY}' and subject_id in (select subject_id from log where date >= date '{PARITY_DAY}')",
)
def serving_parity(t: Tables):
    logging = t.log.where(F.col("date") >= F.lit(PARITY_DAY).cast("date")).select("subject_id").distinct()
    targets = logging.withColumn("target_date", F.lit(PARITY_DAY).cast("date"))
    rows = features.features_as_of(t.log, t.weather_daily, t.subject_location, targets, F.date_sub(F.lit(PARITY_DAY).cast("date"), 1))
    return rounded(rows.select("subject_id", "target_date", "day_of_week", "month", *_SERVED), *_SERVED)


def _pair_sql(value: str) -> str:
    return " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, count(*) filter (where {a} is not null and {b} is not null) as n_pairs, "
        f"{value.format(f'abs(corr({a}, {b}))')} as abs_r from features"
        for a, b in correlation.pair_names(features.FEATURES)
    )


@query("i3_correlation_pairs", with_tables(*TABLES, extra=FEATURES) + _pair_sql(r("{}")))
def correlation_pairs(t: Tables):
    return rounded(correlation.correlation_pairs(features_of(t).select(*features.FEATURES), features.FEATURES), "abs_r")


# The greedy pass walks the strong pairs in name order and carries what is dropped so far.
_GREEDY = f"""pairs as ({_pair_sql('{}')}),
nulls as ({" union all ".join(f"select '{c}' as feature, count(*) - count({c}) as k, count(*) as n from features" for c in features.FEATURES)}),
strong as (select row_number() over (order by feature_a, feature_b) as i, feature_a as a, feature_b as b, x.k as ka, y.k as kb from pairs
  join nulls x on x.feature = feature_a join nulls y on y.feature = feature_b where isfinite(abs_r) and round(abs_r, 12) > 0.9 and x.n >= 30),
walk(i, dropped) as (select cast(0 as bigint), cast([] as varchar[]) union all
  select s.i, case when list_contains(dropped, a) or list_contains(dropped, b) then dropped
    else list_append(dropped, case when ka > kb or (ka = kb and a > b) then a else b end) end
  from walk join strong s on s.i = walk.i + 1)"""


@query(
    "i4_correlation_filter",
    "with recursive" + with_tables(*TABLES, extra=FEATURES + ",\n" + _GREEDY).removeprefix("with")
    + "select feature, not list_contains((select arg_max(dropped, i) from walk), feature) as is_kept from nulls",
)
def correlation_filter(t: Tables):
    kept, dropped = correlation.correlation_filter(features_of(t), features.FEATURES)
    rows = [(c, True) for c in kept] + [(c, False) for c in dropped]
    return t.spark.createDataFrame(rows, "feature string, is_kept boolean")


@query(
    "i5_sample_weights",
    with_tables(*TABLES, extra=FEATURES)
    + "select subject_id, date, cast(case when date > max(date) over (partition by subject_id) - 365 then 3.0 else 1.0 end as double) as sample_weight from features",
)
def sample_weights(t: Tables):
    return features.sample_weights(features_of(t)).select("subject_id", "date", "sample_weight")


@query(
    "i6_class_weights",
    with_tables(*TABLES, extra=FEATURES)
    + f"select pain_binary, count(*) as n_class, {r('sum(count(*)) over () / (2.0 * count(*))')} as class_weight from features group by pain_binary",
)
def class_weights(t: Tables):
    return rounded(features.class_weights(features_of(t)), "class_weight")


def prior_sql(log: str) -> str:
    return f"""hours as (select unnest(generate_series(0, 23)) as hour),
counts as (select subject_id, try_cast(split_part(time, ':', 1) as int) as hour, count(*) as n from {log}
  where pain > 0 and try_cast(split_part(time, ':', 1) as int) is not null group by 1, 2),
shares as (select s.subject_id, h.hour, coalesce(c.n, 0) / t.total as p from (select distinct subject_id from {log}) s
  cross join hours h left join counts c on c.subject_id = s.subject_id and c.hour = h.hour
  left join (select subject_id, sum(n) as total from counts group by subject_id) t on t.subject_id = s.subject_id),
smooth as (select a.subject_id, a.hour, b.p * 0.2 + a.p * 0.6 + c.p * 0.2 as p from shares a
  join shares b on b.subject_id = a.subject_id and b.hour = (a.hour + 23) % 24
  join shares c on c.subject_id = a.subject_id and c.hour = (a.hour + 1) % 24),
hour_priors as (select subject_id, cast(hour as int) as hour,
  coalesce(p / nullif(max(p) over (partition by subject_id), 0) * 0.8, 0.1) as prior from smooth)"""


@query("e13_circadian_prior", with_tables("log_short", extra=prior_sql("log_short")) + f"select subject_id, hour, {r('prior')} as prior from hour_priors")
def circadian_prior(t: Tables):
    return rounded(features.circadian_prior(t.log_short), "prior")
