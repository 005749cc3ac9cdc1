"""Rule scores, calibration and forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import risk_level_calibrated, risk_level_model, risk_level_rules, round_half_up
from ..operators.daily import HISTORY_ROWS, recent_rows
from ..operators.features import NO_HISTORY_PRIOR, circadian_prior, inference_features
from ..operators.skew import own_shuffle
from ..operators.weather import pressure_change_3h
from ..schemas import PRIOR_DEFAULTS, TEMP_UNIT_DEFAULT

MAX_SCALE = 2.5
SCORE_CAP = 99.0
DEFAULT_HUMIDITY = 50.0


# --- A10: settings -----------------------------------------------------------------


def scan_settings(settings: DataFrame, numeric_only: bool = True) -> DataFrame:
    """A10: key/value rows -> one typed row per subject, defaults filled in.

    A prior that is not a number is skipped, so its default applies.
    """
    keys = [*PRIOR_DEFAULTS, "temp_unit", "force_heuristic_mode"]
    wide = settings.groupBy("subject_id").pivot("key", keys).agg(F.first("value", ignorenulls=True))
    priors = [F.coalesce(F.col(k).try_cast("double"), F.lit(v)).alias(k) for k, v in PRIOR_DEFAULTS.items()]
    return wide.select(
        "subject_id",
        *priors,
        F.coalesce("temp_unit", F.lit(TEMP_UNIT_DEFAULT)).alias("temp_unit"),
        (F.lower(F.coalesce("force_heuristic_mode", F.lit("false"))) == "true").alias("force_heuristic_mode"),
    )


def with_priors(df: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Attach each subject's priors; subjects without settings get the defaults."""
    if priors is None:
        return df.withColumns({k: F.lit(v) for k, v in PRIOR_DEFAULTS.items()})
    joined = df.join(priors.select("subject_id", *PRIOR_DEFAULTS), "subject_id", "left")
    return joined.fillna(PRIOR_DEFAULTS)


# --- J1: daily rules -----------------------------------------------------------------


@dataclass(frozen=True)
class DailyInputs:
    """Columns the daily rules read; a missing reading means the neutral value."""

    pressure_change: Column
    prcp: Column
    humidity: Column
    sleep_debt: Column
    strain: Column
    yesterday_pain: Column


def _clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def _weather_score(pressure_delta: Column, full_scale: float, prcp: Column, humidity: Column) -> Column:
    """Share of weather stress: pressure up to 1, rain adds 0.3, damp air 0.2, capped at 1."""
    return F.least(
        F.least(F.abs(F.coalesce(pressure_delta, F.lit(0.0))) / full_scale, F.lit(1.0))
        + F.when(F.coalesce(prcp, F.lit(0.0)) > 0.5, 0.3).otherwise(0.0)
        + F.when(F.coalesce(humidity, F.lit(DEFAULT_HUMIDITY)) > 70, 0.2).otherwise(0.0),
        F.lit(1.0),
    )


def heuristic_daily(df: DataFrame, inputs: DailyInputs) -> DataFrame:
    """Add probability (raw and rounded), level and components.

    Needs the prior columns of :func:`with_priors`.
    """
    base = F.col("baseline_risk")
    weather = _weather_score(inputs.pressure_change, 8.0, inputs.prcp, inputs.humidity)
    sleep = F.least(F.coalesce(inputs.sleep_debt, F.lit(0.0)) / 4.0, F.lit(1.0))
    strain = F.coalesce(inputs.strain, F.lit(0.0)) / 10.0
    boost = F.when(F.coalesce(inputs.yesterday_pain, F.lit(0.0)) > 2.0, base * 0.8).otherwise(0.0)
    raw = _clamp(
        base
        + weather * F.col("weather_sensitivity") * 0.5
        + sleep * F.col("sleep_sensitivity") * 0.3
        + strain * F.col("strain_sensitivity") * 0.3
        + boost
    )
    return df.withColumns({"raw_probability": raw, "weather_raw": weather, "boost_raw": boost}).select(
        *df.columns,
        "raw_probability",
        round_half_up(F.col("raw_probability"), 2).alias("probability"),
        risk_level_rules(F.col("raw_probability")).alias("risk_level"),
        round_half_up(F.col("weather_raw"), 2).alias("weather_contribution"),
        round_half_up(F.col("boost_raw"), 2).alias("cluster_boost"),
    )


def daily_risk(timeline: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Rule risk of every day of a timeline that carries ``pain_lag_1`` and weather."""

    def column(name: str, missing: float) -> Column:
        return F.col(name) if name in timeline.columns else F.lit(missing)

    inputs = DailyInputs(
        pressure_change=column("pres_change", 0.0),
        prcp=column("prcp", 0.0),
        humidity=column("average_humidity", DEFAULT_HUMIDITY),
        sleep_debt=F.lit(0.0),
        strain=F.lit(0.0),
        yesterday_pain=F.col("pain_lag_1"),
    )
    return heuristic_daily(with_priors(timeline, priors), inputs)


# --- J2, J3: hourly rules ------------------------------------------------------------


def medication_shield(hours: Column) -> Column:
    """0.1 within two hours of a dose, rising evenly to 1 at six hours; 1 without a dose."""
    return (
        F.when(hours < 2.0, 0.1)
        .when(hours < 6.0, F.lit(0.1) + (hours - 2.0) * 0.225)
        .otherwise(1.0)
    )


def heuristic_hourly(df: DataFrame, recency: Column | None = None) -> DataFrame:
    """Score each hour from weather and the circadian ``prior`` column.

    Needs ``pressure_change_3h``, ``precipitation``, ``relative_humidity_2m``, ``prior``
    and ``weather_sensitivity``.
    """
    weather = (
        _weather_score(F.col("pressure_change_3h"), 3.0, F.col("precipitation"), F.col("relative_humidity_2m"))
        * F.col("weather_sensitivity")
    )
    circadian = F.col("prior")
    mixed = weather * 0.6 + circadian * 0.4 + F.when((weather > 0.5) & (circadian > 0.5), 0.2).otherwise(0.0)
    factor = F.lit(1.0) if recency is None else medication_shield(recency)
    return df.withColumns({"raw_probability": _clamp(mixed * factor), "weather_raw": weather, "factor_raw": factor}).select(
        *df.columns,
        "raw_probability",
        round_half_up(F.col("raw_probability"), 2).alias("probability"),
        risk_level_rules(F.col("raw_probability")).alias("risk_level"),
        round_half_up(F.col("weather_raw"), 2).alias("heuristic_weather"),
        round_half_up(F.col("prior"), 2).alias("circadian_risk"),
        round_half_up(F.col("factor_raw"), 2).alias("mitigation_factor"),
    )


def medication_recency(hours: DataFrame, doses: DataFrame) -> DataFrame:
    """Hours since the subject's last dose at or before each ``ts``.

    Doses are first reduced to the latest one per subject and following full hour, so
    the as-of window holds at most one dose row per hour however many were logged.
    ``hours.ts`` must be full hours.
    """
    full_hour = F.date_trunc("hour", F.col("dose_ts")).cast("timestamp_ntz")
    visible = F.when(full_hour == F.col("dose_ts"), full_hour).otherwise(full_hour + F.expr("interval 1 hour"))
    reduced = (
        doses.groupBy("subject_id", visible.alias("ts"))
        .agg(F.max("dose_ts").alias("dose_ts"))
        .withColumn("is_hour", F.lit(False))
    )
    asked = hours.select("subject_id", "ts").withColumns(
        {"dose_ts": F.lit(None).cast("timestamp_ntz"), "is_hour": F.lit(True)}
    )
    w = Window.partitionBy("subject_id").orderBy("ts", "is_hour").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        asked.unionByName(reduced)
        .withColumn("last_dose", F.last("dose_ts", ignorenulls=True).over(w))
        .where("is_hour")
    )
    seconds = F.timestamp_diff("SECOND", F.col("last_dose"), F.col("ts"))
    return last.select("subject_id", "ts", "last_dose", (seconds / 3600.0).alias("recency_hours"))


def hour_prior_join(hours: DataFrame, priors: DataFrame) -> DataFrame:
    """Circadian prior of the hour; subjects without history get 0.1."""
    return (
        hours.withColumn("hour", F.hour("ts"))
        .join(priors, ["subject_id", "hour"], "left")
        .withColumn("prior", F.coalesce("prior", F.lit(NO_HISTORY_PRIOR)))
    )


def daily_anchor_join(hours: DataFrame, daily: DataFrame) -> DataFrame:
    """C11: the daily score (0-100) of each hour's date; missing means no scaling."""
    return hours.withColumn("date", F.to_date("ts")).join(
        daily.select("subject_id", "date", "daily_score"), ["subject_id", "date"], "left"
    )


def calibrate_hourly(scored: DataFrame) -> DataFrame:
    """Lift a day's hours to its daily score.

    Only when the daily score is above 30 and above the day's peak; the factor stays
    1 for peaks up to 5 and is capped at 2.5. Lifted scores stop at 99 and get a level
    of their own. Windows are (subject, date): at most 24 rows.
    """
    peak = F.max("risk_score").over(Window.partitionBy("subject_id", "date"))
    factor = F.least(F.when(peak > 5, F.col("daily_score") / peak).otherwise(1.0), F.lit(MAX_SCALE))
    lift = F.coalesce((F.col("daily_score") > 30.0) & (F.col("daily_score") > peak), F.lit(False))
    lifted = F.least(F.col("risk_score") * F.col("factor"), F.lit(SCORE_CAP))
    return (
        scored.withColumn("factor", F.when(lift, factor))
        .withColumns(
            {
                "risk_level": F.when(F.col("factor").isNotNull(), risk_level_calibrated(lifted)).otherwise(F.col("risk_level")),
                "risk_score": F.when(F.col("factor").isNotNull(), round_half_up(lifted, 1)).otherwise(F.col("risk_score")),
            }
        )
        .drop("factor")
    )


def hourly_scores(
    hours: DataFrame, log: DataFrame, subject_location: DataFrame, recency: DataFrame | None = None, history_rows: int = HISTORY_ROWS
) -> DataFrame:
    """J2 over all hours of each subject's location, with default sensitivities.

    The hour-of-day prior counts each subject's last ``history_rows`` entries.
    """
    history = recent_rows(log.select("subject_id", "entry_id", "date", "time", "pain"), history_rows)
    rows = own_shuffle(pressure_change_3h(hours), "location_id").join(subject_location, "location_id")
    rows = hour_prior_join(rows, circadian_prior(history)).withColumn(
        "weather_sensitivity", F.lit(PRIOR_DEFAULTS["weather_sensitivity"])
    )
    if recency is None:
        scored = heuristic_hourly(rows)
    else:
        scored = heuristic_hourly(
            rows.join(recency.select("subject_id", "ts", "recency_hours"), ["subject_id", "ts"], "left"),
            F.col("recency_hours"),
        )
    return scored.withColumn("risk_score", round_half_up(F.col("probability") * 100, 1))


def with_default_place(log: DataFrame, subject_location: DataFrame, default_location: int) -> DataFrame:
    """The place of every subject that has one, and the default one for subjects that only have a log."""
    subjects = log.select("subject_id").distinct().join(subject_location, "subject_id", "full")
    return subjects.select("subject_id", F.coalesce("location_id", F.lit(default_location)).alias("location_id"))


def hourly_forecast(
    hours, log, subject_location, daily, start, n_hours: int = 24, recency=None, history_rows: int = HISTORY_ROWS, default_location: int | None = None
) -> DataFrame:
    """``n_hours`` scored hours from ``start``, calibrated against the daily scores.

    With a ``default_location``, subjects of the log without a place get the weather there; without
    one they get no rows.

    Only the hours from the day before on are read, so the bound reaches the scan of a stored
    table; pressure changes look back inside that span.
    """
    begin = F.date_trunc("hour", F.lit(start).cast("timestamp_ntz")).cast("timestamp_ntz")
    day_before = F.date_trunc("day", begin).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(1))
    end = begin + F.make_dt_interval(hours=F.lit(n_hours))
    span = hours.where((F.col("ts") >= day_before) & (F.col("ts") < end))
    if default_location is not None:
        subject_location = with_default_place(log, subject_location, default_location)
    scored = hourly_scores(span, log, subject_location, recency, history_rows)
    window = scored.where((F.col("ts") >= begin) & (F.col("ts") < end))
    return calibrate_hourly(daily_anchor_join(window, daily)).select(
        "subject_id",
        "ts",
        "risk_score",
        "risk_level",
        F.col("temperature_2m").alias("temp"),
        F.col("relative_humidity_2m").alias("humidity"),
        "heuristic_weather",
        "circadian_risk",
        "mitigation_factor",
    )


# --- J6, J7: daily predictions ---------------------------------------------------------


def rules_prediction(features: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """The rule branch of J6: percent probability, level, no severity."""
    inputs = DailyInputs(
        F.col("pres_change"), F.col("prcp"), F.col("average_humidity"), F.lit(0.0), F.lit(0.0), F.col("pain_lag_1")
    )
    return heuristic_daily(with_priors(features, priors), inputs).select(
        "subject_id",
        "target_date",
        round_half_up(F.col("probability") * 100, 1).alias("probability"),
        "risk_level",
        F.lit(0.0).alias("predicted_pain"),
        F.lit("Heuristic").alias("source"),
        "weather_contribution",
        "cluster_boost",
    )


def model_prediction(features: DataFrame, model) -> DataFrame:
    """The model branch of J6; severity is 0 unless the probability exceeds 0.2."""
    scored = model.transform(features)
    p = F.col("episode_probability")
    return scored.select(
        "subject_id",
        "target_date",
        round_half_up(p * 100, 1).alias("probability"),
        risk_level_model(p).alias("risk_level"),
        F.when(p > 0.2, round_half_up(F.col("severity"), 1)).otherwise(0.0).alias("predicted_pain"),
        F.lit("ML").alias("source"),
        F.lit(None).cast("double").alias("weather_contribution"),
        F.lit(None).cast("double").alias("cluster_boost"),
    )


def predict_day(features: DataFrame, settings: DataFrame | None = None, model=None, history_days: DataFrame | None = None, min_history: int = 0) -> DataFrame:
    """Rules for subjects that force them (or lack history), else the model.

    Without a model every subject gets rules.
    """
    if model is None:
        return rules_prediction(features, settings)
    choice = features
    by_rules = F.lit(False)
    if settings is not None:
        choice = choice.join(settings.select("subject_id", "force_heuristic_mode"), "subject_id", "left")
        by_rules = by_rules | F.coalesce("force_heuristic_mode", F.lit(False))
    if history_days is not None and min_history > 0:
        choice = choice.join(history_days.select("subject_id", "n_days"), "subject_id", "left")
        by_rules = by_rules | (F.coalesce("n_days", F.lit(0)) < min_history)
    choice = choice.withColumn("by_rules", by_rules)
    ruled = rules_prediction(choice.where("by_rules"), settings)
    return ruled.unionByName(model_prediction(choice.where(~F.col("by_rules")), model))


def forecast_targets(subjects: DataFrame, start, days: int = 7) -> DataFrame:
    """One row per subject and forecast day."""
    first = F.lit(start).cast("date")
    return subjects.withColumn("target_date", F.explode(F.sequence(first, F.date_add(first, days - 1))))


def weekly_forecast(log, subjects: DataFrame, weather: DataFrame | None, start, settings=None, model=None) -> DataFrame:
    """Seven days predicted independently from the same recent history."""
    features = inference_features(log, forecast_targets(subjects, start), weather)
    return predict_day(features, settings, model).select(
        "subject_id",
        F.col("target_date").alias("date"),
        F.col("probability").alias("risk_probability"),
        "risk_level",
        "predicted_pain",
    )
