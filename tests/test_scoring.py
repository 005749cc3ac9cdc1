import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.plans import scoring

from helpers import rows

D = dt.date
DEFAULTS = dict(baseline_risk=0.1, weather_sensitivity=0.5, sleep_sensitivity=0.5, strain_sensitivity=0.5)
QUIET = dict(dp=0.0, prcp=0.0, hum=50.0, debt=0.0, strain=0.0, yesterday=0.0)


def daily(spark, priors=None, **inputs):
    values = {**DEFAULTS, **(priors or {}), **QUIET, **inputs}
    df = spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))
    c = F.col
    return scoring.heuristic_daily(df, scoring.DailyInputs(c("dp"), c("prcp"), c("hum"), c("debt"), c("strain"), c("yesterday"))).first()


WEATHER = dict(baseline_risk=0.1, weather_sensitivity=1.0)


@pytest.mark.parametrize(
    "priors, inputs, probability, level",
    [
        ({}, {}, 0.10, "Low"),
        (WEATHER, dict(dp=-10), 0.60, "Moderate"),
        (WEATHER, dict(prcp=1.0), 0.25, "Low"),
        (WEATHER, dict(hum=80), 0.20, "Low"),
        (dict(sleep_sensitivity=1.0), dict(debt=4), 0.40, "Moderate"),
        (dict(strain_sensitivity=1.0), dict(strain=10), 0.40, "Moderate"),
        ({}, dict(yesterday=5), 0.18, "Low"),
        (dict(baseline_risk=0.5), dict(yesterday=5), 0.90, "High"),
        (dict(baseline_risk=1.0, weather_sensitivity=9.0), dict(dp=99, yesterday=9, strain=99), 1.0, "High"),
    ],
)
def test_daily_rules(spark, priors, inputs, probability, level):
    got = daily(spark, priors, **inputs)
    assert (got["probability"], got["risk_level"]) == (pytest.approx(probability), level)


@pytest.mark.parametrize("hours, factor", [(1.9, 0.1), (2.0, 0.1), (4.0, 0.55), (6.0, 1.0), (None, 1.0)])
def test_medication_shield(spark, hours, factor):
    assert spark.range(1).select(scoring.medication_shield(F.lit(hours).cast("double"))).first()[0] == pytest.approx(factor)


@pytest.mark.parametrize(
    "dp, prior, sensitivity, expected",
    [(0.0, 0.1, 0.5, 0.04), (3.0, 0.1, 0.5, 0.34), (-9.0, 0.8, 1.0, 1.0), (1.5, 0.6, 1.0, 0.54), (1.8, 0.6, 1.0, 0.8)],
)
def test_hourly_rules(spark, dp, prior, sensitivity, expected):
    df = spark.createDataFrame(
        [(dp, 0.0, 50.0, prior, sensitivity)],
        "pressure_change_3h double, precipitation double, relative_humidity_2m double, prior double, weather_sensitivity double",
    )
    assert scoring.heuristic_hourly(df).first()["raw_probability"] == pytest.approx(expected)


@pytest.mark.parametrize(
    "scores, anchor, expected",
    [
        ([20.0, 10.0], 80.0, [(50.0, "Moderate"), (25.0, "Low")]),
        ([20.0], 30.0, [(20.0, "Low")]),
        ([5.0], 80.0, [(5.0, "Low")]),
        ([50.0], 40.0, [(50.0, "Low")]),
        ([60.0, 59.0], 100.0, [(99.0, "High"), (98.3, "High")]),
        ([20.0], None, [(20.0, "Low")]),
    ],
)
def test_calibration(spark, scores, anchor, expected):
    data = [(1, D(2024, 1, 1), i, s, "Low", anchor) for i, s in enumerate(scores)]
    df = spark.createDataFrame(data, "subject_id long, date date, i int, risk_score double, risk_level string, daily_score double")
    out = scoring.calibrate_hourly(df).orderBy("i").collect()
    assert [(r.risk_score, r.risk_level) for r in out] == expected


def test_recency_sees_only_earlier_doses(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    hours = spark.createDataFrame([(1, t(h)) for h in range(0, 6)], "subject_id long, ts timestamp_ntz")
    doses = spark.createDataFrame([(1, t(1)), (1, t(2, 15)), (1, t(2, 30)), (2, t(0))], "subject_id long, dose_ts timestamp_ntz")
    out = scoring.medication_recency(hours, doses).orderBy("ts").collect()
    assert [r.recency_hours for r in out] == [None, 0.0, 1.0, 0.5, 1.5, 2.5]


def settings(spark, *values):
    return spark.createDataFrame([(1, k, v) for k, v in values], "subject_id long, key string, value string")


def test_settings_defaults_and_bad_numbers(spark):
    out = scoring.scan_settings(settings(spark, ("weather_sensitivity", "0.9"), ("baseline_risk", "high"), ("force_heuristic_mode", "True"), ("x", "y")))
    assert out.first().asDict() == {
        "subject_id": 1, **DEFAULTS, "weather_sensitivity": 0.9, "temp_unit": "C", "force_heuristic_mode": True,
    }


class FixedModel:
    """Stands in for a trained model: everyone gets the same scores."""

    def __init__(self, probability, severity):
        self.values = {"episode_probability": F.lit(probability), "severity": F.lit(severity)}

    def transform(self, df):
        return df.withColumns(self.values)


def serving(spark, subjects):
    return spark.createDataFrame(
        [(s, D(2024, 1, 2), 0.0, 0.0, 50.0, 0.0) for s in subjects],
        "subject_id long, target_date date, pres_change double, prcp double, average_humidity double, pain_lag_1 double",
    )


def test_prediction_source_per_subject(spark):
    forced = scoring.scan_settings(settings(spark, ("force_heuristic_mode", "true")))
    out = scoring.predict_day(serving(spark, [1, 2]), forced, FixedModel(0.65, 4.26))
    assert rows(out, "subject_id", "probability", "risk_level", "predicted_pain", "source") == [
        (1, 10.0, "Low", 0.0, "Heuristic"), (2, 65.0, "High", 4.3, "ML"),
    ]
    low = scoring.predict_day(serving(spark, [2]), None, FixedModel(0.2, 4.26))
    assert rows(low, "risk_level", "predicted_pain") == [("Low", 0.0)]
    days = spark.createDataFrame([(2, 59)], "subject_id long, n_days long")
    short = scoring.predict_day(serving(spark, [2]), None, FixedModel(0.9, 1.0), days, min_history=60)
    assert rows(short, "source") == [("Heuristic",)]


def test_weekly_forecast_has_seven_days(make_log, spark):
    log = make_log([{"date": "2024-01-01", "pain": 5}])
    subjects = spark.createDataFrame([(1, 1)], "subject_id long, location_id long")
    out = scoring.weekly_forecast(log, subjects, None, "2024-01-02")
    assert out.columns == ["subject_id", "date", "risk_probability", "risk_level", "predicted_pain"]
    assert [r.risk_probability for r in out.orderBy("date").collect()] == [18.0] + [10.0] * 6


def test_model_branch_equals_the_exported_expression(spark):
    """Forced rules, too little history and the model side by side."""
    import math

    from almanac.plans import training

    data = [(1, D(2022, 1, 1) + dt.timedelta(days=i), float(i % 5), int(i % 5 > 0), math.log1p(i % 5), float(i % 5) + math.sin(i), 1000.0 + i % 9) for i in range(90)]
    schema = "subject_id long, date date, pain double, pain_binary int, pain_log double, pain_lag_1 double, pres_change double"
    model = training.train_hurdle(spark.createDataFrame(data, schema), training.TrainingConfig(max_iter=4, max_depth=3, features=("pain_lag_1", "pres_change")))
    asked = [(s, D(2024, 1, 2), 0.0 if s % 2 else None, 0.0, 50.0, float(s)) for s in range(1, 9)]
    features = spark.createDataFrame(asked, "subject_id long, target_date date, pres_change double, prcp double, average_humidity double, pain_lag_1 double")
    forced = scoring.scan_settings(settings(spark, ("force_heuristic_mode", "true")))  # subject 1
    history = spark.createDataFrame([(s, 10 if s == 2 else 100) for s in range(1, 8)], "subject_id long, n_days long")  # 2 too short, 8 unknown
    out = {r.subject_id: r for r in scoring.predict_day(features, forced, model, history, min_history=60).collect()}
    assert {s for s, r in out.items() if r.source == "Heuristic"} == {1, 2, 8} and len(out) == 8
    sql = training.export_sql(model)
    for r in features.select("subject_id", *[F.expr(e).alias(c) for c, e in sql.items()]).collect():
        if out[r.subject_id].source == "ML":
            p = r.episode_probability
            assert out[r.subject_id].probability == pytest.approx(math.floor(p * 1000 + 0.5) / 10)
            assert out[r.subject_id].predicted_pain == pytest.approx(math.floor(r.severity * 10 + 0.5) / 10 if p > 0.2 else 0.0)


def test_subjects_without_a_place_get_the_default_one(spark, make_log):
    hours = spark.createDataFrame(
        [(loc, dt.datetime(2024, 1, 1, h), 10.0 * loc, 50.0, 1000.0, 0.0, 1.0) for loc in (1, 2) for h in range(24)],
        "location_id long, ts timestamp_ntz, temperature_2m double, relative_humidity_2m double, surface_pressure double, precipitation double, wind_speed_10m double",
    )
    log = make_log([{"subject_id": s, "date": "2023-12-30", "time": "08:00", "pain": 3} for s in (1, 2)])
    places = spark.createDataFrame([(2, 2), (3, 2)], "subject_id long, location_id long")
    daily = spark.createDataFrame([], "subject_id long, date date, daily_score double")
    out = scoring.hourly_forecast(hours, log, places, daily, "2024-01-01 06:00:00", n_hours=2, default_location=1)
    assert rows(out, "subject_id", "temp") == [(1, 10.0)] * 2 + [(2, 20.0)] * 2 + [(3, 20.0)] * 2
    assert scoring.hourly_forecast(hours, log, places, daily, "2024-01-01 06:00:00", n_hours=2).where("subject_id = 1").count() == 0
