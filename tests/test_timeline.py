import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from almanac.operators import correlation, daily, features, timeseries, weather

from helpers import rows

D = dt.date


def series(spark, pains, start=D(2024, 1, 1), subject=1, **columns):
    data = [
        (subject, start + dt.timedelta(days=i), float(p), *[columns[c][i] for c in columns]) for i, p in enumerate(pains)
    ]
    extra = "".join(f", {c} double" for c in columns)
    return spark.createDataFrame(data, f"subject_id long, date date, pain double{extra}")


def test_daily_aggregation(make_log):
    log = make_log(
        [
            {"entry_id": 2, "date": "2024-01-01", "pain": 2, "sleep": "1", "activity": "bad", "notes": "late", "triggers": None},
            {"entry_id": 1, "date": "2024-01-01", "pain": 5, "sleep": "3", "activity": None, "notes": None, "triggers": "x"},
        ]
    )
    out = daily.daily_log_agg(log, carry=("notes", "triggers"))
    assert rows(out, "pain", "sleep", "activity", "notes", "triggers") == [(5.0, 2.0, None, "late", "x")]


def test_dense_timeline_spans_log_and_weather(spark, make_log):
    log = make_log([{"date": "2024-01-03", "pain": 4, "sleep": "2"}, {"date": "2024-01-05", "pain": 0}, {"subject_id": 2, "date": "2024-01-09", "pain": 1}])
    sky = spark.createDataFrame([(9, D(2024, 1, 2), 1.0), (9, D(2024, 1, 6), 2.0)], "location_id long, date date, pres double")
    where = spark.createDataFrame([(1, 9)], "subject_id long, location_id long")
    out = daily.dense_timeline(log, sky, where)
    assert rows(out, "subject_id", "date", "pain", "sleep") == [
        (1, D(2024, 1, 2), 0.0, None), (1, D(2024, 1, 3), 4.0, 2.0), (1, D(2024, 1, 4), 0.0, None),
        (1, D(2024, 1, 5), 0.0, None), (1, D(2024, 1, 6), 0.0, None), (2, D(2024, 1, 9), 1.0, None),
    ]


def test_timeline_matches_calendar_join(make_log):
    log = make_log([{"subject_id": s, "date": f"2024-0{m}-1{m}", "pain": m} for s in (1, 2) for m in range(1, 9, s)])
    spine = daily.calendar_left_join(daily.daily_log_agg(log), daily.subject_bounds(log)).fillna(0.0, ["pain"])
    assert rows(daily.dense_timeline(log), "subject_id", "date", "pain") == rows(spine, "subject_id", "date", "pain")


def test_lag_is_aligned_after_the_warm_up(spark):
    pains = [0] * 60
    pains[29], pains[30] = 9, 1
    out = timeseries.warmup_trim(timeseries.pain_lags(series(spark, pains)))
    first = out.orderBy("date").first()
    assert (first["pain"], first["pain_lag_1"], out.count()) == (1.0, 9.0, 30)


def test_rolling_needs_a_full_frame(spark):
    out = [r.pain_rolling_mean_3 for r in timeseries.pain_rolling(series(spark, [1, 2, 3, 4, 5])).orderBy("date").collect()]
    assert out == [None, None, None, 2.0, 3.0]


@pytest.mark.parametrize(
    "given, filled",
    [
        ([None, 1.0, None, 3.0, None], [1.0, 1.0, 1.0, 3.0, 3.0]),
        ([None, None, None], [None, None, None]),
        ([5.0, None, None], [5.0, 5.0, 5.0]),
    ],
)
def test_weather_fill(spark, given, filled):
    out = timeseries.weather_fill(series(spark, [0] * len(given), pres=given)).orderBy("date").collect()
    assert [r.pres for r in out] == filled


def test_features_share_one_window_exchange(spark):
    n = 40
    columns = {c: [float(i % 7)] * 1 + [float(i) for i in range(n - 1)] for i, c in enumerate(features.WEATHER_COLUMNS)}
    frame = series(spark, [i % 4 for i in range(n)], **columns).withColumns({"sleep": F.lit(2.0), "activity": F.lit(1.0)})
    out = features.build_features(frame)
    plan = out._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in physical
    assert out.count() == 10 and set(features.FEATURES) <= set(out.columns)


def test_inference_lags_use_last_rows_and_zero(make_log):
    log = make_log([{"entry_id": 1, "date": "2024-01-01", "pain": 9}, {"entry_id": 2, "date": "2024-01-09", "pain": 4}, {"entry_id": 3, "date": "2024-01-09", "pain": 6}])
    spark = log.sparkSession
    targets = spark.createDataFrame([(1, D(2024, 1, 10)), (2, D(2024, 1, 10))], "subject_id long, target_date date")
    out = timeseries.inference_lags(log, targets)
    assert rows(out, "subject_id", "pain_lag_1", "pain_lag_2", "pain_rolling_mean_3", "pain_rolling_mean_30") == [
        (1, 6.0, 0.0, 2.0, 0.5), (2, 0.0, 0.0, 0.0, 0.0),
    ]
    # Only the two newest rows count.
    assert rows(timeseries.inference_lags(log, targets, rows=2), "subject_id", "pain_rolling_mean_30")[0] == (1, 0.2)


def prior(log):
    return [r.prior for r in features.circadian_prior(log).orderBy("hour").collect()]


def test_circadian_prior(make_log):
    assert prior(make_log([{"pain": 0, "time": "08:00"}])) == [0.1] * 24
    assert prior(make_log([{"pain": 5, "time": "bad"}, {"pain": 5, "time": None}])) == [0.1] * 24
    around_midnight = prior(make_log([{"pain": 5, "time": "00:30"}]))
    assert around_midnight[0] == pytest.approx(0.8)
    assert around_midnight[1] == around_midnight[23] == pytest.approx(0.8 / 3)
    assert sum(around_midnight) == pytest.approx(0.8 * 5 / 3)


def test_sequences(spark):
    frame = series(spark, [1, 0, 2, 3, 0, 4])
    out = timeseries.sequence_windows(frame, ("pain",), size=2)
    assert [([s.pain for s in r.sequence], round(math.expm1(r.target))) for r in out.orderBy("date").collect()] == [
        ([1.0, 2.0], 3), ([2.0, 3.0], 4),
    ]


def test_folds_expand_and_never_overlap(spark):
    out = timeseries.ts_split(series(spark, [0] * 25)).collect()
    tests = {}
    for fold in range(1, 6):
        train = {r.position for r in out if r.fold == fold and r.role == "train"}
        tests[fold] = {r.position for r in out if r.fold == fold and r.role == "test"}
        assert train == set(range(min(tests[fold]))) and len(tests[fold]) == 4
    assert set().union(*tests.values()) == set(range(5, 25))
    assert timeseries.ts_split(series(spark, [0] * 5)).count() == 0
    bounds = timeseries.pooled_folds(D(2024, 1, 1), D(2024, 1, 25))
    assert [(a - D(2024, 1, 1)).days for a, _ in bounds] == [5, 9, 13, 17, 21] and bounds[-1][1] == D(2024, 1, 26)


def test_latest_location(make_log):
    log = make_log(
        [
            {"date": "2024-01-01", "time": "08:00", "latitude": 1.0, "longitude": 2.0},
            {"date": "2024-01-02", "time": "09:00", "latitude": 3.0, "longitude": 4.0},
            {"date": "2024-01-03", "time": "09:00", "latitude": 5.0},
        ]
    )
    assert rows(daily.latest_location(log), "latitude", "longitude") == [(3.0, 4.0)]


# --- correlation -------------------------------------------------------------------------


def matrix(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(v) for v in zip(*columns.values())], ", ".join(f"{n} double" for n in names)), names


def wave(n=50, step=1.0):
    return [math.sin(i * step) * 5 + 10 for i in range(n)]


def test_uncorrelated_features_stay(spark):
    df, names = matrix(spark, a=wave(), b=wave(step=2.3), c=wave(step=0.7))
    assert correlation.correlation_filter(df, names) == (names, [])


def test_duplicate_feature_goes_by_nulls_then_name(spark):
    tmax = wave()
    double = [2 * x for x in tmax]
    df, names = matrix(spark, tmax=tmax, tsun=double, other=wave(step=2.3))
    assert correlation.correlation_filter(df, names)[1] == ["tsun"]
    df, names = matrix(spark, tmax=[None] * 5 + tmax[5:], tsun=[None] + double[1:], other=wave(step=2.3))
    assert correlation.correlation_filter(df, names)[1] == ["tmax"]


def test_filter_needs_thirty_rows_and_ignores_constants(spark):
    df, names = matrix(spark, a=wave(10), b=wave(10))
    assert correlation.correlation_filter(df, names) == (names, [])
    df, names = matrix(spark, a=wave(), flat=[1013.1] * 50, nan=[float("nan")] * 50)
    assert correlation.correlation_filter(df, names) == (names, [])


def test_pairs_match_pandas(spark):
    columns = {
        "a": [None if i % 7 == 0 else x for i, x in enumerate(wave(200))],
        "b": [None if i % 5 == 0 else x + 1000 for i, x in enumerate(wave(200, 1.1))],
        "c": [1e6 + i * 0.001 for i in range(200)],
    }
    df, names = matrix(spark, **columns)
    expected = df.toPandas().corr().abs()
    for r in correlation.correlation_pairs(df.repartition(7), names).collect():
        assert r.abs_r == pytest.approx(expected.loc[r.feature_a, r.feature_b], abs=1e-6)


# --- weather -------------------------------------------------------------------------------


def hours(spark, data):
    schema = (
        "location_id long, ts timestamp_ntz, temperature_2m double, relative_humidity_2m double, "
        "surface_pressure double, precipitation double, wind_speed_10m double"
    )
    return spark.createDataFrame(data, schema)


def day(date, pressure, n=24, humidity=50.0):
    return [(1, dt.datetime.combine(date, dt.time(h)), float(h), humidity + h, pressure, 0.1, 2.0) for h in range(n)]


def test_rollup_and_daily_override(spark):
    df = hours(spark, day(D(2024, 1, 1), 1000.0) + day(D(2024, 1, 2), None, n=10))
    extremes = spark.createDataFrame(
        [(1, D(2024, 1, 1), 40.0, -3.0, 7200.0)],
        "location_id long, date date, temperature_2m_max double, temperature_2m_min double, sunshine_duration double",
    )
    out = weather.weather_daily_rollup(df, extremes)
    assert rows(out, "date", "n_hours", "tmin", "tmax", "tsun", "pres", "midday_humidity", "prcp") == [
        (D(2024, 1, 1), 24, -3.0, 40.0, 120.0, 1000.0, 62.0, pytest.approx(2.4)),
        (D(2024, 1, 2), 10, 0.0, 9.0, 0.0, 1015.0, 54.5, pytest.approx(1.0)),
    ]


def test_pressure_change_needs_a_full_day_before(spark):
    df = hours(
        spark,
        day(D(2024, 1, 1), 1000.0) + day(D(2024, 1, 2), 1010.0, n=23) + day(D(2024, 1, 3), 1020.0) + day(D(2024, 1, 5), 1030.0),
    )
    out = weather.pressure_change_24h(weather.weather_daily_rollup(df))
    assert rows(out, "date", "pres_change") == [
        (D(2024, 1, 1), 0.0), (D(2024, 1, 2), 10.0), (D(2024, 1, 3), 0.0), (D(2024, 1, 5), 0.0),
    ]


def test_pressure_change_3h_defaults(spark):
    data = [(1, dt.datetime(2024, 1, 1, h), 0.0, 0.0, p, 0.0, 0.0) for h, p in enumerate([1000.0, None, 0.0, 1004.0, 1010.0])]
    out = weather.pressure_change_3h(hours(spark, data)).orderBy("ts").collect()
    assert [r.pressure_change_3h for r in out] == [0.0, 0.0, 0.0, 4.0, -5.0]
