import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import daily, gaps, stats, usage

from helpers import rows

D = dt.date


@pytest.fixture
def log(make_log):
    return make_log(
        [
            # Two entries on one day: the later painful one stands for the day.
            {"subject_id": 1, "date": "2024-01-31", "time": "08:00", "pain": 0, "medication": " a "},
            {"subject_id": 1, "date": "2024-01-31", "time": "20:00", "pain": 7, "medication": "a"},
            {"subject_id": 1, "date": "2024-02-01", "time": "08:00", "pain": 7, "medication": ""},
            {"subject_id": 1, "date": "2024-02-01", "time": "20:00", "pain": 3, "medication": None},
            {"subject_id": 1, "date": "2024-03-10", "time": "08:00", "pain": 0},
            # The last logged day is pain-free and anchors the past year.
            {"subject_id": 1, "date": "2025-01-31", "time": "08:00", "pain": 0},
            {"subject_id": 2, "date": "2025-01-01", "time": "08:00", "pain": None, "medication": "b"},
            {"subject_id": 3, "date": "2024-12-31", "time": "08:00", "pain": 5},
        ]
    )


def test_yearly_and_past_year(log):
    profile = stats.day_profile(log)
    assert rows(stats.yearly_counts(stats.episode_days(log)), "subject_id", "year", "episode_days") == [(1, 2024, 2), (3, 2024, 1)]
    assert rows(stats.past_12m_counts(profile), "subject_id", "label", "episode_days") == [
        (1, "February 2024", 1), (1, "January 2024", 1), (3, "December 2024", 1),
    ]


def test_daily_and_all_pain_stats_differ(log):
    assert rows(stats.pain_stats_daily(stats.day_profile(log)), "subject_id", "avg_pain", "max_pain") == [
        (1, 5.0, 7), (2, 0.0, 0), (3, 5.0, 5),
    ]
    assert rows(stats.pain_stats_all(log), "subject_id", "avg_pain", "max_pain") == [(1, 5.7, 7.0), (2, 0.0, 0.0), (3, 5.0, 5.0)]


def test_medication_counts(log):
    assert rows(stats.medication_counts(log), "subject_id", "medication", "uses") == [
        (1, "No Medication", 2), (1, "a", 1), (3, "No Medication", 1),
    ]
    assert rows(usage.legacy_med_counts(log), "subject_id", "name", "uses") == [(1, " a ", 1), (1, "a", 1), (2, "b", 1)]


def test_first_and_worst_row_per_day(log):
    painful = log.where(F.col("pain") > 0)
    assert rows(daily.first_per_day(painful), "subject_id", "date", "pain")[1] == (1, D(2024, 2, 1), 3)
    assert rows(daily.max_row_per_day(log), "subject_id", "date", "pain")[1] == (1, D(2024, 2, 1), 7)


def test_trend_edges_are_inclusive(make_log):
    log = make_log([{"date": "2024-01-01", "pain": 4}, {"date": "2024-01-02", "pain": 0}, {"date": "2023-12-31", "pain": 9}])
    assert rows(stats.trend_daily_30d(log, "2024-01-31"), "name", "value") == [("Jan 1", 4.0)]
    monthly = stats.trend_monthly(log, "2024-12-15", "1y")
    assert rows(monthly, "name", "value", "sort_key") == [("Dec 2023", 1, 1701388800), ("Jan 2024", 1, 1704067200)]


def test_average_days_per_month_uses_short_history(make_log):
    log = make_log([{"date": "2024-01-20", "pain": 4}, {"date": "2024-01-21", "pain": 1}, {"date": "2024-01-22", "pain": 0}])
    assert rows(stats.avg_days_per_month(log, "2024-01-25"), "months", "avg_days_per_month") == [(1, 2.0)]
    assert rows(stats.avg_days_per_month(log, "2024-02-01"), "months", "avg_days_per_month") == [(2, 1.0)]


@pytest.mark.parametrize(
    "days, as_of, streak",
    [
        (["2024-01-01", "2024-01-02", "2024-01-03"], "2024-01-03", 3),
        (["2024-01-01", "2024-01-02"], "2024-01-03", 2),
        (["2024-01-01", "2024-01-02"], "2024-01-04", 0),
        (["2024-01-01", "2024-01-03", "2024-01-03"], "2024-01-03", 1),
        # Entries after the asked day do not count.
        (["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"], "2024-01-02", 2),
    ],
)
def test_streak(make_log, days, as_of, streak):
    assert gaps.logging_streak(make_log([{"date": d} for d in days]), as_of).first()["streak_days"] == streak


@pytest.mark.parametrize(
    "last, missing", [("2024-01-09", 0), ("2024-01-10", 0), ("2024-01-07", 2), ("2023-12-01", 5), ("2024-02-01", 0)]
)
def test_missing_days(make_log, last, missing):
    found = rows(gaps.missing_days(make_log([{"date": last}]), "2024-01-10"), "date")
    assert [r[0] for r in found] == [D(2024, 1, 10 - k) for k in range(missing, 0, -1)]


def test_backfill_packs_daily_medications(spark, make_log):
    meds = spark.createDataFrame(
        [(1, 2, "b", "daily", None), (1, 1, "a", "daily", "5mg"), (1, 3, "c", "periodic", None)],
        "subject_id long, med_id long, name string, frequency string, default_dosage string",
    )
    lines = gaps.healthy_day_backfill(make_log([{"date": "2024-01-08"}]), meds, "2024-01-10")
    assert lines.count() == 2
    assert rows(gaps.pack_entries(lines), "date", "time", "pain", "medications") == [
        (D(2024, 1, 9), "12:00", 0, '[{"name":"a","dosage":"5mg"},{"name":"b","dosage":""}]')
    ]


@pytest.fixture
def triggers(spark):
    return spark.createDataFrame(
        [(1, 1, "stress", 0, "mind"), (1, 2, "STRESS", 0, "other"), (1, 3, "Rain", 4, ""), (1, 4, "unused", 0, None)],
        "subject_id long, trigger_id long, name string, usage_count long, category string",
    )


def test_trigger_usage(make_log, triggers):
    log = make_log([{"date": "2024-01-01", "triggers": "Stress, Rain,,stress "}, {"date": "2024-01-02", "triggers": "Stress,Stress"}])
    named = usage.trigger_usage(log, triggers, "2024-01-02", "all")
    assert rows(named, "rank", "name", "uses", "label") == [(1, "Stress", 3, "Stress (60%)"), (2, "Rain", 1, "Rain (20%)"), (3, "stress", 1, "stress (20%)")]
    grouped = usage.trigger_usage(log, triggers, "2024-01-02", "all", by_category=True)
    assert rows(grouped, "name", "uses") == [("Uncategorized", 1), ("mind", 4)]


def test_recounts(make_log, triggers, spark):
    log = make_log([{"triggers": "Stress, Rain,,stress "}, {"medication": "a, b", "medications": '[{"name":"a"}]'}, {"medications": '{"name":"a"}'}])
    assert rows(usage.usage_recount_triggers(log, triggers), "name", "usage_count") == [("Rain", 1), ("STRESS", 0), ("stress", 1), ("unused", 0)]
    meds = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "c", 0)], "subject_id long, med_id long, name string, usage_count long")
    assert rows(usage.usage_recount_meds(log, meds), "name", "usage_count") == [("a", 2), ("c", 0)]


def test_medication_usage_falls_back_to_text(make_log):
    log = make_log(
        [
            {"date": "2024-01-01", "pain": 5, "medications": "a, b"},
            {"date": "2024-01-01", "pain": 5, "medications": '[{"name":"a"},{"name":""}]'},
            {"date": "2024-01-01", "pain": 5, "medications": "{}"},
            {"date": "2024-01-01", "pain": 0, "medications": "[]"},
        ]
    )
    assert rows(usage.medication_usage(log, "2024-01-02", "all"), "name", "uses", "share_pct") == [
        ("No Medication", 1, 25), ("a", 2, 50), ("b", 1, 25),
    ]


def test_category_order(triggers):
    page = [(r.category, r.name) for r in usage.category_group(triggers).collect()]
    assert page == [("Uncategorized", "Rain"), ("Uncategorized", "unused"), ("mind", "stress"), ("other", "STRESS")]
    form = [r.category for r in usage.category_group(triggers, "form").collect()]
    assert form == ["mind", "other", "Other", "Other"]


def test_last_use_matches_substrings_like_brute_force(spark, make_log):
    texts = ["Advil PM 200", "advil", "xAdvilx", "Tylenol, Advil", "", "il", "aaaa", "aaa", "Ibu" * 50]
    names = ["Advil", "il", "aa", "Tylenol", "Ibu", "PM", "nothing", "aaaa", "Advil PM 200 and more"]
    log = make_log([{"date": f"2024-01-{i + 1:02d}", "medication": t} for i, t in enumerate(texts)] + [{"date": "2024-02-01", "medications": '[{"name":"nothing"}]'}])
    registry = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "subject_id long, med_id long, name string")
    expected = {}
    for n in names:
        days = [D(2024, 1, i + 1) for i, t in enumerate(texts) if n in t] + ([D(2024, 2, 1)] if n == "nothing" else [])
        if days:
            expected[n] = max(days)
    assert dict(rows(usage.last_use_join(log, registry), "name", "last_use")) == expected


def test_last_use_in_long_texts_and_by_short_names(spark, make_log):
    import random

    random.seed(8)
    long = "".join(random.choice("abcde é,") for _ in range(100_000))
    texts = [long, "zzz", "é", "aé", long[:50] + "XyZ" + long[50:90]]
    names = ["a", "é", "q", "zz", "aé", "xyz", "XyZ", "", long[4_000:4_030], long[-7:], "abcdeabcdeabcde", "日本", "zzzz"]
    log = make_log([{"date": f"2024-01-{i + 1:02d}", "medication": t} for i, t in enumerate(texts)])
    registry = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)] + [(2, 99, "a"), (1, 98, None)], "subject_id long, med_id long, name string")
    expected = {n: max(D(2024, 1, i + 1) for i, t in enumerate(texts) if n in t) for n in names if n and any(n in t for t in texts)}
    assert dict(rows(usage.last_use_join(log, registry), "name", "last_use")) == expected


def test_names_are_filed_under_their_rarest_run(spark):
    registry = spark.createDataFrame([(1, n) for n in ("med1", "med2", "med12", "xy")], "subject_id long, name string")
    assert dict(rows(usage.rarest_gram(registry), "name", "gram")) == {"med1": "ed1", "med2": "ed2", "med12": "d12", "xy": "xy"}


def test_med_due_window(spark, make_log):
    log = make_log([{"date": "2024-01-01", "medications": '[{"name":"a"},{"name":"b"},{"name":"c"}]'}])
    registry = spark.createDataFrame(
        [(1, 1, "a", "periodic", 10), (1, 2, "b", "periodic", 30), (1, 3, "c", "daily", 1), (1, 4, "d", "periodic", 1)],
        "subject_id long, med_id long, name string, frequency string, period_days int",
    )
    assert rows(usage.med_due(log, registry, "2024-01-08"), "name", "due_days") == [("a", 3)]
    assert rows(usage.med_due(log, registry, "2024-02-05"), "name", "due_days") == [("a", -25), ("b", -5)]


def test_entries_since_training(spark, make_log):
    log = make_log([{"date": "2020-01-01"}, {"date": "2020-01-02"}])
    never = spark.createDataFrame([], "subject_id long, last_trained date")
    assert rows(stats.entries_since_training(log, never), "entries_since_training", "needs_retraining") == [(2, False)]
    for trained, n in ((D(1970, 1, 1), 2), (D(2030, 1, 1), 0), (D(2020, 1, 1), 1)):
        one = spark.createDataFrame([(1, trained)], "subject_id long, last_trained date")
        assert rows(stats.entries_since_training(log, one, threshold=2), "entries_since_training", "needs_retraining") == [(n, n >= 2)]
