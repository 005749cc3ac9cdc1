import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from almanac.operators import features as feats
from almanac.operators.daily import dense_timeline
from almanac.plans import training
from almanac.queries import models
from almanac.session import scratch_path

from helpers import rows

D = dt.date
CONFIG = training.TrainingConfig(max_iter=2, max_depth=2, folds=2, features=("f1", "f2", "empty"))


@pytest.fixture(scope="module")
def frame(spark):
    data = []
    for i in range(120):
        pain = float(i % 6) if i % 3 == 0 else 0.0
        data.append((1, D(2022, 1, 1) + dt.timedelta(days=7 * i), pain, int(pain > 0), math.log1p(pain), pain + math.sin(i), math.cos(i), None))
    schema = "subject_id long, date date, pain double, pain_binary int, pain_log double, f1 double, f2 double, empty double"
    return spark.createDataFrame(data, schema).withColumns({"sleep": F.lit(None).cast("double"), "activity": F.lit(1.0)})


def test_sample_and_class_weights(frame):
    weights = rows(feats.sample_weights(frame).groupBy("sample_weight").count(), "sample_weight", "count")
    assert weights == [(1.0, 67), (3.0, 53)]
    n1 = frame.where("pain > 0").count()
    table = {r.pain_binary: r.class_weight for r in feats.class_weights(frame).collect()}
    assert table[1] == pytest.approx(120 / (2 * n1)) and table[0] == pytest.approx(120 / (2 * (120 - n1)))


def test_threshold_sweep(spark):
    scored = spark.createDataFrame(
        [("none", 0.9, 0), ("none", 0.1, 0), ("tie", 0.9, 1), ("tie", 0.05, 0), ("split", 0.3, 0), ("split", 0.45, 1)],
        "k string, episode_probability double, pain_binary int",
    )
    out = {r.k: (r.threshold, r.f1) for r in training.threshold_sweep(scored, ("k",)).collect()}
    assert out == {"none": (0.5, 0.0), "tie": (0.1, 1.0), "split": (0.35, 1.0)}


def test_metrics_against_hand_counts(spark):
    scored = spark.createDataFrame(
        [(1, 1, 5.0, 4.0), (1, 0, 3.0, 0.0), (0, 1, 0.0, 2.0), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0)],
        "pain_binary int, predicted int, pain double, predicted_pain double",
    )
    m = training.hurdle_metrics(scored).first()
    assert (m.accuracy, m.baseline_accuracy, m.precision, m.recall, m.f1) == (0.6, 0.6, 0.5, 0.5, 0.5)
    assert (m.mae, m.mae_painful) == (pytest.approx(6 / 5), pytest.approx(2.0))
    silent = training.hurdle_metrics(scored.withColumn("predicted", F.lit(0))).first()
    assert (silent.precision, silent.recall, silent.f1) == (0.0, 0.0, 0.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    m = training.regression_metrics(df, "y", "p").first()
    assert (m.mae, m.mse, m.r2) == (pytest.approx(0.5), pytest.approx(1.25 / 3), pytest.approx(1 - 1.25 / 2))


def test_model_scores_saves_and_keeps_two_versions(spark, frame):
    model = training.train_hurdle(frame, CONFIG)
    assert model.features == ("f1", "f2")
    scored = model.transform(frame.drop("f2"))
    low, high, worst = scored.agg(F.min("episode_probability"), F.max("episode_probability"), F.max("severity")).first()
    assert 0 <= low <= high <= 1 and 0 <= worst <= 10
    again = training.train_hurdle(frame, CONFIG).transform(frame.drop("f2"))
    assert rows(again, "episode_probability", "severity") == rows(scored, "episode_probability", "severity")

    root = scratch_path(spark, "models")
    assert training.load_latest(spark, root) is None
    for version in (1, 2, 3):
        training.save_model(model, root, version)
    assert training.list_versions(spark, root) == [3, 2]
    loaded = training.load_latest(spark, root)
    assert loaded.version == 3 and loaded.features == ("f1", "f2")
    assert rows(loaded.transform(frame.drop("f2")), "episode_probability", "severity") == rows(scored, "episode_probability", "severity")


def test_half_a_version_is_never_loaded(spark, frame, monkeypatch):
    model = training.train_hurdle(frame, CONFIG)
    root = scratch_path(spark, "models")
    training.save_model(model, root, 1)

    class Dies:
        features = model.features
        classifier = model.classifier

        @property
        def regressor(self):
            raise OSError("lost")

    with pytest.raises(OSError):
        training.save_model(Dies(), root, 2)
    assert training.list_versions(spark, root) == [1] and training.load_latest(spark, root).version == 1
    # the same number again, and then never anew
    training.save_model(model, root, 2)
    assert training.load_latest(spark, root).version == 2
    with pytest.raises(ValueError):
        training.save_model(model, root, 2)


def test_serving_features_are_those_of_training_as_of_the_day_before(spark, make_log):
    days = [D(2023, 1, 1) + dt.timedelta(days=i) for i in range(80)]
    log = make_log([{"date": str(d), "time": "08:00", "pain": i % 4, "entry_id": i} for i, d in enumerate(days) if i % 3])
    weather = spark.createDataFrame(
        [(5, d, 10.0 + i % 7, 5.0, 20.0 + i % 5, 1000.0 + (i * 37) % 11, float(i % 2), 3.0, 60.0, 50.0, 55.0, 1.0, 2.0) for i, d in enumerate(days) if i % 10 != 9],
        "location_id long, date date, tavg double, tmin double, tmax double, pres double, prcp double, wspd double, tsun double, average_humidity double, midday_humidity double, latitude double, longitude double",
    )
    place = spark.createDataFrame([(1, 5)], "subject_id long, location_id long")
    combined = feats.timeline_weather_join(dense_timeline(log, weather, place), weather, place)
    trained = {r.date: r for r in feats.build_features(combined).collect()}
    columns = [c for c in feats.FEATURES if c not in ("sleep", "activity")]
    for i in (40, 55, 59, 79):
        target = spark.createDataFrame([(1, days[i])], "subject_id long, target_date date")
        (row,) = feats.features_as_of(log, weather, place, target, days[i - 1]).collect()
        assert [row[c] for c in columns] == [trained[days[i]][c] for c in columns]
        assert row.pres_change is not None and row.tavg_lag1 is not None and (row.sleep, row.activity) == (2.0, 1.5)
    # seven days ahead: entries after as_of are unknown, so their days count as painless
    week = spark.createDataFrame([(1, days[60] + dt.timedelta(days=k)) for k in range(7)], "subject_id long, target_date date")
    ahead = {r.target_date: r for r in feats.features_as_of(log, weather, place, week, days[59]).collect()}
    assert len(ahead) == 7 and ahead[days[66]].pain_lag_3 == 0.0 and ahead[days[66]].pain_lag_7 == trained[days[66]].pain_lag_7


def test_cross_validation_has_a_row_per_fold(frame):
    out = training.cross_validate(frame, CONFIG).collect()
    assert [r.fold for r in out] == [1, 2]
    assert all(0 <= r.accuracy <= 1 and r.mae >= 0 and r.threshold in [*training.THRESHOLDS, 0.5] for r in out)


def test_each_fold_equals_a_fit_on_that_fold_alone(frame):
    together = {r.fold: tuple(r) for r in training.cross_validate(frame, CONFIG).collect()}
    data = feats.impute_for_training(frame)
    for number, days in enumerate(training.fold_days(data, CONFIG.folds), start=1):
        assert training.validate_fold(data, days, number, CONFIG) == together[number]
    assert training.cross_validate(frame.limit(0), CONFIG).count() == 0


def test_exported_sql_equals_the_model(spark, frame):
    model = training.train_hurdle(frame, training.TrainingConfig(max_iter=12, max_depth=4, features=("f1", "f2", "empty")))
    gaps = frame.select("date", F.when(F.dayofyear("date") % 5 > 0, F.col("f1")).alias("f1"), "f2")
    sql = training.export_sql(model)
    plain = gaps.select("date", *[F.expr(e).alias(f"sql_{c}") for c, e in sql.items()])
    for r in model.transform(gaps).join(plain, "date").collect():
        for c in sql:
            assert r[c] == pytest.approx(r[f"sql_{c}"], abs=1e-12)


def test_written_tables_of_training_are_removed(spark, frame):
    import os

    from almanac.session import shared_dir

    training.cross_validate(frame, CONFIG)
    left = os.listdir(f"{shared_dir(spark)}/almanac")
    assert not [name for name in left if name.startswith(("fold", "training"))]


def test_registered_queries_train_the_full_run(monkeypatch):
    used = []

    class Stop(Exception):
        pass

    def stop(features, config=training.TrainingConfig(), columns=None):
        used.append(config)
        raise Stop

    monkeypatch.setattr(models, "features_of", lambda t: None)
    monkeypatch.setattr(models, "frame_of", lambda t: None)
    monkeypatch.setattr(training, "training_frame", lambda features: None)
    monkeypatch.setattr(training, "train_hurdle", stop)
    monkeypatch.setattr(training, "cross_validate", stop)
    for run in (models.train_hurdle, models.cross_validate, models.predict_day, models.save_load_predict):
        with pytest.raises(Stop):
            run(None)
    assert [(c.max_iter, c.folds) for c in used] == [(100, 5)] * 4


def test_retention_and_retraining(spark, make_log):
    registry = spark.createDataFrame([("m", 1), ("m", 3), ("m", 2), ("n", 1)], "model_name string, version long")
    assert rows(training.model_retention(registry).where("is_kept"), "model_name", "version") == [("m", 2), ("m", 3), ("n", 1)]
    trained = spark.createDataFrame([(1, D(2024, 1, 2))], "subject_id long, trained_at date")
    log = make_log([{"date": f"2024-01-0{d}"} for d in range(1, 9)])
    assert rows(training.needs_retrain(log, trained), "entries_since_training", "needs_retraining") == [(6, True)]


def test_forest_search(frame):
    grid = {"trees": [2], "depth": [2, 3], "leaf": [1], "bootstrap": [True]}
    best, table = training.forest_grid_search(frame, ("f1", "f2"), grid=grid, folds=2)
    assert table.count() == 2 and best.getNumTrees == 2
