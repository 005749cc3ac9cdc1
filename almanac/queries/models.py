"""K1-K7, J6 with a model: training, validation and model scoring.

Tree ensembles have no SQL form, so only the pieces around them carry a check.
"""

from pyspark.sql import functions as F

from ..functions import round_half_up
from ..operators.features import FEATURES as FEATURE_NAMES
from ..operators.features import features_as_of
from ..plans import scoring, training
from ..session import materialize, scratch_path
from .base import Tables, query, r, rounded, with_tables
from .bindings import AS_OF
from .features import features_of
from .scoring import settings_of

# The full training run: 100 boosting rounds and 5 folds over all labelled rows.
CONFIG = training.TrainingConfig()

# Model-free scores to check K2, K4 and K5 against SQL.
SCORED = """scored as (select user_id, value, case when event_type in ('error', 'purchase') then 1 else 0 end as pain_binary,
  case when event_type in ('error', 'purchase') then cast(least(10, floor(value / 15)) as double) else 0.0 end as pain,
  cast(cast(floor(value * 100 + 0.5) as bigint) % 97 as double) / 100 as episode_probability,
  cast(cast(floor(value * 100 + 0.5) as bigint) % 230 as double) / 100 as log_severity from events)"""


def scored_of(t: Tables):
    cents = F.floor(F.col("value") * 100 + 0.5)
    hurt = F.col("event_type").isin("error", "purchase")
    return t.events.select(
        "user_id",
        F.when(hurt, 1).otherwise(0).alias("pain_binary"),
        F.when(hurt, F.least(F.lit(10), F.floor(F.col("value") / 15)).cast("double")).otherwise(0.0).alias("pain"),
        (cents % 97 / 100).alias("episode_probability"),
        (cents % 230 / 100).alias("log_severity"),
    )


_SWEEP = (
    "sweep as (select user_id, th, 2 * count(*) filter (where hit and y) / nullif(2 * count(*) filter (where hit and y) "
    "+ count(*) filter (where hit and not y) + count(*) filter (where not hit and y), 0) as f1 from ("
    "select user_id, th, pain_binary > 0 as y, episode_probability >= th as hit from scored, (select unnest(["
    + ", ".join(f"{x}::double" for x in training.THRESHOLDS)
    + "]) as th)) group by 1, 2)"
)


@query(
    "k2_threshold_sweep",
    "with " + SCORED + ", " + _SWEEP
    + f" select user_id, case when f1 > 0 then th else 0.5 end as threshold, {r('f1')} as f1 from (select user_id, th, coalesce(f1, 0.0) as f1, "
    "row_number() over (partition by user_id order by coalesce(f1, 0.0) desc, th) as rn from sweep) where rn = 1",
)
def threshold_sweep(t: Tables):
    return rounded(training.threshold_sweep(scored_of(t), ("user_id",)), "f1")


_METRICS = ("accuracy", "baseline_accuracy", "precision", "recall", "f1", "mae", "mae_painful")


@query(
    "k4_hurdle_metrics",
    "with " + SCORED + """, gated as (select *, episode_probability >= 0.45 as hit,
    exp(case when episode_probability >= 0.45 then log_severity else 0 end) - 1 as predicted_pain, pain_binary > 0 as y from scored),
  sums as (select user_id, count(*) as n, count(*) filter (where y) as pos, count(*) filter (where hit and y) as tp,
    count(*) filter (where hit and not y) as fp, count(*) filter (where not hit and y) as fn, avg(abs(pain - predicted_pain)) as mae,
    coalesce(avg(abs(pain - predicted_pain)) filter (where y), 0.0) as mae_painful from gated group by user_id)
  select user_id, n, """
    + ", ".join(
        f"{r(v)} as {k}"
        for k, v in {
            "accuracy": "(n - fp - fn) / n",
            "baseline_accuracy": "greatest(pos / n, 1 - pos / n)",
            "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
            "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
            "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
            "mae": "mae",
            "mae_painful": "mae_painful",
        }.items()
    )
    + " from sums",
)
def hurdle_metrics(t: Tables):
    gated = training.apply_threshold(scored_of(t), F.lit(0.45))
    return rounded(training.hurdle_metrics(gated, ("user_id",)), *_METRICS)


@query(
    "k5_regression_metrics",
    "with " + SCORED + f" select {r('1 - avg(pow(pain - log_severity, 2)) / var_pop(pain)')} as r2, {r('avg(abs(pain - log_severity))')} as mae, "
    f"{r('avg(pow(pain - log_severity, 2))')} as mse, {r('sqrt(avg(pow(pain - log_severity, 2)))')} as rmse from scored",
)
def regression_metrics(t: Tables):
    return rounded(training.regression_metrics(scored_of(t), "pain", "log_severity"), "r2", "mae", "mse", "rmse")


@query(
    "k7_needs_retrain",
    with_tables("log", "model_registry", extra="latest as (select subject_id, max(trained_at) as last_trained from model_registry group by subject_id)")
    + "select l.subject_id, count(*) filter (where t.last_trained is null or l.date > t.last_trained) as entries_since_training, "
    "count(*) filter (where t.last_trained is null or l.date > t.last_trained) >= 5 as needs_retraining "
    "from log l left join latest t on l.subject_id = t.subject_id group by l.subject_id",
)
def needs_retrain(t: Tables):
    return training.needs_retrain(t.log, t.model_registry)


def frame_of(t: Tables):
    return materialize(training.training_frame(features_of(t)), "frame")


def trained_of(t: Tables):
    frame = frame_of(t)
    return frame, training.train_hurdle(frame, CONFIG)


@query("k1_train_hurdle")
def train_hurdle(t: Tables):
    frame, model = trained_of(t)
    scored = model.transform(frame)
    return scored.select(
        "subject_id", "date", "pain", round_half_up(F.col("episode_probability"), 4).alias("episode_probability"),
        round_half_up(F.col("severity"), 4).alias("severity"),
    )


@query("k3_cross_validate")
def cross_validate(t: Tables):
    return training.cross_validate(training.training_frame(features_of(t)), CONFIG)


@query("j6_predict_day")
def predict_day(t: Tables):
    _, model = trained_of(t)
    targets = scoring.forecast_targets(t.subject_location, AS_OF)
    features = features_as_of(t.log, t.weather_daily, t.subject_location, targets, F.date_sub(F.lit(AS_OF).cast("date"), 1))
    return scoring.predict_day(features, settings_of(t), model)


@query("a11_save_load_predict")
def save_load_predict(t: Tables):
    """Trains, saves twice, loads the newest complete version and predicts the coming week with it."""
    _, model = trained_of(t)
    root = scratch_path(t.spark, "models")
    for version in (1, 2):
        training.save_model(model, root, version)
    loaded = training.load_latest(t.spark, root)
    targets = scoring.forecast_targets(t.subject_location, AS_OF)
    features = features_as_of(t.log, t.weather_daily, t.subject_location, targets, F.date_sub(F.lit(AS_OF).cast("date"), 1))
    return scoring.predict_day(features, None, loaded).withColumn("version", F.lit(loaded.version))
