"""2.13: one function per service call, as DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, maintain, stats, usage
from ..operators.features import build_features
from ..operators.daily import dense_timeline
from ..operators.features import timeline_weather_join
from ..sources.log import history_sort, ingest_csv, ingest_store, list_stores, register_store, scan_entries_range
from ..session import materialize
from . import scoring, training

__all__ = [
    "add_entries", "analysis_summary", "analysis_trends", "databases", "delete_entries", "entries",
    "import_csv", "import_db", "import_db_separate", "location", "medications", "medications_import",
    "prediction_forecast", "prediction_future", "prediction_hourly", "priors", "retrain",
    "training_status", "triggers", "update_entries", "update_priors",
]


def entries(log: DataFrame, start=None, end=None, limit: int | None = None) -> DataFrame:
    rows = scan_entries_range(log, start, end)
    if limit is not None:
        rows = history_sort(rows, limit).orderBy("subject_id", "position")
    return clean.read_sanitize(rows)


def add_entries(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    return maintain.insert_entries(incoming)


update_entries = maintain.update_entries
delete_entries = maintain.delete_entries
analysis_summary = stats.analysis_summary


def analysis_trends(log: DataFrame, as_of, span: str = "1y") -> DataFrame:
    """Daily pain for ``1m``, else episode days per month."""
    if span == "1m":
        return stats.trend_daily_30d(log, as_of).select("subject_id", "name", "value", "type")
    return stats.trend_monthly(log, as_of, span)


def prediction_future(features: DataFrame, settings=None, model=None) -> DataFrame:
    return scoring.predict_day(features, settings, model)


prediction_forecast = scoring.weekly_forecast
prediction_hourly = scoring.hourly_forecast


def medications(log: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry by use; a subject whose counters are all zero is recounted from the log."""
    return usage.registry_sort(usage.usage_recount_meds(log, registry, only_unused=True))


def triggers(log: DataFrame, registry: DataFrame) -> DataFrame:
    return usage.registry_sort(usage.usage_recount_triggers(log, registry, only_unused=True))


medications_import = usage.registry_anti_ci
priors = scoring.scan_settings
update_priors = maintain.upsert_settings
import_csv = ingest_csv
import_db = ingest_store
import_db_separate = register_store
databases = list_stores
training_status = training.needs_retrain


def retrain(log, weather, subject_location, config=training.TrainingConfig(), root: str | None = None):
    """Timeline, features, validation and final fit; saves a version when given a root."""
    combined = timeline_weather_join(dense_timeline(log, weather, subject_location), weather, subject_location)
    frame = materialize(training.training_frame(build_features(combined)), "frame")
    scores = training.cross_validate(frame, config)
    kept, _ = training.correlation_filter(frame, config.features)
    model = training.train_hurdle(frame, config, kept)
    if root is not None:
        training.save_model(model, root)
    return model, scores


def location(replies: DataFrame, column: str = "loc") -> DataFrame:
    """Coordinates of already landed lookup replies."""
    from ..functions import loc_parse

    latitude, longitude = loc_parse(F.col(column))
    return replies.withColumns({"latitude": latitude, "longitude": longitude})
