"""Structured Streaming forms of the incremental write paths."""
from .incremental import daily_max, drain, ingest_dedup, usage_counts, weather_rollup

__all__ = ["daily_max", "drain", "ingest_dedup", "usage_counts", "weather_rollup"]
