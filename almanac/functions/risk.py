"""The three risk scales. Levels always come from the unrounded value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def risk_level_rules(probability: Column) -> Column:
    return F.when(probability < 0.3, "Low").when(probability < 0.7, "Moderate").otherwise("High")


def risk_level_model(probability: Column) -> Column:
    return F.when(probability > 0.6, "High").when(probability > 0.2, "Moderate").otherwise("Low")


def risk_level_calibrated(score: Column) -> Column:
    """Scores on the 0-100 scale after calibration."""
    return F.when(score >= 60, "High").when(score >= 30, "Moderate").otherwise("Low")
