"""Code-to-label maps and flags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .numeric import round_half_up

# Stored code or word -> label shown to the user.
SLEEP_CURRENT = {"1": "Poor", "poor": "Poor", "2": "Fair", "fair": "Fair", "3": "Good", "good": "Good"}
SLEEP_LEGACY = {0: "Poor", 1: "Fair", 2: "Good"}
ACTIVITY_CURRENT = {
    "0": "None", "none": "None", "1": "Light", "light": "Light",
    "2": "Mod", "moderate": "Mod", "3": "Heavy", "heavy": "Heavy",
}
ACTIVITY_LEGACY = {0: "Low", 1: "Moderate", 2: "Heavy"}
FREQUENCY = {"as_needed": "Acute", "daily": "Daily", "periodic": "Periodic"}


def _lookup(mapping: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[key]


def _decode(code: Column, current: dict, legacy: dict, scheme: str) -> Column:
    """Current coding passes unknown codes through; the legacy one turns them into null."""
    if scheme == "current":
        text = code.cast("string")
        return F.coalesce(_lookup(current, F.lower(text)), text)
    if scheme == "legacy":
        number = code.try_cast("double")
        return F.when(number == F.floor(number), _lookup(legacy, number.try_cast("int")))
    raise ValueError(f"unknown coding scheme {scheme!r}")


def sleep_label(code: Column, scheme: str = "current") -> Column:
    return _decode(code, SLEEP_CURRENT, SLEEP_LEGACY, scheme)


def activity_label(code: Column, scheme: str = "current") -> Column:
    return _decode(code, ACTIVITY_CURRENT, ACTIVITY_LEGACY, scheme)


def frequency_label(code: Column) -> Column:
    return _lookup(FREQUENCY, code)


def severity_label(pain: Column) -> Column:
    """Zero is tested before the bands."""
    return F.when(pain == 0, "No Pain").when(pain <= 3, "Mild").when(pain <= 6, "Moderate").when(pain > 6, "Severe")


def c_to_f(celsius: Column) -> Column:
    return round_half_up(celsius * 9 / 5 + 32, 1)


def status_flags(pain: Column, prcp: Column, humidity: Column) -> dict[str, Column]:
    """H20."""
    return {
        "recovering": F.coalesce(pain > 0, F.lit(False)),
        "rainy": F.coalesce(prcp > 0.1, F.lit(False)),
        "humid": F.coalesce(humidity > 70, F.lit(False)),
    }


def baseline_from_frequency(days_per_month: Column) -> Column:
    """Days per month -> base risk."""
    return (
        F.when(days_per_month >= 15, 0.9).when(days_per_month >= 8, 0.6).when(days_per_month >= 3, 0.3).otherwise(0.1)
    )


def frequency_class(baseline: Column) -> Column:
    """H17 reversed: base risk -> word."""
    return F.when(baseline < 0.3, "Rare").when(baseline < 0.6, "Frequent").otherwise("Chronic")
