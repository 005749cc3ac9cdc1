"""Date and time helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Label style -> date pattern.
LABEL_PATTERNS = {
    "month": "MMMM",
    "month_year": "MMMM yyyy",
    "short_month_year": "MMM yyyy",
    "short_day": "MMM d",
}


def valid_date(text: Column) -> Column:
    """The date behind strict ``YYYY-MM-DD`` text, else null."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.year(day) >= 1), day)


def valid_time(text: Column) -> Column:
    """Strict ``HH:MM`` text that names a real minute of the day, else null."""
    return F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), text)


def _part(text: Column, index: int) -> Column:
    return F.get(F.split(text, ":"), F.lit(index)).try_cast("int")


def time_to_minutes(text: Column) -> Column:
    """H4: minutes after midnight; anything but two whole numbers counts as 0."""
    two = F.size(F.split(text, ":")) == 2
    return F.coalesce(F.when(two, _part(text, 0) * 60 + _part(text, 1)), F.lit(0))


def time_to_hour(text: Column) -> Column:
    """H5: the leading hour; null when it is not a whole number."""
    return _part(text, 0)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month").cast("date")


def months_back(day: Column, months: int) -> Column:
    """Calendar shift that clamps to the last day of a shorter month."""
    return F.add_months(day, -months)


def date_label(day: Column, style: str) -> Column:
    """H9: text labels for charts."""
    return F.date_format(day, LABEL_PATTERNS[style])


def days_until(due: Column, as_of: Column) -> Column:
    """Whole days from ``as_of`` to ``due``."""
    return F.datediff(due, as_of)


def cyclical(day: Column) -> dict[str, Column]:
    """H6: weekday (Monday = 0) and month as points on the unit circle."""
    weekday, month = F.weekday(day), F.month(day)
    week, year = F.lit(2 * math.pi) * weekday / 7, F.lit(2 * math.pi) * month / 12
    return {
        "day_of_week": weekday,
        "month": month,
        "day_of_week_sin": F.sin(week),
        "day_of_week_cos": F.cos(week),
        "month_sin": F.sin(year),
        "month_cos": F.cos(year),
    }
