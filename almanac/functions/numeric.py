"""Numeric helpers (H7, H12 and the shared rounding rule)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Fixed value: how far below a tie still rounds up. Sums of doubles differ in the last
# bits with the order of tasks; without this a tie could fall either way between runs.
TIE_MARGIN = 1e-9


def round_half_up(value: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: one rule that every SQL engine evaluates alike."""
    scale = 10**digits
    return F.floor(value * F.lit(scale) + F.lit(0.5 + TIE_MARGIN)) / F.lit(scale)


def numeric_coerce(value: Column) -> Column:
    """Text to double; whatever is not a finite-or-infinite number becomes null."""
    return nan_to_null(value.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def log_target(pain: Column) -> Column:
    """H7: the regression target, ``log(1 + pain)``."""
    return F.log1p(pain)


def unlog_target(value: Column) -> Column:
    return F.expm1(value)
