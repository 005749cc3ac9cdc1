"""Keeping hot join keys splittable."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def own_shuffle(df: DataFrame, key: str) -> DataFrame:
    """Give the coming join on ``key`` a shuffle of its own on this side.

    Adaptive execution splits a hot partition only when both inputs of a sort-merge join
    come straight from a shuffle. An aggregate or window already partitioned by the join
    key would sit in between and switch that off, leaving a hot key to one task. Passing
    the key through text makes it a new column to the planner, with the same values.
    Meant for the reduced side of a join, where one more shuffle is cheap.
    """
    kind = df.schema[key].dataType
    return df.withColumn(key, F.col(key).cast("string").cast(kind))
