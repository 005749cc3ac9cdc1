"""Pairwise correlation and the redundancy filter."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import nan_to_null

MIN_ROWS = 30
THRESHOLD = 0.90
_SUMS = ("n", "mx", "my", "sxx", "syy", "sxy")
_PARTIAL = "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS)


def _moments(df: DataFrame, columns) -> DataFrame:
    """Per pair of columns (``i`` <= ``j``, and row count under ``i`` = ``j`` = the number of columns) and task: rows with
    both values, their means, and their sums of squares and products about those means.

    Every Arrow batch is folded about its own means, so large offsets cancel before anything is
    squared, and batches are merged by the pairwise update of moments.
    """
    cleaned = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    left, right = np.triu_indices(len(columns) + 1)

    def moments(x):
        mask = ~np.isnan(x)
        m = mask.astype(float)
        count = m.sum(0)
        origin = np.where(mask, x, 0.0).sum(0) / np.maximum(count, 1.0)
        x = np.where(mask, x - origin, 0.0)
        n = m.T @ m
        safe = np.maximum(n, 1.0)
        mx, my = x.T @ m / safe, m.T @ x / safe
        square = x * x
        sxx, syy, sxy = square.T @ m - n * mx * mx, m.T @ square - n * my * my, x.T @ x - n * mx * my
        return n, mx + origin[:, None], my + origin[None, :], sxx, syy, sxy

    def merge(a, b):
        n = a[0] + b[0]
        share = a[0] * b[0] / np.maximum(n, 1.0)
        dx, dy = b[1] - a[1], b[2] - a[2]
        part = b[0] / np.maximum(n, 1.0)
        return n, a[1] + dx * part, a[2] + dy * part, a[3] + b[3] + share * dx * dx, a[4] + b[4] + share * dy * dy, a[5] + b[5] + share * dx * dy

    def fold(batches):
        totals = None
        for batch in batches:
            x = np.column_stack([batch.to_numpy(dtype=float), np.ones(len(batch))])
            parts = moments(x)
            totals = parts if totals is None else merge(totals, parts)
        if totals is not None:
            yield pd.DataFrame({"i": left, "j": right, **{name: t[left, right] for name, t in zip(_SUMS, totals)}})

    return cleaned.mapInPandas(fold, _PARTIAL)


def _pairs(df: DataFrame, columns) -> DataFrame:
    """All pairs of :func:`_moments`, merged over the tasks, with ``abs_r``."""
    both = Window.partitionBy("i", "j")
    n = F.sum("n").over(both)
    means = {f"all_{c}": F.sum(F.col("n") * F.col(c)).over(both) / F.nullif(n, F.lit(0.0)) for c in ("mx", "my")}
    spread = _moments(df, columns).withColumns(means)
    dx, dy = F.col("mx") - F.col("all_mx"), F.col("my") - F.col("all_my")
    sums = spread.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"),
        F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"),
        F.max(F.abs("all_mx")).alias("mx"),
        F.max(F.abs("all_my")).alias("my"),
    )

    # A column that is constant on the shared rows has no correlation; rounding may leave it a trace.
    def varies(total: str, mean: str) -> Column:
        return F.col(total) > F.lit(1e-24) * F.col("n") * F.greatest(F.col(mean) * F.col(mean), F.lit(1.0))

    usable = (F.col("n") > 1) & varies("sxx", "mx") & varies("syy", "my")
    return sums.select("i", "j", F.col("n").cast("bigint").alias("n"), F.when(usable, F.abs(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))).alias("abs_r"))


def correlation_pairs(df: DataFrame, columns) -> DataFrame:
    """Pearson |r| of every feature pair over the rows where both are present.

    One read: each task folds its rows into a few numbers per pair (masked matrix products per
    Arrow batch), then one aggregation merges them. What is shuffled depends on the number of
    features and tasks, not of rows.
    """
    columns = list(columns)
    names = F.array(*[F.lit(c) for c in columns])
    return _pairs(df, columns).where((F.col("i") < F.col("j")) & (F.col("j") < len(columns))).select(
        F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), F.col("n").alias("n_pairs"), "abs_r"
    )


def correlation_filter(df: DataFrame, columns, threshold: float = THRESHOLD, min_rows: int = MIN_ROWS) -> tuple[list[str], list[str]]:
    """I4: (kept, dropped) feature names. With fewer than ``min_rows`` rows nothing is dropped.

    One read yields the pairs, how many values each feature lacks and the row count. The greedy
    pass runs on the driver over the pair table, whose size is fixed by the number of features.
    """
    columns = list(columns)
    last = len(columns)
    found = {(r["i"], r["j"]): r for r in _pairs(df, columns).collect()}
    total = found[last, last]["n"] if found else 0
    if total < min_rows:
        return columns, []
    nulls = {c: total - found[k, k]["n"] for k, c in enumerate(columns)}
    strong = [
        (columns[i], columns[j]) for (i, j), r in found.items() if i < j < last and r["abs_r"] is not None and round(r["abs_r"], 12) > threshold
    ]
    dropped = greedy_drop(strong, nulls)
    return [c for c in columns if c not in dropped], sorted(dropped)


def greedy_drop(pairs, nulls) -> set[str]:
    """Visit pairs in name order; drop the emptier member, on a tie the later name."""
    dropped: set[str] = set()
    for a, b in sorted(pairs):
        if dropped.isdisjoint((a, b)):
            dropped.add(max((a, b), key=lambda c: (nulls[c], c)))
    return dropped


def pair_names(columns) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))
