"""Lags, rolling means, fills and folds over the dense timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .daily import day_window, recent_rows

LAGS = (1, 2, 3, 7)
ROLLING = (3, 7, 30)
WARMUP_DAYS = 30
FILLED = ("tavg", "tmin", "tmax", "prcp", "snow", "wdir", "wspd", "wpgt", "pres", "tsun")


def lag_columns(value: str = "pain") -> dict[str, Column]:
    return {f"{value}_lag_{k}": F.lag(value, k).over(day_window()) for k in LAGS}


def rolling_columns(value: str = "pain") -> dict[str, Column]:
    """Mean of the previous n days; null until n days exist."""
    out = {}
    for n in ROLLING:
        frame = day_window().rowsBetween(-n, -1)
        out[f"{value}_rolling_mean_{n}"] = F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))
    return out


def pain_lags(timeline: DataFrame) -> DataFrame:
    """E4."""
    return timeline.withColumns(lag_columns())


def pain_rolling(timeline: DataFrame) -> DataFrame:
    """E5."""
    return timeline.withColumns(rolling_columns())


def weather_fill(timeline: DataFrame, columns=FILLED) -> DataFrame:
    """Carry the last known value forward, then fill the head from the first one.

    Rows the forward fill leaves empty lie before the first known value, so the backward
    fill is that value; a whole-partition frame finds it once per subject, where a
    current-row-to-end frame would rescan the rest for every row.
    """
    before = day_window().rowsBetween(Window.unboundedPreceding, 0)
    whole = day_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return timeline.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(whole))
            for c in columns
            if c in timeline.columns
        }
    )


def pressure_delta(timeline: DataFrame) -> DataFrame:
    """Day-to-day pressure change and its lag; replaces any stored change."""
    w = day_window()
    return timeline.withColumns(
        {
            "pres_change": F.col("pres") - F.lag("pres").over(w),
            "pres_change_lag1": F.lag("pres", 1).over(w) - F.lag("pres", 2).over(w),
        }
    )


def tavg_lag1(timeline: DataFrame) -> DataFrame:
    """E8."""
    return timeline.withColumn("tavg_lag1", F.lag("tavg").over(day_window()))


def warmup_trim(timeline: DataFrame, days: int = WARMUP_DAYS) -> DataFrame:
    """Drop the first ``days`` rows of each subject."""
    return (
        timeline.withColumn("day_number", F.row_number().over(day_window()))
        .where(F.col("day_number") > days)
        .drop("day_number")
    )


def history_map(log: DataFrame, rows: int = 60) -> DataFrame:
    """The last ``rows`` log rows per subject as a ``date -> pain`` map.

    Repeated dates keep the last row. The map holds at most ``rows`` entries.
    """
    by_day = (
        recent_rows(log.select("subject_id", "entry_id", "date", "pain"), rows)
        .groupBy("subject_id", "date")
        .agg(F.max_by(F.col("pain").cast("double"), "entry_id").alias("pain"))
    )
    return by_day.groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("date", "pain"))).alias("history"))


def lag_lookup(history: Column, target: Column, days: int) -> Column:
    """C4: pain ``days`` before the target, 0 when nothing is known."""
    return F.coalesce(F.try_element_at(history, F.date_sub(target, days)), F.lit(0.0))


def inference_lags(log: DataFrame, targets: DataFrame, rows: int = 60) -> DataFrame:
    """Lag and mean features for each (subject, target_date), missing days as 0."""
    joined = targets.join(history_map(log, rows), "subject_id", "left")
    history = F.coalesce(F.col("history"), F.create_map().cast("map<date,double>"))
    target = F.col("target_date")
    means = {
        f"pain_rolling_mean_{n}": F.aggregate(
            F.sequence(F.lit(1), F.lit(n)),
            F.lit(0.0),
            lambda acc, k: acc + F.coalesce(F.try_element_at(history, F.date_sub(target, k)), F.lit(0.0)),
        )
        / n
        for n in ROLLING
    }
    lags = {f"pain_lag_{k}": lag_lookup(history, target, k) for k in LAGS}
    return joined.withColumns({**lags, **means}).drop("history")


def sequence_windows(features: DataFrame, columns, size: int = 7, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Each painful day with the ``size`` painful days before it as one nested array.

    Test membership hashes the key, so a recomputed task makes the same choice.
    """
    w = day_window()
    draw = F.pmod(F.xxhash64("subject_id", "date", F.lit(seed)), F.lit(10_000)) / 10_000
    return (
        features.where(F.col("pain") > 0)
        .withColumns(
            {
                "sequence": F.collect_list(F.struct(*columns)).over(w.rowsBetween(-size, -1)),
                "target": F.log1p("pain"),
                "is_test": draw < test_share,
            }
        )
        .where(F.size("sequence") == size)
        .select("subject_id", "date", "sequence", "target", "is_test")
    )


def ts_split(timeline: DataFrame, k: int = 5) -> DataFrame:
    """Expanding-window folds per subject.

    Each fold tests the next ``n // (k+1)`` days and trains on everything before it.
    One output row per day and fold in which the day takes part.
    """
    whole = Window.partitionBy("subject_id")
    numbered = timeline.withColumns(
        {"position": F.row_number().over(day_window()) - 1, "n_days": F.count(F.lit(1)).over(whole)}
    )
    size = F.floor(F.col("n_days") / (k + 1))
    start = F.col("n_days") - (k - F.col("fold") + 1) * size
    return (
        numbered.where(size > 0)
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn(
            "role",
            F.when(F.col("position") < start, "train").when(F.col("position") < start + size, "test"),
        )
        .where(F.col("role").isNotNull())
        .drop("n_days")
    )


def pooled_folds(first_date, last_date, k: int = 5) -> list[tuple]:
    """E18 for one model over all subjects: (first test day, first day after) per fold.

    The pooled calendar is dense, so day arithmetic replaces a global row number and
    all rows of a day fall on the same side.
    """
    from datetime import timedelta

    n_days = (last_date - first_date).days + 1
    size = n_days // (k + 1)
    return [
        (
            first_date + timedelta(days=n_days - (k - i) * size),
            first_date + timedelta(days=n_days - (k - i) * size + size),
        )
        for i in range(k)
    ]
