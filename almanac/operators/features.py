"""Feature frames for training and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import cyclical, log_target, numeric_coerce, time_to_hour
from .daily import HISTORY_ROWS, day_window, dense_timeline
from .timeseries import inference_lags, lag_columns, rolling_columns, warmup_trim, weather_fill

# What serving assumes when a reading is missing.
SERVING_DEFAULTS = {"tmax": 25.0, "tmin": 15.0, "average_humidity": 50.0, "tavg": 20.0}
SLEEP_DEFAULT = 2.0
ACTIVITY_DEFAULT = 1.5
RECENT_WEIGHT = 3.0
RECENT_DAYS = 365
NO_HISTORY_PRIOR = 0.1
PEAK_PRIOR = 0.8
# Circular smoothing of neighbouring hours (before, own, after).
SMOOTHING = (0.2, 0.6, 0.2)

WEATHER_COLUMNS = ("tavg", "tmin", "tmax", "pres", "prcp", "wspd", "tsun", "average_humidity", "midday_humidity")

FEATURES = (
    "day_of_week", "month", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "tavg", "tmin", "tmax", "pres", "prcp", "wspd", "tsun", "average_humidity", "midday_humidity",
    "tdiff", "humid_tavg", "pain_lag_1", "pain_lag_2", "pain_lag_3", "pain_lag_7",
    "pain_rolling_mean_3", "pain_rolling_mean_7", "pain_rolling_mean_30",
    "pres_change", "pres_change_lag1", "tavg_lag1", "sleep", "activity",
)


def timeline_weather_join(timeline: DataFrame, weather: DataFrame, subject_location: DataFrame) -> DataFrame:
    """Weather of the subject's own location on each day.

    The join on (location, date) cannot multiply rows, and a busy location is spread
    over its days.
    """
    return (
        timeline.join(subject_location, "subject_id", "left")
        .join(weather.drop("latitude", "longitude", "pres_change"), ["location_id", "date"], "left")
    )


def weather_derived(df: DataFrame) -> DataFrame:
    """H8: the mean temperature becomes the midpoint of the extremes."""
    midpoint = (F.col("tmax") + F.col("tmin")) / 2
    return df.withColumns(
        {
            "tdiff": F.col("tmax") - F.col("tmin"),
            "tavg": midpoint,
            "humid_tavg": F.coalesce("average_humidity", F.lit(0.0)) * midpoint,
        }
    )


def build_features(combined: DataFrame, warmup: int = 30) -> DataFrame:
    """All training features of a dense timeline with weather.

    Every window is by subject in date order, so one exchange and one sort serve all.
    """
    filled = weather_derived(weather_fill(combined))
    w = day_window()
    pressure = {
        "pres_change": F.col("pres") - F.lag("pres").over(w),
        "pres_change_lag1": F.lag("pres", 1).over(w) - F.lag("pres", 2).over(w),
        "tavg_lag1": F.lag("tavg").over(w),
    }
    lagged = filled.withColumns({**lag_columns(), **rolling_columns(), **pressure})
    return warmup_trim(lagged, warmup).withColumns(
        {
            **cyclical(F.col("date")),
            "pain_binary": (F.col("pain") > 0).cast("int"),
            "pain_log": log_target(F.col("pain")),
        }
    )


def features_as_of(
    log: DataFrame, weather: DataFrame, subject_location: DataFrame, targets: DataFrame, as_of, warmup: int = 30
) -> DataFrame:
    """I1 for serving: the feature row of each (``subject_id``, ``target_date``) with the entries up to ``as_of``.

    The same builder as in training, over the timeline that was known on that day: a training row
    is this row as of the day before it. Entries after ``as_of`` are not read, days without one up to
    the target have no pain, and weather is read up to the last target. Pressure changes and
    temperature lags are those of the subject's own place. Sleep and activity of a day to come
    are the serving defaults. Subjects with ``warmup`` days of history or fewer have no row.
    """
    known = log.where(F.col("date") <= F.lit(as_of).cast("date"))
    last = targets.select(F.max("target_date")).scalar()
    forecast = weather.where(F.col("date") <= last)
    asked = targets.select("subject_id", F.col("target_date").alias("date")).distinct()
    marks = asked.select("subject_id", "date", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("pain", "sleep", "activity")])
    days = dense_timeline(known.select(*marks.columns).unionByName(marks), forecast, subject_location)
    built = build_features(timeline_weather_join(days, forecast, subject_location), warmup)
    served = built.join(asked, ["subject_id", "date"], "left_semi").withColumnRenamed("date", "target_date")
    return served.withColumns({"sleep": F.lit(SLEEP_DEFAULT), "activity": F.lit(ACTIVITY_DEFAULT)})


def impute_for_training(features: DataFrame) -> DataFrame:
    """Sleep and activity take the serving defaults on unlogged days."""
    return features.fillna({"sleep": SLEEP_DEFAULT, "activity": ACTIVITY_DEFAULT})


def inference_features(log: DataFrame, targets: DataFrame, weather: DataFrame | None = None, history_rows: int = HISTORY_ROWS) -> DataFrame:
    """The serving feature row of each (subject, target_date).

    Lags and means look at each subject's last ``history_rows`` entries; with several entries
    a day that may be fewer days than the longest mean spans.

    ``targets`` has ``subject_id, target_date, location_id``. Weather defaults fill the
    derived features only; the raw columns stay null.
    """
    rows = inference_lags(log, targets, history_rows)
    if weather is not None:
        rows = rows.join(weather.withColumnRenamed("date", "target_date"), ["location_id", "target_date"], "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in (*WEATHER_COLUMNS, "pres_change")})

    def known(name: str) -> Column:
        return F.coalesce(name, F.lit(SERVING_DEFAULTS[name]))

    return rows.withColumns(
        {
            **cyclical(F.col("target_date")),
            "tdiff": known("tmax") - known("tmin"),
            "humid_tavg": known("average_humidity") * known("tavg"),
            "pres_change_lag1": F.lit(0.0),
            "tavg_lag1": known("tavg"),
            "sleep": F.lit(SLEEP_DEFAULT),
            "activity": F.lit(ACTIVITY_DEFAULT),
        }
    )


def circadian_prior(log: DataFrame) -> DataFrame:
    """Smoothed share of painful entries per start hour, scaled to a peak of 0.8.

    All 24 counts come from one aggregation per subject; the circle of hours is an
    array, so neighbours need neither a join nor a window.
    """
    hurt, hour = numeric_coerce(F.col("pain")) > 0, time_to_hour(F.col("time"))
    counts = log.groupBy("subject_id").agg(
        F.array(*[F.count_if(hurt & (hour == h)) for h in range(24)]).alias("counts"),
        F.count_if(hurt & (hour >= 0)).alias("total"),
    )

    def share(h: Column) -> Column:
        return F.get(F.col("counts"), F.pmod(h + 24, F.lit(24)).cast("int")) / F.col("total")

    before, own, after = SMOOTHING
    smooth = F.transform(
        F.sequence(F.lit(0), F.lit(23)), lambda h: share(h - 1) * before + share(h) * own + share(h + 1) * after
    )
    peak = F.array_max("smooth")
    scaled = F.when(F.col("total") == 0, F.lit(NO_HISTORY_PRIOR)).when(peak > 0, F.col("p") / peak * PEAK_PRIOR)
    return (
        counts.withColumn("smooth", F.when(F.col("total") > 0, smooth).otherwise(F.array_repeat(F.lit(0.0), 24)))
        .select("subject_id", "total", "smooth", F.posexplode("smooth").alias("hour", "p"))
        .select("subject_id", "hour", F.coalesce(scaled, F.lit(NO_HISTORY_PRIOR)).alias("prior"))
    )


def sample_weights(features: DataFrame) -> DataFrame:
    """Days within a year of the subject's last day weigh three times as much."""
    last = F.max("date").over(Window.partitionBy("subject_id"))
    return features.withColumn(
        "sample_weight", F.when(F.col("date") > F.date_sub(last, RECENT_DAYS), RECENT_WEIGHT).otherwise(1.0)
    )


def class_weights(features: DataFrame, label: str = "pain_binary") -> DataFrame:
    """Balanced weight per class, ``n / (2 * n_class)``; two rows at most."""
    counts = features.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n")).first()["n"] or 0
    return counts.withColumn("class_weight", F.lit(float(total)) / (F.lit(2.0) * F.col("n_class")))


def with_training_weights(features: DataFrame, label: str = "pain_binary") -> DataFrame:
    """Sample weight times class weight; the class table has one row per class."""
    weighted = sample_weights(features).join(F.broadcast(class_weights(features, label).drop("n_class")), label)
    return weighted.withColumn("train_weight", F.col("sample_weight") * F.col("class_weight"))
