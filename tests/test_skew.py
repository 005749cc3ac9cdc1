"""A key with most of the rows must be split over tasks, and the result stay whole."""

import pytest
from pyspark.sql import functions as F

from almanac.operators import maintain, usage


@pytest.fixture
def eager_splits(spark):
    """Thresholds small enough for a test table to count as skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_import_splits_a_hot_key(spark, eager_splits):
    incoming = spark.range(0, 60_000, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("subject_id"),
        F.lit("2024-01-01").cast("date").alias("date"),
        F.when(F.col("id") % 3 == 0, "08:00").otherwise(F.col("id").cast("string")).alias("time"),
        F.sha2(F.col("id").cast("string"), 256).alias("notes"),
    )
    stored = incoming.where("subject_id <> 0").limit(1000).select("subject_id", "date", "time")
    out = maintain.anti_join_dedup(incoming, stored)
    assert len(out.collect()) == 59_000
    assert "skew=true" in final_plan(out)


def test_shares_split_a_hot_subject(spark, eager_splits):
    counts = spark.range(0, 60_000, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("subject_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("name"),
        F.lit(1).cast("bigint").alias("uses"),
    )
    out = usage.with_share(counts)
    got = out.where("subject_id = 0").select("total").distinct()
    result = out.collect()
    assert len(result) == 60_000 and [r.total for r in got.collect()] == [20_000 + 80]
    assert "skew=true" in final_plan(out)
