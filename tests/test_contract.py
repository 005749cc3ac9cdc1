"""The registered queries as a whole: names, plans and agreement with their SQL."""

import os
import re

import pytest

import __spark_entry__ as entry
from almanac.operators import daily, usage
from almanac.queries import REGISTRY
from almanac.queries.bindings import BASE
from almanac.session import scratch_path
from almanac.sources import log as source

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="supplied tables are not here")

# These run Spark jobs while they are being built, so only their results can be looked at.
EAGER = re.compile(r"^(a1_|a3_|a5_|a6_|a8_|a9_|a11_save|i4_|i6_|k1_|k3_|j6_predict_day$|l1_add_entries$|m\d_)")


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {name for name, q in REGISTRY.items() if not q.sql} == {
        "k1_train_hurdle", "k3_cross_validate", "j6_predict_day", "a11_save_load_predict",
    }


@needs_data
def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["subject_id", "date", "pain", "probability", "risk_level"]
    assert out.where("risk_level not in ('Low', 'Moderate', 'High')").isEmpty() and not out.isEmpty()


@needs_data
def test_no_plan_has_a_product_a_python_row_function_or_a_global_window(spark):
    for name in REGISTRY:
        run = entry.queries()[name]
        if EAGER.search(name):
            continue
        plan = run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        for marker in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert marker not in plan, (name, marker)
        assert not re.search(r"Window .*\n.*\n.*SinglePartition", plan), name


@needs_data
@pytest.mark.parametrize(
    "name",
    ["daily_risk", "d4_past_12m_counts", "d12_trigger_usage_by_category", "c8_last_use_join", "e12_inference_lags", "j5_hourly_forecast", "l4_upsert_registry"],
)
def test_results_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)

    def lines(frame):
        return sorted(
            "|".join(f"{v:.9g}" if isinstance(v, float) else str(v)[:19].removesuffix(" 00:00:00") for v in row)
            for row in frame[columns].itertuples(index=False)
        )

    assert lines(got) == lines(want)


def test_range_scan_is_pushed_down_and_pruned(spark, make_log):
    path = scratch_path(spark, "pushdown")
    make_log([{"date": "2024-01-01", "pain": 1}]).write.parquet(path)
    df = source.scan_entries_range(source.scan_log(spark, path).select("subject_id", "entry_id", "date", "time"), "2023-01-01", "2025-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "LessThanOrEqual(date" in plan
    assert "notes" not in plan.split("ReadSchema")[1]


def test_limits_are_cut_before_the_shuffle(spark, make_log):
    log = make_log([{"date": "2024-01-01", "pain": 1, "triggers": "a"}])
    for df in (daily.recent_rows(log), source.history_sort(log, 5), usage.usage_topk(usage.trigger_counts(log))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Read upwards from the scan: a partial cut comes before the exchange by subject.
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_daily_aggregation_combines_before_the_shuffle(spark, make_log):
    plan = daily.daily_log_agg(make_log([{"date": "2024-01-01"}]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.count("Exchange") == 1 and "SortAggregate" not in plan
