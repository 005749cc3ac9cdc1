import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac import streaming
from almanac.operators import maintain
from almanac.plans import entries
from almanac.schemas import LOG, MEDICATIONS, TRIGGERS
from almanac.session import scratch_path
from almanac.sources import log as source
from almanac.sources.commits import REPLACE, TableSet
from almanac.streaming.incremental import schema_with_batch, stored_on, write_partitions

from helpers import rows

D = dt.date


def test_update_touches_supplied_columns_only(spark, make_log):
    log = make_log([{"entry_id": 1, "pain": 3, "notes": "a"}, {"entry_id": 2, "pain": 4, "notes": "b"}])
    changes = spark.createDataFrame([(1, 1, 9), (1, 7, 5)], "subject_id long, entry_id long, pain int")
    updated, unmatched = maintain.update_entries(log, changes)
    assert updated.schema == LOG
    assert rows(updated, "entry_id", "pain", "notes") == [(1, 9, "a"), (2, 4, "b")]
    assert rows(unmatched, "entry_id") == [(7,)]


def test_delete_reports_unknown_rows(spark, make_log):
    log = make_log([{"entry_id": 1}, {"entry_id": 2}])
    kept, unmatched = maintain.delete_entries(log, spark.createDataFrame([(1, 2), (1, 9)], "subject_id long, entry_id long"))
    assert rows(kept, "entry_id") == [(1,)] and rows(unmatched, "entry_id") == [(9,)]


def test_registry_changes(spark):
    registry = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "subject_id long, med_id long, name string")
    changes = spark.createDataFrame(
        [(1, 1, "b", "update"), (1, 2, None, "delete"), (1, 3, "  ", "update"), (1, 4, "a", "add"), (1, 5, "a", "add"), (1, 9, "x", "update")],
        "subject_id long, med_id long, name string, op string",
    )
    result, rejected = maintain.upsert_registry(registry, changes, "med_id")
    # Names freed by the same batch may be claimed by it.
    assert rows(result, "med_id", "name") == [(1, "b"), (3, "c"), (4, "a")]
    assert rows(rejected, "med_id", "reason") == [(3, "empty name"), (5, "name exists"), (9, "not found")]


def test_rename_cascade_handles_several_names_per_row(spark, make_log):
    log = make_log([{"triggers": "a, b,c"}, {"triggers": "ab"}, {"triggers": None}, {"subject_id": 2, "entry_id": 0, "triggers": "a"}])
    renames = spark.createDataFrame([(1, "a", "x "), (1, "b", "a")], "subject_id long, old_name string, new_name string")
    assert rows(maintain.rename_cascade(log, renames), "subject_id", "entry_id", "triggers") == [
        (1, 0, "x, a, c"), (1, 1, "ab"), (1, 2, None), (2, 0, "a"),
    ]
    assert rows(maintain.rename_one(log, 1, "c", "z"), "subject_id", "entry_id", "triggers")[0] == (1, 0, "a, b, z")


def test_rename_is_the_same_with_null_ids_repeats_and_large_batches(spark, make_log):
    log = make_log([{"entry_id": None, "triggers": "a, b"}, {"entry_id": None, "triggers": "a, b"}, {"entry_id": 7, "triggers": "b"}])
    few = [(1, "a", "y"), (1, "a", "x"), (1, "b", None), (None, "a", "z"), (1, None, "z")]
    many = few + [(1, f"other {i}", "z") for i in range(3000)] + [(i, "a", "w") for i in range(2, 2000)]
    for batch in (few, many):
        renames = spark.createDataFrame(batch, "subject_id long, old_name string, new_name string")
        assert rows(maintain.rename_cascade(log, renames), "triggers", "entry_id") == [("b", 7), ("x, b", None), ("x, b", None)]


def test_update_takes_one_change_a_row_and_clears_fields(spark, make_log):
    log = make_log([{"entry_id": 1, "pain": 3, "notes": "a"}, {"entry_id": 2, "pain": 4, "notes": "b"}])
    changes = spark.createDataFrame(
        [(1, 1, 9, "x", 1, None), (1, 1, 8, None, 2, ["notes"]), (1, 2, None, None, 1, [])],
        "subject_id long, entry_id long, pain int, notes string, at int, wiped array<string>",
    )
    updated, _ = maintain.update_entries(log, changes, version="at", cleared="wiped")
    assert rows(updated, "entry_id", "pain", "notes") == [(1, 8, None), (2, 4, "b")]
    plain, _ = maintain.update_entries(log, changes.drop("at", "wiped"))
    assert rows(plain, "entry_id", "pain", "notes") == [(1, 9, "x"), (2, 4, "b")]


def test_increment_ignores_unknown_names(spark):
    registry = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "b", 0)], "subject_id long, med_id long, name string, usage_count long")
    names = spark.createDataFrame([(1, " a "), (1, "a"), (1, "z")], "subject_id long, name string")
    assert rows(maintain.increment_usage(registry, names), "name", "usage_count") == [("a", 4), ("b", 0)]


def test_import_registry_folds_case(spark, make_log):
    registry = spark.createDataFrame([(1, "Advil")], "subject_id long, name string")
    log = make_log([{"medication": "advil, New, new"}, {"medications": '[{"name":"Other "}]'}])
    assert rows(maintain.import_registry(log, registry), "name", "frequency", "usage_count") == [("New", "as_needed", 0), ("Other", "as_needed", 0)]


def test_settings_latest_wins(spark):
    changes = spark.createDataFrame([(1, "k", "old", 1), (1, "k", "new", 2)], "subject_id long, key string, value string, version int")
    assert rows(maintain.upsert_settings(changes), "value") == [("new",)]


def test_dedup_with_one_hot_incomplete_key_keeps_all_rows(make_log):
    incoming = make_log([{"date": "2024-01-01", "time": None} for _ in range(500)] + [{"date": "2024-01-01", "time": "08:00"}])
    stored = make_log([{"date": "2024-01-01", "time": None}, {"date": "2024-01-01", "time": "08:00"}])
    assert maintain.anti_join_dedup(incoming, stored).count() == 500


# --- one write for several tables ---------------------------------------------------------


def stored(spark, root, make_log):
    store = TableSet(spark, root)
    meds = spark.createDataFrame([(1, 1, "Advil", None, None, "daily", None, 4), (1, 2, "Nope", None, None, "daily", None, 0)], MEDICATIONS)
    triggers = spark.createDataFrame([(1, 1, "Stress", 2, False, None), (2, 2, "Stress", 0, False, None)], TRIGGERS)
    store.commit({"log": (make_log([{"entry_id": 7, "date": "2024-01-01", "time": "08:00"}]), REPLACE), "medications": (meds, REPLACE), "triggers": (triggers, REPLACE)})
    return store


def incoming_rows(spark):
    schema = "subject_id long, Date string, time string, Pain_Level string, medications array<struct<name: string, dosage: string>>, triggers string, latitude string"
    data = [
        (1, "2024-02-01", "09:00", "4", [("Advil", "5mg"), ("Advil", None), ("New", ""), ("", "x")], "Stress, Rain,,Stress", "Unknown"),
        (1, "2024-13-01", "09:00", "4", [("Advil", None)], "Stress", "1.5"),
        (2, "2024-02-01", "10:00", "0", None, None, "[]"),
    ]
    return spark.createDataFrame(data, schema).withColumnRenamed("Pain_Level", "pain").withColumnRenamed("Date", "date")


def state(store):
    return (
        rows(store.read("log", LOG), "subject_id", "date", "medications", "triggers"),
        rows(store.read("medications", MEDICATIONS), "name", "usage_count"),
        rows(store.read("triggers", TRIGGERS), "subject_id", "name", "usage_count"),
    )


def test_entries_and_counters_become_visible_together(spark, make_log, tmp_path):
    store = stored(spark, str(tmp_path / "s"), make_log)
    number, rejected = entries.add_entries(store, incoming_rows(spark))
    assert number == 2 and rows(rejected, "date", "reject_reason") == [("2024-13-01", "invalid date")]
    log, meds, triggers = state(store)
    assert log == [
        (1, D(2024, 1, 1), None, None),
        (1, D(2024, 2, 1), '[{"name":"Advil","dosage":"5mg"},{"name":"Advil"},{"name":"New","dosage":""},{"name":"","dosage":"x"}]', "Stress, Rain,,Stress"),
        (2, D(2024, 2, 1), None, None),
    ]
    assert meds == [("Advil", 6), ("Nope", 0)] and triggers == [(1, "Stress", 4), (2, "Stress", 0)]
    ids = [r.entry_id for r in store.read("log", LOG).collect()]
    assert len(set(ids)) == 3 and sum(i > 7 for i in ids) == 2
    assert store.read("log", LOG, 1).count() == 1


def test_a_write_that_dies_half_way_leaves_the_old_state(spark, make_log, tmp_path, monkeypatch):
    store = stored(spark, str(tmp_path / "s"), make_log)
    before = state(store)
    stage = TableSet.stage

    def die(self, table, frame):
        if table == "triggers":
            raise OSError("lost")
        return stage(self, table, frame)

    monkeypatch.setattr(TableSet, "stage", die)
    with pytest.raises(OSError):
        entries.add_entries(store, incoming_rows(spark))
    assert state(store) == before and store.version() == 1
    monkeypatch.setattr(TableSet, "stage", stage)
    entries.add_entries(store, incoming_rows(spark))
    assert store.version() == 2 and state(store) != before


def test_a_commit_on_old_rows_is_refused(spark, make_log, tmp_path):
    store = stored(spark, str(tmp_path / "s"), make_log)
    folder = store.stage("log", make_log([{"entry_id": 8}]))
    store.commit({"log": (make_log([{"entry_id": 9}]), "append")})
    with pytest.raises(RuntimeError):
        store.publish({"log": (folder, REPLACE)}, 1)
    assert rows(store.read("log", LOG), "entry_id") == [(7,), (9,)]


def test_changes_are_cleaned_and_encoded(spark, make_log, tmp_path):
    store = stored(spark, str(tmp_path / "s"), make_log)
    schema = "subject_id long, entry_id long, Physical_Activity string, medications array<struct<name: string, dosage: string>>, latitude string"
    number, unmatched = entries.change_entries(store, spark.createDataFrame([(1, 7, "2", [("a", None)], "unknown"), (1, 99, None, None, None)], schema))
    assert number == 2 and rows(unmatched, "entry_id") == [(99,)]
    assert rows(store.read("log", LOG), "entry_id", "medications", "latitude") == [(7, '[{"name":"a"}]', None)]


def test_new_ids_depend_on_the_rows_alone(spark, make_log):
    data = [{"date": "2024-01-01", "time": f"{i % 24:02}:00", "notes": f"n{i % 40}"} for i in range(200)]
    held = make_log([{"entry_id": 500}])
    first = maintain.assign_entry_ids(make_log(data).drop("entry_id").repartition(7), held)
    again = maintain.assign_entry_ids(make_log(data[::-1]).drop("entry_id").coalesce(1), held)
    assert rows(first, "entry_id", "time", "notes") == rows(again, "entry_id", "time", "notes")
    ids = [r.entry_id for r in first.collect()]
    assert len(set(ids)) == 200 and min(ids) > 500


# --- streaming ---------------------------------------------------------------------------


STREAM = "subject_id long, date date, time string, ts timestamp_ntz, pain int, triggers string"


def drop(spark, path, number, data):
    spark.createDataFrame([(1, D.fromisoformat(d), t, dt.datetime.fromisoformat(f"{d}T{t}"), p, g) for d, t, p, g in data], STREAM).coalesce(
        1
    ).write.parquet(f"{path}/part={number}")


def test_stream_ingest_is_exact_across_batches(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, D(2024, 1, 1), "08:00", dt.datetime(2024, 1, 1, 8), 1, "x")], STREAM).write.parquet(f"{tmp_path}/seed")
    write_partitions(spark.read.parquet(f"{tmp_path}/seed"), store, -1)
    drop(spark, inbox, 1, [("2024-01-01", "08:00", 1, "x"), ("2024-01-09", "09:00", 2, "x"), ("2024-01-09", "09:00", 3, "x")])

    def run():
        stream = spark.readStream.schema(STREAM).parquet(f"{inbox}/*")
        streaming.ingest_dedup(stream, store, str(tmp_path / "state"), delay="1 day").awaitTermination()

    run()
    # A repeat inside the watermark, and one far behind it that only the store knows.
    drop(spark, inbox, 2, [("2024-01-09", "09:00", 2, "x"), ("2024-01-01", "08:00", 1, "x"), ("2024-01-10", "10:00", 5, "x")])
    run()
    run()
    out = spark.read.schema(schema_with_batch(spark.createDataFrame([], STREAM).schema)).parquet(store)
    assert rows(out, "date", "time") == [(D(2024, 1, 1), "08:00"), (D(2024, 1, 9), "09:00"), (D(2024, 1, 10), "10:00")]


def test_a_batch_reads_only_the_days_it_brings(spark, tmp_path):
    store = str(tmp_path / "store")
    drop(spark, str(tmp_path / "in"), 1, [(f"2024-01-{d:02}", "08:00", 1, "x") for d in range(1, 20)])
    write_partitions(spark.read.parquet(str(tmp_path / "in")).drop("part"), store, -1)
    schema = spark.createDataFrame([], STREAM).schema
    days = stored_on(spark, store, schema, [D(2024, 1, 3), D(2024, 1, 5)]).where(F.col("batch") < 4)
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(days.inputFiles()) >= 2 and days.count() == 2
    read = days._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters: []" in read


def test_replayed_batch_and_late_rows_change_nothing(spark, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    data = [("2024-01-01", "08:00", 1, "x"), ("2024-01-20", "09:00", 2, "x")]
    drop(spark, inbox, 1, data)

    def run(state):
        stream = spark.readStream.schema(STREAM).parquet(f"{inbox}/*")
        streaming.ingest_dedup(stream, store, str(tmp_path / state), delay="1 day").awaitTermination()
        return rows(spark.read.schema(schema_with_batch(stream.schema)).parquet(store), "date", "time", "batch")

    first = run("state")
    # the same batch number again, as after a failure before its commit
    assert run("lost state") == first
    # late rows: far past the watermark the state drops them; inside an old date the store knows them
    drop(spark, inbox, 2, [("2024-01-01", "08:00", 9, "x"), ("2024-01-20", "09:00", 9, "x"), ("2024-01-20", "10:00", 3, "x")])
    assert [(d, t) for d, t, _ in run("state")] == [(D(2024, 1, 1), "08:00"), (D(2024, 1, 20), "09:00"), (D(2024, 1, 20), "10:00")]


def test_stream_rollup_equals_the_batch_row_of_a_closed_day(spark, tmp_path):
    from almanac.operators.weather import weather_daily_rollup

    hourly = "location_id long, ts timestamp_ntz, temperature_2m double, relative_humidity_2m double, surface_pressure double, precipitation double, wind_speed_10m double"
    at = dt.datetime(2024, 1, 1)
    data = [(loc, at + dt.timedelta(hours=h), 10.0 + h % 24, None if loc == 2 else 40.0 + h, None if h < 24 else 990.0 + h, 0.5, None if loc else 3.0) for loc in range(3) for h in range(96)]
    spark.createDataFrame(data, hourly).repartition(2).write.parquet(str(tmp_path / "in"))
    days = spark.createDataFrame(
        [(0, D(2024, 1, 1), 99.0, -9.0, 7200.0), (1, D(2024, 1, 2), None, 1.0, None)],
        "location_id long, date date, temperature_2m_max double, temperature_2m_min double, sunshine_duration double",
    )
    stream = spark.readStream.schema(hourly).parquet(str(tmp_path / "in"))
    out = streaming.drain(streaming.weather_rollup(stream, days), "append", "t")
    want = weather_daily_rollup(spark.read.parquet(str(tmp_path / "in")), days).where("date < date '2024-01-03'")
    columns = sorted(want.columns)
    assert len(rows(want, *columns)) == 6 and rows(out, *columns) == rows(want, *columns)


def test_stream_daily_max_drops_late_rows_and_waits_for_the_watermark(spark, tmp_path):
    inbox = str(tmp_path / "in")
    drop(spark, inbox, 1, [("2024-01-01", "08:00", 3, "x"), ("2024-01-05", "08:00", 1, "x")])
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(f"{inbox}/*")
    assert rows(streaming.drain(streaming.daily_max(stream, "1 day"), "append", "t"), "date", "pain") == [(D(2024, 1, 1), 3.0)]


def test_stream_usage_counts_accumulate(spark, tmp_path):
    inbox = str(tmp_path / "in")
    drop(spark, inbox, 1, [("2024-01-01", "08:00", 3, "a, b,a")])
    drop(spark, inbox, 2, [("2024-01-02", "08:00", 3, "a")])
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(f"{inbox}/*")
    out = streaming.drain(streaming.usage_counts(stream), "update", "t")
    final = out.groupBy("name").agg(F.max_by("uses", "batch").alias("uses"))
    assert rows(final, "name", "uses") == [("a", 3), ("b", 1)]


def test_timeline_is_written_by_year(spark, make_log):
    from almanac.operators.daily import dense_timeline

    path = scratch_path(spark, "test-timeline")
    source.write_timeline(dense_timeline(make_log([{"date": "2023-12-30", "pain": 1}, {"date": "2024-01-02", "pain": 2}])), path)
    assert spark.read.parquet(path).where("year = 2024").count() == 2
