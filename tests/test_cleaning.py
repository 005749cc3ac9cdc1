import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac import functions as fn
from almanac.operators import clean, maintain
from almanac.operators.timeseries import inference_lags
from almanac.schemas import LOG
from almanac.sources import log as source

from helpers import rows


def text(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


@pytest.mark.parametrize("value", ["Unknown", "unknown", "", "   ", "[]"])
def test_placeholder_coordinates_become_null(spark, value):
    df = spark.createDataFrame([(value, "7.5")], "Latitude string, Longitude string")
    assert rows(clean.sanitize_entries(df), "Latitude", "Longitude") == [(None, "7.5")]


def test_old_keys_are_renamed(spark):
    df = spark.createDataFrame([(5, "2", 1010)], "Pain_Level int, Physical_Activity string, weather_pressure int")
    assert clean.sanitize_entries(df).columns == ["Pain Level", "Physical Activity", "pressure"]


def test_unknown_columns_are_dropped_and_missing_ones_null(spark):
    df = spark.createDataFrame([(1, "08:00", 1010)], "subject_id int, time string, pressure int")
    out = clean.conform_schema(df, LOG)
    assert out.schema == LOG
    assert rows(out, "subject_id", "time", "pain") == [(1, "08:00", None)]


def test_pain_validation(spark):
    df = spark.createDataFrame([("4",), ("15",), ("bad",), (None,), ("-1",), ("nan",), ("0",), ("10",)], "pain string")
    assert rows(clean.validate_pain(df), "pain") == [(0.0,), (4.0,), (10.0,)]


@pytest.mark.parametrize(
    "date, time, reason",
    [
        ("10-10-2023", "08:00", "invalid date format"),
        ("2023-02-30", "08:00", "invalid date"),
        ("2023-10-10", "1200", "invalid time format"),
        ("2023-10-10", "24:10", "invalid time"),
        ("2023-10-10", "23:59", None),
        (None, "08:00", "invalid date format"),
    ],
)
def test_date_and_time_reasons(spark, date, time, reason):
    df = spark.createDataFrame([(date, time)], "date string, time string")
    assert clean.validate_date_time(df).first()["reject_reason"] == reason


def test_missing_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="time"):
        clean.require_columns(spark.createDataFrame([(1, 2)], "date int, pain int"), ("date", "time", "pain"))


def test_read_sanitize(spark):
    df = spark.createDataFrame(
        [(1, 1, "3.9", "5", None, "[]", None), (1, 2, "bad", '[{"name":"a"}]', "x", "", "2.5"), (1, 3, "nan", "{}", None, "7", None)],
        "subject_id long, entry_id long, pain string, medications string, notes string, latitude string, longitude string",
    )
    out = clean.read_sanitize(df).withColumn("n", F.size("medications"))
    assert rows(out, "entry_id", "pain", "n", "notes", "latitude", "longitude") == [
        (1, 3, 0, "", None, None), (2, 0, 1, "x", None, 2.5), (3, 0, 0, "", 7.0, None),
    ]


def test_legacy_medications_migrate_whole(make_log):
    log = make_log([{"medication": "a, b", "dosage": None}, {"medication": "a", "medications": "[]"}, {"medication": ""}])
    assert rows(clean.migrate_legacy_meds(log), "entry_id", "medications") == [
        (0, '[{"name":"a, b","dosage":""}]'), (1, "[]"), (2, None),
    ]


@pytest.mark.parametrize(
    "value, names",
    [
        ('[{"name":"a"},{"name":"b","dosage":"5"}]', ["a", "b"]),
        ('{"name":"a"}', []),
        ("not json", []),
        ('[{"name":"a"}', []),
        ('[{"name":"a"},7,{"dosage":"x"},null]', ["a"]),
        ('[{"name":"a"}] and more', []),
        (' [{"name":5}] ', ["5"]),
        ('[{"name":"a"}, {"name":"b"]', []),
        ("[]", []),
        (None, []),
    ],
)
def test_medication_json(spark, value, names):
    assert text(spark, [value]).select(fn.med_names(F.col("x"))).first()[0] == names


def test_split_list_strips_and_drops_blanks(spark):
    out = text(spark, ["Stress, Rain,,stress ", None, "\tx\n, "]).select(fn.split_list(F.col("x")).alias("l")).collect()
    assert [r.l for r in out] == [["Stress", "Rain", "stress"], [], ["x"]]


def test_rename_in_list_only_exact_items(spark):
    values = ["Stress, Rain", "Stressful", "rain,Stress ,Stress", None]
    out = text(spark, values).select(fn.rename_in_list(F.col("x"), F.lit("Stress"), F.lit(" Work ")).alias("y")).collect()
    assert [r.y for r in out] == ["Work, Rain", "Stressful", "rain, Work, Work", None]


def test_effective_medications_label(spark):
    df = spark.createDataFrame(
        [('[{"name":"a","dosage":"5mg"},{"name":"b"}]', "c", "d"), ("[]", "c", "9mg"), (None, "", "x"), (None, None, None)],
        "m string, legacy string, dosage string",
    )
    label = fn.medication_label(fn.effective_medications(F.col("m"), F.col("legacy"), F.col("dosage")))
    assert [r[0] for r in df.select(label).collect()] == ["a (5mg), b", "c (9mg)", "", ""]


@pytest.mark.parametrize("value, minutes", [("08:30", 510), ("8:5", 485), ("bad", 0), (None, 0), ("1:2:3", 0)])
def test_time_to_minutes(spark, value, minutes):
    assert text(spark, [value]).select(fn.time_to_minutes(F.col("x"))).first()[0] == minutes


@pytest.mark.parametrize("value, expected", [("34.05,-118.25", (34.05, -118.25)), ("34.05", (None, None)), (None, (None, None))])
def test_loc_parse(spark, value, expected):
    lat, lon = fn.loc_parse(F.col("x"))
    assert tuple(text(spark, [value]).select(lat, lon).first()) == expected


@pytest.mark.parametrize("x, digits, expected", [(0.125, 2, 0.13), (0.145, 2, 0.15), (2.25, 1, 2.3), (0.705 - 1e-16, 2, 0.71)])
def test_rounding_is_half_up(spark, x, digits, expected):
    assert spark.range(1).select(fn.round_half_up(F.lit(x), digits)).first()[0] == pytest.approx(expected, abs=1e-12)


def test_risk_scales(spark):
    df = spark.createDataFrame([(0.2,), (0.3,), (0.61,), (0.7,)], "p double")
    out = df.select(fn.risk_level_rules(F.col("p")), fn.risk_level_model(F.col("p")), fn.risk_level_calibrated(F.col("p") * 100)).collect()
    assert [tuple(r) for r in out] == [
        ("Low", "Low", "Low"), ("Moderate", "Moderate", "Moderate"), ("Moderate", "High", "High"), ("High", "High", "High"),
    ]


# --- imports ---------------------------------------------------------------------------


def incoming(spark, data):
    return spark.createDataFrame(data, "Date string, Time string, `Pain Level` string")


@pytest.mark.parametrize(
    "stored, data, imported, skipped",
    [
        ([], [("2024-01-01", "08:00", "3"), ("2024-01-02", "08:00", "4")], 2, 0),
        ([{"date": "2024-01-01", "time": "08:00"}], [("2024-01-01", "08:00", "3"), ("2024-01-02", "08:00", "4")], 1, 1),
        ([{"date": "2024-01-01", "time": "08:00"}], [("2024-01-01", "08:00", "3")], 0, 1),
        ([], [("2024-01-01", "08:00", "4"), ("2024-01-02", "08:00", "15"), ("2024-01-03", "08:00", "bad")], 1, 0),
        ([{"date": "2024-01-01", "time": None}], [("2024-01-01", None, "3")], 1, 0),
        ([], [("2024-01-01", "08:00", "3"), ("2024-01-01", "08:00", "3")], 2, 0),
    ],
)
def test_import_counts(spark, make_log, stored, data, imported, skipped):
    new, summary = source.prepare_import(incoming(spark, data), make_log(stored), subject_id=1)
    assert new.count() == imported
    assert rows(summary, "imported_rows", "skipped_rows", "total_rows") == [(imported, skipped, len(stored) + imported)]


def test_import_needs_its_columns(spark, make_log):
    with pytest.raises(ValueError, match="time"):
        source.prepare_import(spark.createDataFrame([("2024-01-01", "3")], "Date string, `Pain Level` string"), make_log([]), 1)


def test_store_merge_ignores_foreign_ids(make_log):
    stored = make_log([{"entry_id": 1, "date": "2024-01-01", "time": "08:00"}])
    other = make_log([{"entry_id": 1, "date": "2024-01-02", "time": "08:00"}, {"entry_id": 2, "date": "2024-01-01", "time": "08:00"}])
    new, summary = source.ingest_store(other, stored)
    assert new.count() == 1 and rows(summary, "imported_rows", "skipped_rows") == [(1, 1)]


def test_csv_roundtrip(spark, make_log, tmp_path):
    path = str(tmp_path / "log.csv")
    with open(path, "w") as f:
        f.write("id,Date,Time,Pain Level,Triggers,pressure\n5,2024-01-01,08:00,4,\"a, b\",1010\n6,2024-01-02,09:00,x,,\n")
    new, summary = source.ingest_csv(spark, path, make_log([]), subject_id=3)
    assert rows(new, "subject_id", "time", "pain", "triggers") == [(3, "08:00", 4, "a, b")]
    assert rows(summary, "imported_rows", "skipped_rows", "total_rows") == [(1, 0, 1)]


def test_csv_with_quotes_line_breaks_and_bad_dates_twice(spark, make_log, tmp_path):
    path, store = str(tmp_path / "log.csv"), str(tmp_path / "store")
    with open(path, "w") as f:
        f.write('Date,Time,Pain Level,Medications,Notes\n')
        f.write('2024-01-01,08:00,4,"[{""name"": ""A"", ""dosage"": ""1""}]","two\nlines, one cell"\n')
        f.write("01.02.2024,09:00,3,,\n2024-02-30,09:00,3,,\n2024-01-03,09:00,5,,plain\n")
    make_log([{"entry_id": 5, "date": "2023-01-01", "time": "08:00", "pain": 1}]).write.parquet(store)
    counts = []
    for _ in range(2):
        new, summary = source.ingest_csv(spark, path, source.scan_log(spark, store), subject_id=1)
        counts += rows(summary, "imported_rows", "skipped_rows", "rejected_rows", "total_rows")
        source.append_log(new, store)
    assert counts == [(2, 0, 2, 3), (0, 2, 2, 3)]
    log = source.scan_log(spark, store)
    assert rows(log.where("date >= '2024-01-01'"), "medications", "notes") == [(None, "plain"), ('[{"name": "A", "dosage": "1"}]', "two\nlines, one cell")]
    ids = [r.entry_id for r in log.collect()]
    assert len(set(ids)) == 3 and min(ids) == 5
    assert {r.reject_reason for r in source.judge_import(source.read_csv(spark, path), 1).collect()} == {None, "invalid date"}


def test_a_row_without_a_date_does_not_stop_serving(spark, make_log):
    log = make_log([{"date": None, "pain": 9}, {"date": None, "pain": 8}, {"date": "2024-01-01", "pain": 5}])
    targets = spark.createDataFrame([(1, dt.date(2024, 1, 2))], "subject_id long, target_date date")
    assert rows(inference_lags(log, targets), "pain_lag_1", "pain_lag_2") == [(5.0, 0.0)]


def test_missing_log_is_empty(spark, tmp_path):
    assert source.scan_log(spark, str(tmp_path / "nothing")).count() == 0


def test_stores_union_and_refuse_overwrite(spark, make_log, tmp_path):
    root = str(tmp_path / "stores")
    source.register_store(make_log([{"date": "2024-01-01"}]), root, 7)
    source.register_store(make_log([{"date": "2024-01-02"}, {"date": "2024-01-03"}]), root, 8)
    assert rows(source.union_stores(spark, root).groupBy("subject_id").count(), "subject_id", "count") == [(7, 1), (8, 2)]
    assert rows(source.list_stores(spark, root), "subject_id") == [(7,), (8,)]
    with pytest.raises(Exception):
        source.register_store(make_log([{"date": "2024-01-01"}]), root, 7)


def test_fresh_ids_are_unique_and_above(make_log):
    out = maintain.assign_entry_ids(make_log([{} for _ in range(20)]).repartition(5), make_log([{"entry_id": 100}, {"entry_id": 3}]))
    ids = [r.entry_id for r in out.collect()]
    assert len(set(ids)) == 20 and min(ids) > 100


def test_insert_splits_good_and_bad(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", "08:00", None, None, "Unknown"), (2, "2024-13-01", "08:00", "a", "b", "1")],
        "entry_id long, date string, time string, medication string, dosage string, latitude string",
    )
    good, bad = maintain.insert_entries(df)
    assert rows(good, "entry_id", "medication", "latitude") == [(1, "", None)]
    assert rows(bad, "entry_id", "reject_reason") == [(2, "invalid date")]
