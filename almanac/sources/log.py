"""Log scans, imports and stores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import numeric_coerce
from ..operators.clean import conform_schema, require_columns, valid_pain
from ..operators.maintain import assign_entry_ids, flag_stored, import_summary
from ..schemas import EXPORT_NAMES, LOG, REQUIRED_IMPORT_COLUMNS


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with a fixed schema; a missing path is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """A1. Columns a file lacks come back as nulls (additive schema change)."""
    return read_or_empty(spark, path, LOG)


def scan_entries_range(log: DataFrame, start=None, end=None) -> DataFrame:
    """A2: inclusive optional bounds, newest first; the bounds reach the Parquet scan.

    The sort key ends in the row id, so a range sort can split any run of equal days.
    """
    if start is not None:
        log = log.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        log = log.where(F.col("date") <= F.lit(end).cast("date"))
    return log.orderBy(F.col("date").desc(), F.col("time").desc(), "subject_id", "entry_id")


def history_sort(log: DataFrame, limit: int) -> DataFrame:
    """F1 with a limit: each subject's newest ``limit`` rows, numbered in display order."""
    order = Window.partitionBy("subject_id").orderBy(F.col("date").desc(), F.col("time").desc(), "entry_id")
    return log.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def judge_import(incoming: DataFrame, subject_id: int | None = None) -> DataFrame:
    """Rows of an exported file as text, with ``reject_reason`` (null for good rows).

    Checks the required columns. A row is rejected for a pain that is no number from 0 to 10
    or a date that is no ``YYYY-MM-DD`` day; its text stays as it was read.
    """
    renamed = incoming.withColumnsRenamed({k: v for k, v in EXPORT_NAMES.items() if k in incoming.columns})
    require_columns(renamed, REQUIRED_IMPORT_COLUMNS)
    if subject_id is not None:
        renamed = renamed.withColumn("subject_id", F.lit(subject_id).cast("bigint"))
    day = F.col("date").cast("string")
    readable = day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    return renamed.withColumn(
        "reject_reason",
        F.when(~F.coalesce(valid_pain(F.col("pain")), F.lit(False)), "invalid pain").when(~F.coalesce(readable, F.lit(False)), "invalid date"),
    )


def prepare_import(incoming: DataFrame, stored: DataFrame, subject_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of an exported file -> (rows to append, D20 summary).

    Rejected rows (see :func:`judge_import`) are only counted, so the stored log never gets a
    null date; unknown columns and the foreign row id are dropped, and so are rows whose
    (date, time) is stored. What remains gets fresh ids. Pain is cut to a whole number.
    """
    judged = judge_import(incoming, subject_id)
    good = judged.where("reject_reason is null").drop("entry_id", "reject_reason")
    typed = conform_schema(good.withColumn("pain", numeric_coerce(F.col("pain"))), LOG).drop("entry_id")
    rejected = judged.where("reject_reason is not null").select(F.col("subject_id").try_cast("bigint").alias("subject_id"))
    flagged = flag_stored(typed, stored)
    return _fresh(flagged, stored), import_summary(flagged, stored, rejected)


def _fresh(flagged: DataFrame, stored: DataFrame) -> DataFrame:
    rows = assign_entry_ids(flagged.where(~F.col("is_stored")).drop("is_stored"), stored)
    return rows.select(*[f.name for f in LOG])


def ingest_csv(
    spark: SparkSession, path: str, stored: DataFrame, subject_id: int | None = None, line_breaks: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A3: read everything as text, so times and ids are never re-typed by guesswork.

    Quotes inside a cell are doubled, and a quoted cell may contain line breaks; reading those
    makes each file one task. ``line_breaks=False`` declares files without any, which
    then stay splittable. Inner blanks are kept.
    """
    return prepare_import(read_csv(spark, path, line_breaks), stored, subject_id)


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    return spark.read.options(header=True, escape='"', multiLine=line_breaks).csv(path)


def ingest_store(incoming: DataFrame, stored: DataFrame, subject_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A4: merge another log store under fresh ids; rows without a date are only counted as rejected."""
    if subject_id is not None:
        incoming = incoming.withColumn("subject_id", F.lit(subject_id).cast("bigint"))
    typed = conform_schema(incoming, LOG).drop("entry_id")
    flagged = flag_stored(typed.where("date is not null"), stored)
    return _fresh(flagged, stored), import_summary(flagged, stored, typed.where("date is null").select("subject_id"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def register_store(log: DataFrame, root: str, subject_id: int) -> None:
    """A5: add a store beside the others, unmerged; refuses to replace one."""
    log.drop("subject_id").write.mode("error").parquet(f"{root}/subject_id={subject_id}")


def union_stores(spark: SparkSession, root: str) -> DataFrame:
    """A5: all registered stores as one table; a filter on the subject prunes folders."""
    return read_or_empty(spark, root, LOG)


def list_stores(spark: SparkSession, root: str) -> DataFrame:
    return union_stores(spark, root).select("subject_id").distinct()


def write_timeline(timeline: DataFrame, path: str) -> None:
    """One folder per year, so date filters skip folders."""
    timeline.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)
