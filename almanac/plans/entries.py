"""L1, L2 as one write: log rows and usage counters change together or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.clean import conform_schema, sanitize_entries
from ..operators.maintain import assign_entry_ids, encode_entries, increment_usage, insert_entries, update_entries
from ..schemas import LOG, MEDICATIONS, TRIGGERS
from ..session import Written
from ..sources.commits import APPEND, REPLACE, TableSet


def add_entries(store: TableSet, incoming: DataFrame) -> tuple[int, DataFrame]:
    """L1: clean, validate, encode and append rows, and count the names they use, as one commit.

    Returns the commit's number and the rejected rows. The log grows by a folder; the two
    registries, one row a name, are written anew with their counters raised.
    """
    before = store.version()
    good, rejected = insert_entries(incoming)
    good = Written(good, "entries")
    encoded, medications, triggers = encode_entries(good.frame)
    rows = assign_entry_ids(conform_schema(encoded, LOG).drop("entry_id"), store.read("log", LOG, before))
    staged = {"log": (store.stage("log", rows.select(*LOG.names)), APPEND)}
    for table, schema, names in (("medications", MEDICATIONS, medications), ("triggers", TRIGGERS, triggers)):
        staged[table] = (store.stage(table, increment_usage(store.read(table, schema, before), names)), REPLACE)
    number = store.publish(staged, before)
    good.drop()
    return number, rejected


def change_entries(store: TableSet, changes: DataFrame, version: str | None = None, cleared: str | None = None) -> tuple[int, DataFrame]:
    """L2: sanitize and encode a change set and apply it as one commit.

    Returns the commit's number and the changes whose row is not there. Counters stay: an edit
    is no new use.
    """
    before = store.version()
    clean = sanitize_entries(changes)
    if "medications" in clean.columns and isinstance(clean.schema["medications"].dataType, T.ArrayType):
        clean = clean.withColumn("medications", F.to_json("medications"))
    updated, unmatched = update_entries(store.read("log", LOG, before), clean, version, cleared)
    number = store.publish({"log": (store.stage("log", updated), REPLACE)}, before)
    return number, unmatched
