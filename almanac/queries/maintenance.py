"""Table changes."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import maintain
from ..plans import entries
from ..schemas import LOG, MEDICATIONS, TRIGGERS
from ..session import scratch_path
from ..sources.commits import REPLACE, TableSet
from .base import SETTINGS, Tables, json_names, legacy_names, query, with_tables
from .cleaning import REASONS

# Change batches derived from the tables themselves.
CHANGES = (
    "changes as (select cast(c_nationkey as bigint) as subject_id, o_orderkey as entry_id, "
    "case when o_orderkey % 2 = 0 then null else cast(o_totalprice % 10 as int) end as pain, 'edited ' || o_orderpriority as notes "
    "from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' "
    "union all select cast(c_nationkey as bigint), -1 - c_custkey, 5, 'missing' from customer)"
)
CHANGES_SPARK = CHANGES.removeprefix("changes as (").removesuffix(")").replace("from orders", "from {orders}").replace(
    "join customer", "join {customer}"
).replace("from customer", "from {customer}").replace("cast(o_totalprice % 10 as int)", "cast(floor(o_totalprice % 10) as int)")
CHANGES = CHANGES.replace("cast(o_totalprice % 10 as int)", "cast(floor(o_totalprice % 10) as int)")


def changes_of(t: Tables):
    return t.spark.sql(CHANGES_SPARK, orders=t.orders, customer=t.customer)


@query(
    "c2_anti_join_dedup",
    with_tables("raw_log", "log", extra="typed as (select *, try_cast(case when regexp_matches(date, '^\\d{4}-') then date end as date) as day from raw_log)")
    + "select entry_id, subject_id, day as date, time from typed s where not exists (select 1 from log m "
    "where m.subject_id = s.subject_id and m.date = s.day and m.time = s.time)",
)
def anti_join_dedup(t: Tables):
    incoming = t.raw_log.select("entry_id", "subject_id", F.try_to_date("date", "yyyy-MM-dd").alias("date"), "time")
    return maintain.anti_join_dedup(incoming, t.log)


@query(
    "g3_novel_rows",
    with_tables("log_short", "log")
    + "select l.subject_id, l.date, l.time, count(*) as n from log l where not exists (select 1 from log_short s where s.subject_id = l.subject_id "
    "and s.time = l.time and s.date = l.date) group by 1, 2, 3",
)
def novel_rows(t: Tables):
    rows = maintain.anti_join_dedup(t.log.select("subject_id", "date", "time"), t.log_short)
    return rows.groupBy("subject_id", "date", "time").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l2_update_entries",
    with_tables("log", extra=CHANGES)
    + "select l.subject_id, l.entry_id, coalesce(c.pain, l.pain) as pain, coalesce(c.notes, l.notes) as notes, l.time from log l "
    "left join changes c on c.subject_id = l.subject_id and c.entry_id = l.entry_id",
)
def update_entries(t: Tables):
    updated, _ = maintain.update_entries(t.log, changes_of(t))
    return updated.select("subject_id", "entry_id", "pain", "notes", "time")


@query(
    "l2_update_unmatched",
    with_tables("log", extra=CHANGES)
    + "select subject_id, entry_id, pain, notes from changes c where not exists (select 1 from log l where l.subject_id = c.subject_id and l.entry_id = c.entry_id)",
)
def update_unmatched(t: Tables):
    _, unmatched = maintain.update_entries(t.log, changes_of(t))
    return unmatched.select("subject_id", "entry_id", "pain", "notes")


@query(
    "l3_delete_entries",
    with_tables("log", extra=CHANGES)
    + "select subject_id, entry_id, date from log l where not exists (select 1 from changes c where l.subject_id = c.subject_id and l.entry_id = c.entry_id)",
)
def delete_entries(t: Tables):
    kept, _ = maintain.delete_entries(t.log, changes_of(t))
    return kept.select("subject_id", "entry_id", "date")


# Registry changes: supplier rows ask for additions, part rows for renames and removals.
REGISTRY_CHANGES = """registry_changes as (
  select p_partkey % 25 as subject_id, p_partkey as med_id,
    case p_partkey % 10 when 0 then ' ' when 1 then 'med1' else ' renamed ' || cast(p_partkey as {text}) || ' ' end as name,
    'update' as op from part where p_size < 10
  union all select p_partkey % 25, p_partkey, 'gone', 'delete' from part where p_size > 45
  union all select cast(s_nationkey as bigint), 1000000000 + s_suppkey, 'new ' || cast(cast(floor(s_suppkey / 2) as bigint) as {text}), 'add' from supplier
  union all select cast(s_nationkey as bigint), 2000000000 + s_suppkey, 'x', 'delete' from supplier)"""


def registry_changes_of(t: Tables):
    text = REGISTRY_CHANGES.removeprefix("registry_changes as (").removesuffix(")").format(text="string")
    text = text.replace("from part", "from {part}").replace("from supplier", "from {supplier}")
    rows = t.spark.sql(text, part=t.part, supplier=t.supplier)
    missing = [c for c in t.medications.columns if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast(t.medications.schema[c].dataType) for c in missing})


_JUDGED = REGISTRY_CHANGES.format(text="varchar") + """,
cleaned as (select subject_id, med_id, trim(name) as name, op from registry_changes),
kept as (select * from medications m where not exists (select 1 from registry_changes c where c.op <> 'add' and c.subject_id = m.subject_id and c.med_id = m.med_id)),
judged as (select c.*, case
    when op <> 'add' and m.med_id is null then 'not found'
    when op = 'delete' then null
    when c.name = '' then 'empty name'
    when op = 'add' and m.med_id is not null then 'id exists'
    when exists (select 1 from kept k where k.subject_id = c.subject_id and k.name = c.name)
      or c.med_id <> min(c.med_id) filter (where op <> 'delete') over (partition by c.subject_id, c.name) then 'name exists' end as reason
  from cleaned c left join (select subject_id, med_id from medications) m on m.subject_id = c.subject_id and m.med_id = c.med_id)"""


@query(
    "l4_upsert_registry",
    with_tables("medications", extra=_JUDGED)
    + "select subject_id, med_id, name from medications m where not exists (select 1 from judged j where j.reason is null and j.op <> 'add' "
    "and j.subject_id = m.subject_id and j.med_id = m.med_id) union all select subject_id, med_id, name from judged where reason is null and op <> 'delete'",
)
def upsert_registry(t: Tables):
    result, _ = maintain.upsert_registry(t.medications, registry_changes_of(t), "med_id")
    return result.select("subject_id", "med_id", "name")


@query(
    "l4_upsert_rejected",
    with_tables("medications", extra=_JUDGED) + "select subject_id, med_id, op, name, reason from judged where reason is not null",
)
def upsert_rejected(t: Tables):
    _, rejected = maintain.upsert_registry(t.medications, registry_changes_of(t), "med_id")
    return rejected.select("subject_id", "med_id", "op", "name", "reason")


RENAMES = (
    "renames as (select distinct cast(c_nationkey as bigint) as subject_id, lower(c_mktsegment) as old_name, "
    "lower(c_mktsegment) || ' ' || cast(c_nationkey as {text}) as new_name from customer where c_mktsegment in ('BUILDING', 'MACHINERY') "
    "union all select distinct cast(c_nationkey as bigint), 'Stress', 'Work stress' from customer)"
)
_ITEMS = "list_transform(string_split(l.triggers, ','), lambda x: trim(x))"


@query(
    "l5_rename_cascade",
    with_tables("log", extra=RENAMES.format(text="varchar") + ", maps as (select subject_id, list(old_name) as olds, list(new_name) as news from renames group by subject_id)")
    + f"select l.subject_id, l.entry_id, case when list_has_any({_ITEMS}, m.olds) then array_to_string(list_transform({_ITEMS}, "
    "lambda x: coalesce(m.news[list_position(m.olds, x)], x)), ', ') else l.triggers end as triggers from log l "
    "left join maps m on m.subject_id = l.subject_id",
)
def rename_cascade(t: Tables):
    text = RENAMES.removeprefix("renames as (").removesuffix(")").format(text="string").replace("from customer", "from {customer}")
    renames = t.spark.sql(text, customer=t.customer)
    return maintain.rename_cascade(t.log, renames).select("subject_id", "entry_id", "triggers")


@query(
    "l6_increment_usage",
    with_tables("log", "medications", extra=f"items as (select subject_id, unnest({legacy_names('medication')}) as item from log), "
    "counts as (select subject_id, trim(item) as name, count(*) as uses from items group by 1, 2)")
    + "select m.med_id, m.name, m.usage_count + coalesce(c.uses, 0) as usage_count from medications m "
    "left join counts c on c.subject_id = m.subject_id and c.name = m.name",
)
def increment_usage(t: Tables):
    from ..functions import split_list

    names = t.log.select("subject_id", F.explode(split_list(F.col("medication"))).alias("name"))
    return maintain.increment_usage(t.medications, names).select("med_id", "name", "usage_count")


@query("l8_upsert_settings", with_tables("settings_changes", extra=SETTINGS) + "select subject_id, key, value from settings")
def upsert_settings(t: Tables):
    return maintain.upsert_settings(t.settings_changes)


def _names_sql(table: str) -> str:
    return f"select subject_id, unnest({json_names('medications')}) as name from {table}"


_SAVED = REASONS + f""",
valid as (select * from reasons where reject_reason is null),
med_uses as (select subject_id, trim(name) as name, count(*) as uses from ({_names_sql('valid')}) where name <> '' group by 1, 2),
trigger_uses as (select subject_id, name, count(*) as uses from (
  select subject_id, unnest({legacy_names('triggers')}) as name from valid) group by 1, 2)"""


@query(
    "l1_add_entries",
    with_tables("raw_log", "log", "medications", "triggers", extra=_SAVED)
    + "select 'log' as part, subject_id, coalesce(triggers, '') as name, count(*) as n from ("
    "select subject_id, triggers from log union all select subject_id, triggers from valid) group by 2, 3 "
    f"union all select 'listed', subject_id, name, count(*) from ({_names_sql('log')} union all {_names_sql('valid')}) group by 2, 3 "
    "union all select 'medications', m.subject_id, m.name, usage_count + coalesce(uses, 0) from medications m "
    "left join med_uses u on u.subject_id = m.subject_id and u.name = m.name "
    "union all select 'triggers', t.subject_id, t.name, usage_count + coalesce(uses, 0) from triggers t "
    "left join trigger_uses u on u.subject_id = t.subject_id and u.name = t.name",
)
def add_entries(t: Tables):
    store = TableSet(t.spark, scratch_path(t.spark, "store"))
    store.commit({"log": (t.log, REPLACE), "medications": (t.medications, REPLACE), "triggers": (t.triggers, REPLACE)})
    entries.add_entries(store, t.raw_log.withColumn("medications", fn.parse_meds(F.col("medications"))))
    log = store.read("log", LOG)
    listed = log.select("subject_id", F.explode(fn.med_names(F.col("medications"))).alias("name"))
    counted = [
        rows.groupBy("subject_id", "name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "subject_id", "name", "n")
        for part, rows in (("log", log.select("subject_id", F.coalesce("triggers", F.lit("")).alias("name"))), ("listed", listed))
    ]
    registries = [
        store.read(part, schema).select(F.lit(part).alias("part"), "subject_id", "name", F.col("usage_count").alias("n"))
        for part, schema in (("medications", MEDICATIONS), ("triggers", TRIGGERS))
    ]
    return counted[0].unionByName(counted[1]).unionByName(registries[0]).unionByName(registries[1])
