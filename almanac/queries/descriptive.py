"""D1-D23, C6-C9, E2, E3, E14, E15, E17, F3, G2, G3, J9, L9 and the analysis calls."""

from pyspark.sql import functions as F

from ..operators import daily, gaps, stats, usage
from ..plans import endpoints
from .base import (
    DAILY, DAY, EPISODE_DAYS, FIRST_PER_DAY, MONTHS_BACK_12, Tables, json_names, legacy_names, query, r, rounded, with_tables,
)
from .bindings import AS_OF, AS_OF_SHORT

LOG = with_tables("log")
DAYS = with_tables("log", extra=EPISODE_DAYS)
FIRST = with_tables("log", extra=FIRST_PER_DAY)
MONTH = "cast(date_trunc('month', date) as date)"


@query("d1_daily_log_agg", with_tables("log", extra=DAILY) + f"select subject_id, date, pain, {r('sleep')} as sleep, {r('activity')} as activity from daily")
def daily_log_agg(t: Tables):
    return rounded(daily.daily_log_agg(t.log), "sleep", "activity")


@query(
    "d1_daily_log_agg_carry",
    LOG
    + "select subject_id, date, cast(max(pain) as double) as pain, arg_min(triggers, entry_id) filter (where triggers is not null) as triggers, "
    "arg_min(notes, entry_id) filter (where notes is not null) as notes from log group by 1, 2",
)
def daily_log_agg_carry(t: Tables):
    return daily.daily_log_agg(t.log, carry=("triggers", "notes")).select("subject_id", "date", "pain", "triggers", "notes")


@query("d2_yearly_counts", DAYS + "select subject_id, cast(year(date) as int) as year, count(*) as episode_days from days group by 1, 2")
def yearly_counts(t: Tables):
    return stats.yearly_counts(stats.episode_days(t.log))


@query(
    "d3_monthly_counts_year",
    DAYS + f"select subject_id, {MONTH} as month_start, count(*) as episode_days, strftime({MONTH}, '%B') as label "
    f"from days where year(date) = year({DAY}) group by 1, 2",
)
def monthly_counts_year(t: Tables):
    return stats.monthly_counts_year(stats.episode_days(t.log), AS_OF)


@query(
    "d4_past_12m_counts",
    DAYS + f"select d.subject_id, {MONTH} as month_start, count(*) as episode_days, strftime({MONTH}, '%B %Y') as label "
    "from days d join (select subject_id, max(date) as hi from log group by subject_id) m on d.subject_id = m.subject_id "
    "where d.date between cast(m.hi - interval 12 month as date) and m.hi group by 1, 2",
)
def past_12m_counts(t: Tables):
    return stats.past_12m_counts(stats.day_profile(t.log))


_MED = "coalesce(nullif(trim(medication), ''), 'No Medication')"


@query("d5_medication_counts", LOG + f"select subject_id, {_MED} as medication, count(*) as uses from log where pain > 0 group by 1, 2")
def medication_counts(t: Tables):
    return stats.medication_counts(t.log)


_D6 = (
    f"select s.subject_id, coalesce({r('avg(f.pain)', 1)}, 0.0) as avg_pain, coalesce(max(f.pain), 0) as max_pain "
    "from (select distinct subject_id from log) s left join first_rows f on s.subject_id = f.subject_id group by s.subject_id"
)


@query("d6_pain_stats_daily", FIRST + _D6)
def pain_stats_daily(t: Tables):
    return stats.pain_stats_daily(stats.day_profile(t.log))


@query(
    "d7_trend_daily_30d",
    LOG + "select subject_id, date, strftime(date, '%b %-d') as name, cast(max(pain) as double) as value, 'pain' as type from log "
    f"where date >= {DAY} - 30 group by 1, 2 having max(pain) > 0",
)
def trend_daily_30d(t: Tables):
    return stats.trend_daily_30d(t.log, AS_OF)


def _months(where: str) -> str:
    return (
        f"select subject_id, strftime({MONTH}, '%b %Y') as name, count(*) as value, 'count' as type, "
        f"cast(epoch(cast({MONTH} as timestamp)) as bigint) as sort_key from days {where} group by subject_id, {MONTH}"
    )


@query("d8_trend_monthly_1y", DAYS + _months(f"where date >= date_trunc('month', {MONTHS_BACK_12})"))
def trend_monthly_1y(t: Tables):
    return stats.trend_monthly(t.log, AS_OF, "1y")


@query("d8_trend_monthly_all", DAYS + _months(""))
def trend_monthly_all(t: Tables):
    return stats.trend_monthly(t.log, AS_OF, "all")


_RANGES = {"1y": f"where date >= {MONTHS_BACK_12}", "2y": f"where date >= cast({DAY} - interval 24 month as date)",
           "3y": f"where date >= cast({DAY} - interval 36 month as date)", "all": ""}
for _span, _where in _RANGES.items():

    @query(
        f"d9_trend_client_{_span}",
        DAYS + f"select subject_id, name, cast(value as double) as value, type from ({_months(_where)})",
    )
    def trend_client(t: Tables, span=_span):
        return stats.trend_client(t.log, AS_OF, span)


@query(
    "d9_trend_client_1m",
    LOG + "select subject_id, strftime(date, '%b %-d') as name, cast(max(pain) as double) as value, 'pain' as type from log "
    f"where date >= cast({DAY} - interval 1 month as date) group by subject_id, date having max(pain) > 0",
)
def trend_client_1m(t: Tables):
    return stats.trend_client(t.log, AS_OF, "1m")


@query(
    "d10_avg_days_per_month",
    LOG + f"select subject_id, n as episode_days_12m, months, {r('n / months', 1)} as avg_days_per_month from ("
    f"select subject_id, count(distinct date) filter (where pain > 0 and date between {MONTHS_BACK_12} and {DAY}) as n, "
    f"cast(least(12, greatest(1, (year({DAY}) - year(min(date))) * 12 + month({DAY}) - month(min(date)) + 1)) as int) as months "
    "from log group by subject_id)",
)
def avg_days_per_month(t: Tables):
    return stats.avg_days_per_month(t.log, AS_OF)


@query(
    "d11_pain_stats_all",
    LOG + f"select subject_id, coalesce({r('avg(pain) filter (where pain > 0)', 1)}, 0.0) as avg_pain, "
    "cast(coalesce(max(pain) filter (where pain > 0), 0) as double) as max_pain from log group by subject_id",
)
def pain_stats_all(t: Tables):
    return stats.pain_stats_all(t.log)


def _items(where: str) -> str:
    return f"items as (select subject_id, unnest({legacy_names('triggers')}) as item from log {where})"


_RANKED = """ranked as (select *, row_number() over (partition by subject_id order by uses desc, name) as rank from counts),
shares as (select subject_id, sum(uses) as total from counts group by subject_id)"""
_TOP = f"""select k.subject_id, k.name, k.uses, cast(s.total as bigint) as total,
  cast({r('k.uses / s.total * 100', 0)} as int) as share_pct,
  k.name || ' (' || cast(cast({r('k.uses / s.total * 100', 0)} as int) as varchar) || '%)' as label, cast(k.rank as int) as rank
from ranked k join shares s on k.subject_id = s.subject_id where k.rank <= 10"""

for _span, _where in {"1m": f"where date >= cast({DAY} - interval 1 month as date)", "1y": f"where date >= {MONTHS_BACK_12}", "all": ""}.items():

    @query(
        f"d12_trigger_usage_{_span}",
        with_tables("log", extra=_items(_where) + ", counts as (select subject_id, item as name, count(*) as uses from items group by 1, 2), " + _RANKED) + _TOP,
    )
    def trigger_usage(t: Tables, span=_span):
        return usage.trigger_usage(t.log, t.triggers, AS_OF, span)


_CATEGORY = """folded as (select subject_id, lower(name) as folded, arg_min({'c': category}, trigger_id).c as category from triggers group by 1, 2),
labelled as (select i.subject_id, i.item, coalesce(nullif(f.category, ''), 'Uncategorized') as category
  from items i left join folded f on i.subject_id = f.subject_id and lower(i.item) = f.folded)"""


@query(
    "d12_trigger_usage_by_category",
    with_tables(
        "log", "triggers",
        extra=_items("") + ", " + _CATEGORY + ", counts as (select subject_id, category as name, count(*) as uses from labelled group by 1, 2), " + _RANKED,
    ) + _TOP,
)
def trigger_usage_by_category(t: Tables):
    return usage.trigger_usage(t.log, t.triggers, AS_OF, "all", by_category=True)


@query(
    "c6_registry_lookup_ci",
    with_tables("log", "triggers", extra=_items("") + ", " + _CATEGORY)
    + "select subject_id, item as name, category, count(*) as uses from labelled group by 1, 2, 3",
)
def registry_lookup_ci(t: Tables):
    return usage.registry_lookup_ci(usage.trigger_counts(t.log), t.triggers)


_RECORDED = (
    f"case when json_valid(medications) then list_filter({json_names('medications')}, lambda x: x <> '') "
    f"else {legacy_names('medications')} end"
)
_MED_ITEMS = (
    f"items as (select subject_id, unnest(case when len({_RECORDED}) > 0 then {_RECORDED} else ['No Medication'] end) as item "
    f"from log where pain > 0 and date >= {MONTHS_BACK_12}), counts as (select subject_id, item as name, count(*) as uses from items group by 1, 2)"
)


@query(
    "d13_medication_usage",
    with_tables("log", extra=_MED_ITEMS)
    + "select *, name || ' (' || cast(share_pct as varchar) || '%)' as label from (select subject_id, name, uses, "
    "cast(sum(uses) over (partition by subject_id) as bigint) as total, "
    f"cast({r('uses / sum(uses) over (partition by subject_id) * 100', 0)} as int) as share_pct from counts)",
)
def medication_usage(t: Tables):
    return usage.medication_usage(t.log, AS_OF, "1y")


def _medication_range(name: str, span: str, condition: str):
    items = _MED_ITEMS.replace(f"and date >= {MONTHS_BACK_12}", condition)

    @query(
        name,
        with_tables("log", extra=items)
        + "select *, name || ' (' || cast(share_pct as varchar) || '%)' as label from (select subject_id, name, uses, "
        "cast(sum(uses) over (partition by subject_id) as bigint) as total, "
        f"cast({r('uses / sum(uses) over (partition by subject_id) * 100', 0)} as int) as share_pct from counts)",
    )
    def run(t: Tables):
        return usage.medication_usage(t.log, AS_OF, span)


_medication_range("d13_medication_usage_month", "1m", f"and date >= cast({DAY} - interval 1 month as date)")
_medication_range("d13_medication_usage_all", "all", "")


@query(
    "d14_usage_recount_triggers",
    with_tables("log", "triggers", extra=_items("") + ", counts as (select subject_id, item as name, count(*) as uses from items group by 1, 2)")
    + "select g.trigger_id, g.name, coalesce(c.uses, g.usage_count, 0) as usage_count from triggers g "
    "left join counts c on g.subject_id = c.subject_id and g.name = c.name",
)
def usage_recount_triggers(t: Tables):
    return usage.usage_recount_triggers(t.log, t.triggers).select("trigger_id", "name", "usage_count")


_ALL_NAMES = (
    f"items as (select subject_id, unnest({legacy_names('medication')}) as item from log "
    f"union all select subject_id, unnest({json_names('medications')}) as item from log), "
    "counts as (select subject_id, item as name, count(*) as uses from items group by 1, 2)"
)


@query(
    "d15_usage_recount_meds",
    with_tables("log", "medications", extra=_ALL_NAMES)
    + "select g.med_id, g.name, coalesce(c.uses, g.usage_count, 0) as usage_count from medications g "
    "left join counts c on g.subject_id = c.subject_id and g.name = c.name",
)
def usage_recount_meds(t: Tables):
    return usage.usage_recount_meds(t.log, t.medications).select("med_id", "name", "usage_count")


@query("d16_legacy_med_counts", LOG + "select subject_id, medication as name, count(*) as uses from log where trim(medication) <> '' group by 1, 2")
def legacy_med_counts(t: Tables):
    return usage.legacy_med_counts(t.log)


_LATEST = "latest as (select subject_id, max(trained_at) as last_trained from model_registry group by subject_id)"


@query(
    "d19_entries_since_training",
    with_tables("log", "model_registry", extra=_LATEST)
    + "select l.subject_id, count(*) filter (where t.last_trained is null or l.date > t.last_trained) as entries_since_training, "
    "count(*) filter (where t.last_trained is null or l.date > t.last_trained) >= 5 as needs_retraining "
    "from log l left join latest t on l.subject_id = t.subject_id group by l.subject_id",
)
def entries_since_training(t: Tables):
    latest = t.model_registry.groupBy("subject_id").agg(F.max("trained_at").alias("last_trained"))
    return stats.entries_since_training(t.log, latest)


@query("d21_trend_average", DAYS + f"select subject_id, {r('avg(value)')} as average_value from ({_months('')}) group by subject_id")
def trend_average(t: Tables):
    return rounded(stats.trend_average(stats.trend_monthly(t.log, AS_OF, "all")), "average_value")


@query("d22_logged_today", LOG + f"select subject_id, bool_or(date = {DAY}) as logged_today from log group by subject_id")
def logged_today(t: Tables):
    return stats.logged_today(t.log, AS_OF)


for _form, (_default, _edge, _other) in {"page": ("Uncategorized", 0, 1), "form": ("Other", 1, 0)}.items():

    @query(
        f"d23_category_group_{_form}",
        with_tables("triggers")
        + f"select subject_id, coalesce(nullif(category, ''), '{_default}') as category, "
        f"cast(case when coalesce(nullif(category, ''), '{_default}') = '{_default}' then {_edge} else {_other} end as int) as category_order, "
        "name, trigger_id from triggers",
    )
    def category_group(t: Tables, form=_form):
        return usage.category_group(t.triggers, form)


@query("e2_first_per_day", FIRST + "select subject_id, date, entry_id, time, pain from first_rows")
def first_per_day(t: Tables):
    painful = t.log.where(F.col("pain") > 0).select("subject_id", "date", "entry_id", "time", "pain")
    return daily.first_per_day(painful)


@query(
    "e3_max_row_per_day",
    LOG + "select subject_id, date, entry_id, time, pain from (select *, row_number() over (partition by subject_id, date "
    "order by pain desc, time desc, entry_id) as rn from log) where rn = 1",
)
def max_row_per_day(t: Tables):
    return daily.max_row_per_day(t.log.select("subject_id", "date", "entry_id", "time", "pain"))


_ISLANDS = f"""days as (select distinct subject_id, date from log_short where date <= date '{AS_OF_SHORT}'),
islands as (select subject_id, date, date - cast(row_number() over (partition by subject_id order by date) as int) as island from days),
runs as (select subject_id, island, count(*) as n, max(date) as hi from islands group by 1, 2)"""


@query(
    "e14_logging_streak",
    with_tables("log_short", extra=_ISLANDS)
    + "select s.subject_id, cast(coalesce(max(r.n), 0) as int) as streak_days from (select distinct subject_id from log_short) s "
    f"left join runs r on s.subject_id = r.subject_id and r.hi >= date '{AS_OF_SHORT}' - 1 group by s.subject_id",
)
def logging_streak(t: Tables):
    return gaps.logging_streak(t.log_short, AS_OF_SHORT)


def _missing(log: str, day: str) -> str:
    return (
        f"missing as (select subject_id, cast(unnest(generate_series(greatest(hi + 1, {day} - 5), {day} - 1, interval 1 day)) as date) as date "
        f"from (select subject_id, max(date) as hi from {log} group by subject_id) where greatest(hi + 1, {day} - 5) <= {day} - 1)"
    )


# Four days past the end of the minute-level log.
_AFTER = "2024-02-03"


@query("e15_missing_days", with_tables("log_short", extra=_missing("log_short", f"date '{_AFTER}'")) + "select subject_id, date from missing")
def missing_days(t: Tables):
    return gaps.missing_days(t.log_short, _AFTER)


@query(
    "l9_healthy_day_backfill",
    with_tables("log", "medications", extra=_missing("log", "date '2001-08-05'"))
    + "select m.subject_id, m.date, '12:00' as time, 0 as pain, '3' as sleep, '2' as activity, 'Retroactive Bulk Log' as notes, "
    "r.name as med_name, r.default_dosage as med_dosage from missing m "
    "left join medications r on r.subject_id = m.subject_id and r.frequency = 'daily'",
)
def healthy_day_backfill(t: Tables):
    return gaps.healthy_day_backfill(t.log, t.medications, "2001-08-05")


@query(
    "e17_recent_rows",
    LOG + "select subject_id, entry_id, date, pain, cast(rn as int) as recency from (select *, row_number() over (partition by subject_id "
    "order by date desc, entry_id desc) as rn from log) where rn <= 60",
)
def recent_rows(t: Tables):
    return daily.recent_rows(t.log).select("subject_id", "entry_id", "date", "pain", "recency")


@query(
    "f3_usage_topk",
    with_tables("log", extra=_ALL_NAMES)
    + "select subject_id, name, uses, cast(rank as int) as rank from (select *, row_number() over (partition by subject_id order by uses desc, name) as rank "
    "from counts) where rank <= 10",
)
def usage_topk(t: Tables):
    names = usage.all_med_names(t.log)
    counts = names.groupBy("subject_id", "name").agg(F.count(F.lit(1)).alias("uses"))
    return usage.usage_topk(counts)


@query("g2_distinct_names", with_tables("log", extra=_ALL_NAMES) + "select subject_id, name from counts")
def distinct_names(t: Tables):
    return usage.distinct_names(t.log)


@query(
    "c7_display_name_join",
    with_tables("log", "medications", extra=_ALL_NAMES)
    + "select c.subject_id, c.name, c.uses, coalesce(nullif(m.display_name, ''), c.name) as shown from counts c "
    "left join medications m on m.subject_id = c.subject_id and m.name = c.name",
)
def display_name_join(t: Tables):
    counts = usage.all_med_names(t.log).groupBy("subject_id", "name").agg(F.count(F.lit(1)).alias("uses"))
    return usage.display_name_join(counts, t.medications)


_LAST_USE = f"""last_use as (
  select m.*, max(l.date) as last_use from medications m join log l on l.subject_id = m.subject_id
    and (list_contains({json_names('l.medications')}, m.name) or (l.medication <> '' and contains(l.medication, m.name)))
  group by all)"""


@query("c8_last_use_join", with_tables("log", "medications", extra=_LAST_USE) + "select med_id, name, last_use from last_use")
def last_use_join(t: Tables):
    return usage.last_use_join(t.log, t.medications).select("med_id", "name", "last_use")


@query(
    "j9_med_due",
    with_tables("log", "medications", extra=_LAST_USE)
    + "select med_id, name, last_use, last_use + period_days as next_due, "
    f"cast(last_use + period_days - {DAY} as int) as due_days from last_use "
    f"where frequency = 'periodic' and coalesce(period_days, 0) <> 0 and last_use + period_days <= {DAY} + 7",
)
def med_due(t: Tables):
    return usage.med_due(t.log, t.medications, AS_OF).select("med_id", "name", "last_use", "next_due", "due_days")


_NOVEL = (
    "select subject_id, min(trim(name)) as name from counts c where trim(name) <> '' and not exists (select 1 from medications m "
    "where m.subject_id = c.subject_id and lower(m.name) = lower(c.name)) group by subject_id, lower(trim(name))"
)


@query("c9_registry_anti_ci", with_tables("log", "medications", extra=_ALL_NAMES) + _NOVEL)
def registry_anti_ci(t: Tables):
    return usage.registry_anti_ci(t.log, t.medications)


@query(
    "l7_import_registry",
    with_tables("log", "medications", extra=_ALL_NAMES)
    + f"select subject_id, name, 'as_needed' as frequency, cast(0 as bigint) as usage_count from ({_NOVEL})",
)
def import_registry(t: Tables):
    from ..operators.maintain import import_registry as run

    return run(t.log, t.medications)


_SUMMARY = f"""select subject_id, 'yearly_counts' as section, cast(year(date) as varchar) as key, cast(count(*) as double) as value from days group by 1, 3
union all select subject_id, 'medication_counts', {_MED}, count(*) from log where pain > 0 group by 1, 3
union all select subject_id, 'monthly_counts', strftime({MONTH}, '%B'), count(*) from days where year(date) = year({DAY}) group by subject_id, {MONTH}
union all select d.subject_id, 'past_12_months_counts', strftime({MONTH}, '%B %Y'), count(*) from days d
  join (select subject_id, max(date) as hi from log group by subject_id) m on d.subject_id = m.subject_id
  where d.date between cast(m.hi - interval 12 month as date) and m.hi group by d.subject_id, {MONTH}
union all select subject_id, 'avg_pain', '', avg_pain from ({_D6})
union all select subject_id, 'max_pain', '', max_pain from ({_D6})"""


@query("api_analysis_summary", with_tables("log", extra=EPISODE_DAYS + ", " + FIRST_PER_DAY) + _SUMMARY)
def analysis_summary(t: Tables):
    return endpoints.analysis_summary(t.log, AS_OF)


@query("api_analysis_trends", DAYS + _months(f"where date >= date_trunc('month', {MONTHS_BACK_12})"))
def analysis_trends(t: Tables):
    return endpoints.analysis_trends(t.log, AS_OF)


@query(
    "api_medications",
    with_tables("log", "medications", extra=_ALL_NAMES)
    + "select g.med_id, g.name, case when u.total = 0 then coalesce(c.uses, g.usage_count) else g.usage_count end as usage_count "
    "from medications g join (select subject_id, sum(usage_count) as total from medications group by subject_id) u on u.subject_id = g.subject_id "
    "left join counts c on g.subject_id = c.subject_id and g.name = c.name",
)
def medications(t: Tables):
    return endpoints.medications(t.log, t.medications).select("med_id", "name", "usage_count")


@query(
    "api_triggers",
    with_tables("log", "triggers", extra=_items("") + ", counts as (select subject_id, item as name, count(*) as uses from items group by 1, 2)")
    + "select g.trigger_id, g.name, case when u.total = 0 then coalesce(c.uses, g.usage_count) else g.usage_count end as usage_count "
    "from triggers g join (select subject_id, sum(usage_count) as total from triggers group by subject_id) u on u.subject_id = g.subject_id "
    "left join counts c on g.subject_id = c.subject_id and g.name = c.name",
)
def triggers(t: Tables):
    return endpoints.triggers(t.log, t.triggers).select("trigger_id", "name", "usage_count")


@query(
    "api_entries",
    LOG + f"select entry_id, date, coalesce(pain, 0) as pain, array_to_string({json_names('medications')}, '|') as names, "
    "coalesce(notes, '') as notes from (select *, row_number() over (partition by subject_id order by date desc, time desc, entry_id) as rn "
    f"from log where date <= {DAY}) where rn <= 20",
)
def entries(t: Tables):
    rows = endpoints.entries(t.log, end=AS_OF, limit=20)
    return rows.select("entry_id", "date", "pain", F.array_join(F.transform("medications", lambda m: m["name"]), "|").alias("names"), "notes")
