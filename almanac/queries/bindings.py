"""How the supplied star-schema tables stand in for logs, weather and registries.

Every table is one SELECT that Spark and the checking engine both accept, so both sides
start from the same rows. Braces are doubled because the texts are format strings.
"""

from __future__ import annotations

# Fixed day on which "today" questions are asked, inside the order dates.
AS_OF = "2001-07-15"
# The same for the minute-level log, which covers January 2024.
AS_OF_SHORT = "2024-01-28"
FORECAST_START = "2024-01-20 06:00:00"

LOG = """
select cast(c_nationkey as bigint) as subject_id, o_orderkey as entry_id, cast(o_orderdate as date) as date,
  lpad(cast(o_orderkey % 24 as string), 2, '0') || ':' || lpad(cast(o_orderkey * 7 % 60 as string), 2, '0') as time,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then cast(o_orderkey % 10 + 1 as int) else 0 end as pain,
  case o_custkey % 5 when 0 then '' when 1 then null
    when 2 then ' med' || cast(o_custkey % 90 as string) || ' '
    when 3 then 'med' || cast(o_custkey % 90 as string) || ', med' || cast(o_orderkey % 7 as string)
    else 'med' || cast(o_custkey % 90 as string) end as medication,
  case o_custkey % 3 when 0 then '10mg' when 1 then '' else null end as dosage,
  case o_orderkey % 8 when 0 then null when 1 then '[]'
    when 2 then '[{{"name": "med' || cast(o_orderkey % 70 as string) || '", "dosage": "5mg"}}]'
    when 3 then '[{{"name": "med' || cast(o_orderkey % 70 as string) || '"}}, {{"name": "Med' || cast(o_custkey % 9 as string) || '", "dosage": ""}}]'
    when 4 then '{{"name": "med' || cast(o_orderkey % 70 as string) || '"}}'
    when 5 then '[{{"name": "med1"'
    when 6 then '[{{"name": "med' || cast(o_orderkey % 70 as string) || '"}}, 7, {{"dosage": "1"}}]'
    else 'med' || cast(o_orderkey % 11 as string) || ', med' || cast(o_custkey % 9 as string) end as medications,
  case when o_orderkey % 29 = 0 then 'n/a' else cast(1 + o_custkey % 3 as string) end as sleep,
  case when o_orderkey % 31 = 0 then null else cast(o_custkey % 4 as string) end as activity,
  case when o_orderkey % 13 = 0 then null
    when o_orderkey % 17 = 0 then 'Stress , ' || lower(c_mktsegment) || ',,Stress'
    else lower(c_mktsegment) || ', status ' || lower(o_orderstatus) end as triggers,
  case when o_orderkey % 9 = 0 then null else 'note ' || cast(o_orderkey as string) end as notes,
  case when o_orderkey % 5 = 0 then null else 'City ' || cast(c_nationkey as string) end as location,
  'UTC' as timezone,
  case when o_orderkey % 6 = 0 then null else cast(c_nationkey as double) / 2 - 5 end as latitude,
  case when o_orderkey % 7 = 0 then null else cast(c_nationkey as double) * 4 - 50 end as longitude
from {orders} join {customer} on o_custkey = c_custkey
"""

RAW_LOG = """
select subject_id, entry_id,
  case when entry_id % 41 = 0 then '10-10-2023' when entry_id % 43 = 0 then '2023-02-30'
    else cast(date as string) end as date,
  case when entry_id % 37 = 0 then '1200' when entry_id % 47 = 0 then '25:10' when entry_id % 53 = 0 then null
    when entry_id % 2 = 0 then substring(time, 1, 3) || '59' else time end as time,
  case when entry_id % 19 = 0 then 'bad' when entry_id % 23 = 0 then '15' when entry_id % 59 = 0 then '-1'
    when entry_id % 61 = 0 then null when entry_id % 67 = 0 then '3.7' else cast(pain as string) end as pain,
  medication, dosage, medications, sleep, activity, triggers, notes, location, timezone,
  case entry_id % 5 when 0 then 'Unknown' when 1 then '   ' when 2 then '[]' when 3 then '12.5'
    else cast(subject_id as string) end as latitude,
  case entry_id % 4 when 0 then 'unknown' when 1 then '' when 2 then 'here' else cast(subject_id as string) end as longitude
from {log}
"""

# Minute-level log: one subject per event user, over one month.
LOG_SHORT = """
select user_id as subject_id, event_id as entry_id, cast(ts as date) as date,
  lpad(cast(hour(ts) as string), 2, '0') || ':' || lpad(cast(minute(ts) as string), 2, '0') as time, ts,
  case when event_type in ('error', 'purchase') then least(10, cast(floor(value / 15) as int)) else 0 end as pain,
  event_type as triggers, cast(1 + event_id % 3 as string) as sleep, cast(event_id % 4 as string) as activity
from {events}
"""

# A day's pressure change is against the day before, 0 where that day has no reading.
WEATHER_DAILY = """
select *, coalesce(case when lag(date) over (partition by location_id order by date) = date - 1
  then pres - lag(pres) over (partition by location_id order by date) end, 0.0) as pres_change from (
select cast(s_nationkey as bigint) as location_id, cast(l_shipdate as date) as date,
  10 + avg(l_quantity) / 4 as tavg, 5 + min(l_quantity) / 4 as tmin, 15 + max(l_quantity) / 2 as tmax,
  1000 + avg(l_quantity) as pres,
  cast(sum(cast(floor(l_tax * 100 + 0.5) as bigint)) as double) / 10 as prcp,
  avg(cast(l_linenumber as double)) as wspd, cast(count(*) as double) * 30 as tsun,
  40 + 5 * avg(cast(floor(l_discount * 100 + 0.5) as bigint)) as average_humidity,
  cast(40 + 5 * max(cast(floor(l_discount * 100 + 0.5) as bigint)) as double) as midday_humidity,
  cast(cast(s_nationkey as bigint) as double) / 2 - 5 as latitude, cast(cast(s_nationkey as bigint) as double) * 4 - 50 as longitude
from {lineitem} join {supplier} on l_suppkey = s_suppkey
group by cast(s_nationkey as bigint), cast(l_shipdate as date)) daily
"""

WEATHER_HOURLY = """
select user_id % 3 as location_id, date_trunc('hour', ts) as ts,
  avg(cast(floor(value * 100 + 0.5) as bigint)) / 500 as temperature_2m,
  case when count(*) % 11 = 0 then null else least(100.0, max(value)) end as relative_humidity_2m,
  case when count(*) % 7 = 0 then null
    else 1000 + cast(sum(cast(floor(value * 100 + 0.5) as bigint)) % 1900 as double) / 100 end as surface_pressure,
  cast(min(cast(floor(value * 100 + 0.5) as bigint)) % 120 as double) / 100 as precipitation,
  cast(count(*) as double) as wind_speed_10m
from {events} group by user_id % 3, date_trunc('hour', ts)
"""

# The daily arrays of a payload: some days are missing on purpose.
WEATHER_DAY_FIELDS = """
select location_id, cast(ts as date) as date, max(temperature_2m) + 1 as temperature_2m_max,
  min(temperature_2m) - 1 as temperature_2m_min,
  case when count(*) % 2 = 0 then null else cast(count(*) as double) * 600 end as sunshine_duration
from {weather_hourly} group by location_id, cast(ts as date) having count(*) % 5 <> 0
"""

MEDICATIONS = """
select p_partkey % 25 as subject_id, p_partkey as med_id,
  'med' || cast(cast(floor(p_partkey / 25) as bigint) as string) as name,
  case when p_size % 4 = 0 then '' when p_size % 4 = 1 then null else p_type || ' ' || p_name end as display_name,
  case when p_size % 2 = 0 then '5mg' else null end as default_dosage,
  case p_partkey % 3 when 0 then 'as_needed' when 1 then 'daily' else 'periodic' end as frequency,
  case when p_partkey % 11 = 0 then null else p_size end as period_days,
  cast(case when p_partkey % 25 < 12 then 0 else p_size % 6 end as bigint) as usage_count
from {part}
"""

TRIGGERS = """
select distinct cast(c_nationkey as bigint) as subject_id,
  cast(c_nationkey as bigint) * 1000 + ascii(c_mktsegment) as trigger_id,
  case when ascii(c_mktsegment) % 2 = 0 then upper(c_mktsegment) else lower(c_mktsegment) end as name,
  cast(0 as bigint) as usage_count, false as is_system_default,
  case c_mktsegment when 'AUTOMOBILE' then 'travel' when 'BUILDING' then 'home' when 'FURNITURE' then ''
    when 'HOUSEHOLD' then 'home' else null end as category
from {customer}
union all
select distinct cast(c_nationkey as bigint) as subject_id,
  cast(c_nationkey as bigint) * 1000 + 500 + ascii(o_orderstatus) as trigger_id,
  'status ' || lower(o_orderstatus) as name, cast(c_nationkey % 2 as bigint) as usage_count,
  true as is_system_default, 'work' as category
from {orders} join {customer} on o_custkey = c_custkey where o_orderstatus <> 'P'
"""

SETTINGS_CHANGES = """
select cast(c_nationkey as bigint) as subject_id,
  case c_custkey % 6 when 0 then 'baseline_risk' when 1 then 'weather_sensitivity' when 2 then 'sleep_sensitivity'
    when 3 then 'strain_sensitivity' when 4 then 'temp_unit' else 'force_heuristic_mode' end as key,
  case when c_custkey % 6 = 4 then case when c_custkey % 4 = 0 then 'F' else 'C' end
    when c_custkey % 6 = 5 then case when c_custkey % 4 = 1 then 'True' else 'False' end
    when c_custkey % 13 = 0 then 'high'
    else '0.' || cast(cast(floor(c_custkey / 6) as bigint) % 10 as string) end as value,
  c_custkey as version
from {customer}
"""

SUBJECT_LOCATION = """
select distinct cast(c_nationkey as bigint) as subject_id, cast(c_nationkey as bigint) as location_id from {customer}
"""

SUBJECT_LOCATION_SHORT = """
select distinct user_id as subject_id, user_id % 3 as location_id from {events}
"""

# Doses of the minute-level log, for the medication shield.
DOSES = """
select user_id as subject_id, date_trunc('minute', ts) as dose_ts from {events} where event_type = 'purchase'
"""

# One saved model per subject and month of orders.
MODEL_REGISTRY = """
select distinct cast(c_nationkey as bigint) as subject_id, 'model ' || cast(c_nationkey as string) as model_name,
  cast(year(o_orderdate) * 100 + month(o_orderdate) as bigint) as version,
  cast(date_trunc('month', o_orderdate) as date) as trained_at
from {orders} join {customer} on o_custkey = c_custkey where o_orderdate < cast('2001-03-01' as timestamp)
"""

DERIVED = {
    "log": LOG,
    "raw_log": RAW_LOG,
    "log_short": LOG_SHORT,
    "weather_daily": WEATHER_DAILY,
    "weather_hourly": WEATHER_HOURLY,
    "weather_day_fields": WEATHER_DAY_FIELDS,
    "medications": MEDICATIONS,
    "triggers": TRIGGERS,
    "settings_changes": SETTINGS_CHANGES,
    "subject_location": SUBJECT_LOCATION,
    "subject_location_short": SUBJECT_LOCATION_SHORT,
    "doses": DOSES,
    "model_registry": MODEL_REGISTRY,
}
BASE = ("orders", "customer", "lineitem", "supplier", "events", "part")
