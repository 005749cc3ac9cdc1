"""B1-B12 and the scalar helpers H1-H21 as table queries."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import clean, maintain
from ..schemas import LOG
from .base import DAY, MONTHS_BACK_12, Tables, json_names, legacy_names, query, r, rounded, with_tables

RAW = with_tables("raw_log")
CLEAN = with_tables("log")


@query(
    "b1_conform_schema",
    RAW
    + "select subject_id, entry_id, try_cast(case when regexp_matches(date, '^\\d{4}-') then date end as date) as date, time, "
    "cast(null as int) as pain, medication, dosage, medications, sleep, activity, triggers, notes, location, timezone, "
    "try_cast(latitude as double) as latitude, try_cast(longitude as double) as longitude from raw_log",
)
def conform(t: Tables):
    changed = t.raw_log.drop("pain").withColumn("pressure", F.lit(1000))
    return clean.conform_schema(changed, LOG)


@query(
    "b2_sanitize_entries",
    RAW
    + "select entry_id, pain as \"Pain Level\", activity as \"Physical Activity\", notes as pressure, "
    "case when lower(latitude) = 'unknown' or trim(latitude) = '' or latitude = '[]' then null else latitude end as latitude, "
    "case when lower(longitude) = 'unknown' or trim(longitude) = '' or longitude = '[]' then null else longitude end as longitude "
    "from raw_log",
)
def sanitize(t: Tables):
    old = t.raw_log.select(
        "entry_id", F.col("pain").alias("Pain_Level"), F.col("activity").alias("Physical_Activity"),
        F.col("notes").alias("weather_pressure"), "latitude", "longitude",
    )
    return clean.sanitize_entries(old)


@query(
    "b3_validate_pain",
    RAW + "select entry_id, try_cast(pain as double) as pain from raw_log where try_cast(pain as double) between 0 and 10",
)
def validate_pain(t: Tables):
    return clean.validate_pain(t.raw_log).select("entry_id", "pain")


REASONS = """reasons as (select *, case
  when not regexp_matches(coalesce(date, ''), '^\\d{4}-\\d{2}-\\d{2}$') then 'invalid date format'
  when try_strptime(date, '%Y-%m-%d') is null then 'invalid date'
  when not regexp_matches(coalesce(time, ''), '^\\d{2}:\\d{2}$') then 'invalid time format'
  when try_strptime(time, '%H:%M') is null then 'invalid time' end as reject_reason from raw_log)"""


@query("b4_validate_date_time", with_tables("raw_log", extra=REASONS) + "select entry_id, date, time, reject_reason from reasons")
def validate_date_time(t: Tables):
    return clean.validate_date_time(t.raw_log).select("entry_id", "date", "time", "reject_reason")


@query(
    "l1_insert_entries",
    with_tables("raw_log", extra=REASONS)
    + "select entry_id, cast(date as date) as date, time, coalesce(medication, '') as medication, coalesce(dosage, '') as dosage "
    "from reasons where reject_reason is null",
)
def insert_entries(t: Tables):
    good, _ = maintain.insert_entries(t.raw_log)
    return good.select("entry_id", "date", "time", "medication", "dosage")


@query(
    "l1_rejected_entries",
    with_tables("raw_log", extra=REASONS)
    + "select subject_id, reject_reason, count(*) as n from reasons where reject_reason is not null group by 1, 2",
)
def rejected_entries(t: Tables):
    _, bad = maintain.insert_entries(t.raw_log)
    return bad.groupBy("subject_id", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("b5_require_columns", RAW + "select date, time, pain from raw_log")
def require_columns(t: Tables):
    required = ("date", "time", "pain")
    return clean.require_columns(t.raw_log, required).select(*required)


@query(
    "b6_read_sanitize",
    RAW
    + "select entry_id, coalesce(cast(trunc(try_cast(pain as double)) as int), 0) as pain, "
    f"array_to_string({json_names('medications')}, '|') as names, "
    "try_cast(latitude as double) as latitude, try_cast(longitude as double) as longitude, "
    "coalesce(notes, '') as notes, coalesce(time, '') as time, coalesce(medication, '') as medication from raw_log",
)
def read_sanitize(t: Tables):
    rows = clean.read_sanitize(t.raw_log)
    names = F.array_join(F.transform("medications", lambda m: m["name"]), "|")
    return rows.select(
        "entry_id", "pain", names.alias("names"), "latitude", "longitude", "notes", "time", "medication"
    )


@query(
    "b7_migrate_legacy_meds",
    CLEAN
    + "select entry_id, case when medications is null and medication <> '' "
    "then cast(to_json([{'name': medication, 'dosage': coalesce(dosage, '')}]) as varchar) else medications end as medications from log",
)
def migrate_legacy_meds(t: Tables):
    return clean.migrate_legacy_meds(t.log).select("entry_id", "medications")


@query("b8_filter_painful", RAW + "select entry_id, pain from raw_log where try_cast(pain as double) > 0")
def filter_painful(t: Tables):
    return clean.filter_painful(t.raw_log).select("entry_id", "pain")


@query(
    "b9_drop_bad_dates",
    RAW + "select entry_id, cast(try_strptime(date, '%Y-%m-%d') as date) as date from raw_log "
    "where try_strptime(date, '%Y-%m-%d') is not null",
)
def drop_bad_dates(t: Tables):
    return clean.drop_bad_dates(t.raw_log).select("entry_id", "date")


for _span, _start in {
    "7d": f"{DAY} - 7", "30d": f"{DAY} - 30", "90d": f"{DAY} - 90", "180d": f"{DAY} - 180", "1y": MONTHS_BACK_12,
}.items():

    @query(f"b10_range_filter_{_span}", CLEAN + f"select entry_id, date from log where date >= {_start}")
    def range_filter(t: Tables, span=_span):
        from .bindings import AS_OF

        return clean.range_filter(t.log, AS_OF, span).select("entry_id", "date")


_SEVERITY = "case when pain = 0 then 'No Pain' when pain <= 3 then 'Mild' when pain <= 6 then 'Moderate' else 'Severe' end"


@query(
    "b11_label_decode",
    CLEAN
    + "select entry_id, case lower(sleep) when '1' then 'Poor' when '2' then 'Fair' when '3' then 'Good' else sleep end as sleep_label, "
    "case activity when '0' then 'None' when '1' then 'Light' when '2' then 'Mod' when '3' then 'Heavy' else activity end as activity_label, "
    f"{_SEVERITY} as severity from log",
)
def label_decode(t: Tables):
    return clean.label_decode(t.log).select("entry_id", "sleep_label", "activity_label", "severity")


@query(
    "b11_label_decode_legacy",
    CLEAN
    + "select entry_id, case sleep when '0' then 'Poor' when '1' then 'Fair' when '2' then 'Good' end as sleep_label, "
    "case activity when '0' then 'Low' when '1' then 'Moderate' when '2' then 'Heavy' end as activity_label from log",
)
def label_decode_legacy(t: Tables):
    return clean.label_decode(t.log, "legacy").select("entry_id", "sleep_label", "activity_label")


@query(
    "b12_location_valid",
    RAW
    + "select entry_id, try_cast(latitude as double) as latitude, try_cast(longitude as double) as longitude from raw_log "
    "where try_cast(latitude as double) is not null and try_cast(longitude as double) is not null",
)
def location_valid(t: Tables):
    return clean.location_valid(t.raw_log).select("entry_id", "latitude", "longitude")


# --- scalar helpers --------------------------------------------------------------------


@query("h1_split_list", CLEAN + f"select entry_id, array_to_string({legacy_names('triggers')}, '|') as items from log")
def split_list(t: Tables):
    return t.log.select("entry_id", F.array_join(fn.split_list(F.col("triggers")), "|").alias("items"))


@query("h2_parse_meds_json", CLEAN + f"select entry_id, array_to_string({json_names('medications')}, '|') as names from log")
def parse_meds_json(t: Tables):
    return clean.with_med_names(t.log).select("entry_id", F.array_join("med_names", "|").alias("names"))


@query(
    "h3_to_meds_json",
    CLEAN + "select entry_id, cast(to_json([{'name': coalesce(medication, ''), 'dosage': coalesce(dosage, '')}]) as varchar) as json from log",
)
def to_meds_json(t: Tables):
    item = F.struct(
        F.coalesce("medication", F.lit("")).alias("name"), F.coalesce("dosage", F.lit("")).alias("dosage")
    )
    return t.log.select("entry_id", fn.to_meds_json(F.array(item)).alias("json"))


@query(
    "h4_time_to_minutes",
    RAW
    + "select entry_id, coalesce(case when len(string_split(time, ':')) = 2 then try_cast(split_part(time, ':', 1) as int) * 60 "
    "+ try_cast(split_part(time, ':', 2) as int) end, 0) as minutes from raw_log",
)
def time_to_minutes(t: Tables):
    return t.raw_log.select("entry_id", fn.time_to_minutes(F.col("time")).alias("minutes"))


@query("h5_time_to_hour", RAW + "select entry_id, try_cast(split_part(time, ':', 1) as int) as hour from raw_log")
def time_to_hour(t: Tables):
    return t.raw_log.select("entry_id", fn.time_to_hour(F.col("time")).alias("hour"))


_CIRCLE = {
    "day_of_week_sin": "sin(2*pi()*(isodow(date)-1)/7)",
    "day_of_week_cos": "cos(2*pi()*(isodow(date)-1)/7)",
    "month_sin": "sin(2*pi()*month(date)/12)",
    "month_cos": "cos(2*pi()*month(date)/12)",
}


@query(
    "h6_cyclical",
    CLEAN + "select entry_id, cast(isodow(date)-1 as int) as day_of_week, cast(month(date) as int) as month, "
    + ", ".join(f"{r(v)} as {k}" for k, v in _CIRCLE.items()) + " from log",
)
def cyclical(t: Tables):
    return rounded(t.log.select("entry_id", *[c.alias(k) for k, c in fn.cyclical(F.col("date")).items()]), *_CIRCLE)


@query(
    "h7_log_target",
    CLEAN + f"select entry_id, {r('ln(1 + pain)')} as pain_log, cast(pain > 0 as int) as pain_binary, {r('exp(ln(1 + pain)) - 1')} as restored from log",
)
def log_target(t: Tables):
    target = fn.log_target(F.col("pain"))
    return t.log.select(
        "entry_id",
        fn.round_half_up(target, 6).alias("pain_log"),
        (F.col("pain") > 0).cast("int").alias("pain_binary"),
        fn.round_half_up(fn.unlog_target(target), 6).alias("restored"),
    )


@query(
    "h8_weather_derived",
    with_tables("weather_daily")
    + f"select location_id, date, {r('tmax - tmin')} as tdiff, {r('(tmax + tmin) / 2')} as tavg, "
    f"{r('coalesce(average_humidity, 0) * ((tmax + tmin) / 2)')} as humid_tavg from weather_daily",
)
def weather_derived(t: Tables):
    from ..operators.features import weather_derived as derive

    return rounded(derive(t.weather_daily).select("location_id", "date", "tdiff", "tavg", "humid_tavg"), "tdiff", "tavg", "humid_tavg")


@query(
    "h9_date_labels",
    CLEAN
    + "select distinct date, strftime(date, '%B') as month, strftime(date, '%B %Y') as month_year, "
    "strftime(date, '%b %Y') as short_month_year, strftime(date, '%b %-d') as short_day from log",
)
def date_labels(t: Tables):
    styles = ("month", "month_year", "short_month_year", "short_day")
    return t.log.select("date").distinct().select("date", *[fn.date_label(F.col("date"), s).alias(s) for s in styles])


@query(
    "h10_c_to_f",
    with_tables("weather_daily") + f"select location_id, date, {r('tmax * 9 / 5 + 32', 1)} as tmax_f from weather_daily",
)
def c_to_f(t: Tables):
    return t.weather_daily.select("location_id", "date", fn.c_to_f(F.col("tmax")).alias("tmax_f"))


@query(
    "h11_risk_bucket",
    "select event_id, case when p < 0.3 then 'Low' when p < 0.7 then 'Moderate' else 'High' end as rules, "
    "case when p > 0.6 then 'High' when p > 0.2 then 'Moderate' else 'Low' end as model, "
    "case when value >= 60 then 'High' when value >= 30 then 'Moderate' else 'Low' end as calibrated "
    "from (select *, value / 100 as p from events)",
)
def risk_bucket(t: Tables):
    p = F.col("value") / 100
    return t.events.select(
        "event_id",
        fn.risk_level_rules(p).alias("rules"),
        fn.risk_level_model(p).alias("model"),
        fn.risk_level_calibrated(F.col("value")).alias("calibrated"),
    )


@query(
    "h12_numeric_coerce",
    RAW + "select entry_id, try_cast(pain as double) as pain, try_cast(sleep as double) as sleep, try_cast(latitude as double) as latitude from raw_log",
)
def numeric_coerce(t: Tables):
    return t.raw_log.select("entry_id", *[fn.numeric_coerce(F.col(c)).alias(c) for c in ("pain", "sleep", "latitude")])


_ITEMS = "list_transform(string_split(triggers, ','), lambda x: trim(x))"


@query(
    "h13_rename_in_list",
    CLEAN
    + f"select entry_id, case when list_contains({_ITEMS}, 'Stress') then array_to_string(list_transform({_ITEMS}, "
    "lambda x: case when x = 'Stress' then 'Work stress' else x end), ', ') else triggers end as triggers from log",
)
def rename_in_list(t: Tables):
    return t.log.select(
        "entry_id", fn.rename_in_list(F.col("triggers"), F.lit("Stress"), F.lit(" Work stress ")).alias("triggers")
    )


@query(
    "h14_loc_parse",
    CLEAN
    + "select entry_id, case when latitude is not null and longitude is not null then latitude end as lat, "
    "case when latitude is not null and longitude is not null then longitude end as lon from log",
)
def loc_parse(t: Tables):
    text = F.concat_ws(",", F.col("latitude").cast("string"), F.col("longitude").cast("string"))
    lat, lon = fn.loc_parse(text)
    return t.log.select("entry_id", lat.alias("lat"), lon.alias("lon"))


@query("h15_days_until", CLEAN + f"select entry_id, cast(date - {DAY} as int) as days from log")
def days_until(t: Tables):
    from .bindings import AS_OF

    return t.log.select("entry_id", fn.days_until(F.col("date"), F.lit(AS_OF).cast("date")).alias("days"))


@query(
    "h16_time_shift",
    CLEAN
    + "select distinct date, cast(date - interval 1 month as date) as month_back, cast(date - interval 12 month as date) as year_back, "
    "cast(date_trunc('month', date) as date) as month_start from log",
)
def time_shift(t: Tables):
    day = F.col("date")
    return t.log.select("date").distinct().select(
        "date", fn.months_back(day, 1).alias("month_back"), fn.months_back(day, 12).alias("year_back"), fn.month_start(day).alias("month_start")
    )


@query(
    "h17_baseline_from_frequency",
    CLEAN
    + "select subject_id, month_start, n, base, case when base < 0.3 then 'Rare' when base < 0.6 then 'Frequent' else 'Chronic' end as word "
    "from (select *, cast(case when n >= 15 then 0.9 when n >= 8 then 0.6 when n >= 3 then 0.3 else 0.1 end as double) as base from ("
    "select subject_id, cast(date_trunc('month', date) as date) as month_start, count(distinct date) as n from log where pain > 0 group by 1, 2))",
)
def baseline(t: Tables):
    from ..operators.stats import episode_days

    months = episode_days(t.log).groupBy("subject_id", fn.month_start(F.col("date")).alias("month_start")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return months.withColumn("base", fn.baseline_from_frequency(F.col("n"))).withColumn(
        "word", fn.frequency_class(F.col("base"))
    )


@query(
    "h18_effective_medications",
    CLEAN
    + f"select entry_id, case when len({json_names('medications')}) > 0 then "
    "array_to_string(list_transform(list_filter(cast(from_json(medications, '[\"json\"]') as json[]), "
    "lambda x: json_extract_string(x, '$.name') is not null), lambda x: json_extract_string(x, '$.name') || "
    "case when coalesce(json_extract_string(x, '$.dosage'), '') <> '' then ' (' || json_extract_string(x, '$.dosage') || ')' else '' end), ', ') "
    "when coalesce(medication, '') <> '' then medication || case when coalesce(dosage, '') <> '' then ' (' || dosage || ')' else '' end "
    "else '' end as label from log",
)
def effective_medications(t: Tables):
    items = fn.effective_medications(F.col("medications"), F.col("medication"), F.col("dosage"))
    return t.log.select("entry_id", fn.medication_label(items).alias("label"))


@query("h19_severity_label", CLEAN + f"select entry_id, {_SEVERITY} as severity from log")
def severity_label(t: Tables):
    return t.log.select("entry_id", fn.severity_label(F.col("pain")).alias("severity"))


@query(
    "h20_status_flags",
    with_tables("log", "weather_daily")
    + "select l.entry_id, l.pain > 0 as recovering, coalesce(w.prcp > 0.1, false) as rainy, coalesce(w.average_humidity > 70, false) as humid "
    "from log l left join weather_daily w on w.location_id = l.subject_id and w.date = l.date",
)
def status_flags(t: Tables):
    weather = t.weather_daily.select(F.col("location_id").alias("subject_id"), "date", "prcp", "average_humidity")
    flags = fn.status_flags(F.col("pain"), F.col("prcp"), F.col("average_humidity"))
    return t.log.join(weather, ["subject_id", "date"], "left").select("entry_id", *[c.alias(k) for k, c in flags.items()])


@query(
    "h21_frequency_label",
    with_tables("medications")
    + "select med_id, case frequency when 'as_needed' then 'Acute' when 'daily' then 'Daily' else 'Periodic' end as label from medications",
)
def frequency_label(t: Tables):
    return t.medications.select("med_id", fn.frequency_label(F.col("frequency")).alias("label"))
