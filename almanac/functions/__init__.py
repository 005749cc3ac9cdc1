"""Column expressions shared by the table operators."""

from .calendar import (
    cyclical,
    date_label,
    days_until,
    month_start,
    months_back,
    time_to_hour,
    time_to_minutes,
    valid_date,
    valid_time,
)
from .labels import (
    activity_label,
    baseline_from_frequency,
    c_to_f,
    frequency_class,
    frequency_label,
    severity_label,
    sleep_label,
    status_flags,
)
from .numeric import log_target, nan_to_null, numeric_coerce, round_half_up, unlog_target
from .risk import risk_level_calibrated, risk_level_model, risk_level_rules
from .text import (
    blank_to_null,
    effective_medications,
    is_json,
    loc_parse,
    med_names,
    medication_label,
    parse_meds,
    rename_in_list,
    split_list,
    strip,
    to_meds_json,
)

__all__ = [name for name in dir() if not name.startswith("_")]
