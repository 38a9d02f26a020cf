from headwise.functions.clock import (
    clock_seconds,
    hour_number,
    local_date,
    local_hour,
    local_text,
    local_timestamp,
    minutes,
    utc_date,
    utc_hour,
)
from headwise.functions.text import blank_to_null, label_or_id, to_number, zero_to_null

__all__ = [
    "blank_to_null",
    "clock_seconds",
    "hour_number",
    "label_or_id",
    "local_text",
    "local_date",
    "local_hour",
    "local_timestamp",
    "minutes",
    "utc_date",
    "utc_hour",
    "to_number",
    "zero_to_null",
]
