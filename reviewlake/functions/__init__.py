from reviewlake.functions.diffs import diff_line_counts
from reviewlake.functions.text import (
    pipeline_uuid_from_url,
    second_part,
    short_repo,
    trigger_name,
)
from reviewlake.functions.times import (
    day_or_zero,
    day_text,
    duration_seconds,
    month_text,
    parse_time,
    run_month,
    seconds_text,
    time_or_null,
)

__all__ = [
    "day_or_zero",
    "day_text",
    "diff_line_counts",
    "duration_seconds",
    "month_text",
    "parse_time",
    "pipeline_uuid_from_url",
    "run_month",
    "second_part",
    "seconds_text",
    "short_repo",
    "time_or_null",
    "trigger_name",
]
