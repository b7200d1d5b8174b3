"""Time expressions. Days and months come from the text itself, in its own UTC offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.schemas import ZERO_DAY, ZERO_SECOND

# Fixed value: shape of a full timestamp text (RFC 3339).
TIMESTAMP_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_time(col: Column | str) -> Column:
    """Instant of a full timestamp text, NULL for anything else."""
    col = _c(col)
    return F.when(col.rlike(TIMESTAMP_SHAPE), col.try_cast("timestamp"))


def time_or_null(col: Column | str) -> Column:
    """A time that the source may send as ``false`` or another non-text value: then NULL."""
    col = _c(col)
    return F.when(col.rlike(TIMESTAMP_SHAPE), col)


def day_text(col: Column | str) -> Column:
    """Day of a timestamp text; the zero day where it is missing."""
    return F.coalesce(F.substring(_c(col), 1, 10), F.lit(ZERO_DAY))


def seconds_text(col: Column | str, missing: str = ZERO_SECOND) -> Column:
    """Timestamp text without fraction, a zero offset written as ``Z``."""
    whole = F.regexp_replace(_c(col), r"\.\d+", "")
    return F.coalesce(F.regexp_replace(whole, r"[+-]00:00$", "Z"), F.lit(missing))


def day_or_zero(col: Column | str) -> Column:
    """A stored day text, or the zero day where it does not parse."""
    col = _c(col)
    return F.when(F.try_to_date(col, "yyyy-MM-dd").isNotNull(), col).otherwise(ZERO_DAY)


def month_text(col: Column | str) -> Column:
    return F.substring(_c(col), 1, 7)


def run_month(col: Column | str) -> Column:
    """Month of a run's timestamp text, NULL where the time is missing or zero."""
    ts = parse_time(col)
    return F.when(ts != F.lit(ZERO_SECOND).cast("timestamp"), month_text(col))


def duration_seconds(created: Column | str, completed: Column | str, build: Column | str) -> Column:
    """Whole seconds between both times where positive, else the build seconds."""
    micros = F.unix_micros(parse_time(completed)) - F.unix_micros(parse_time(created))
    seconds = F.floor(micros / F.lit(1_000_000)).cast("long")
    return F.when(seconds > 0, seconds).otherwise(_c(build).cast("long"))
