"""Text expressions: repository names, trigger names, links and display cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers inside source texts, and the characters trimmed from both ends of an id.
TRIGGER_PREFIX = "pipeline_trigger_"
RESULT_MARKER = "/pipelines/results/"
WHITESPACE = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
DASH = "—"
ELLIPSIS = "…"
TITLE_WIDTH = 50


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def short_repo(col: Column | str) -> Column:
    """Text after the first ``/``; a name without one stays as it is."""
    col = _c(col)
    slash = F.instr(col, "/")
    return F.when(slash > 0, F.substring(col, slash + 1, F.length(col))).otherwise(col)


def second_part(col: Column | str) -> Column:
    """Second ``/``-separated part, NULL where there is none (the pivot reports' repo name)."""
    return F.try_element_at(F.split(_c(col), "/"), F.lit(2))


def trigger_name(col: Column | str) -> Column:
    """Trigger type without its fixed prefix, upper case."""
    return F.upper(F.regexp_replace(_c(col), f"^{TRIGGER_PREFIX}", ""))


def pipeline_uuid_from_url(col: Column | str) -> Column:
    """Id after the last result marker, up to ``?`` or ``#``, trimmed; ``''`` without a marker."""
    col = _c(col)
    tail = F.substring_index(col, RESULT_MARKER, -1)
    head = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return F.when(F.instr(col, RESULT_MARKER) > 0, F.btrim(head, F.lit(WHITESPACE))).otherwise("")


def dash_if_empty(col: Column | str) -> Column:
    col = _c(col)
    return F.when(F.coalesce(col, F.lit("")) == "", DASH).otherwise(col)


def cut_title(col: Column | str, width: int = TITLE_WIDTH) -> Column:
    """First ``width`` characters and an ellipsis where the text is longer."""
    col = _c(col)
    cut = F.concat(F.substring(col, 1, width), F.lit(ELLIPSIS))
    return F.when(F.length(col) > width, cut).otherwise(col)


def run_label(run: Column | str, build: Column | str) -> Column:
    """``#run``, or ``#build`` where the run number is 0."""
    number = F.coalesce(F.nullif(_c(run), F.lit(0)), _c(build))
    return F.concat(F.lit("#"), number.cast("string"))


def duration_text(col: Column | str) -> Column:
    """``45s``, ``3m 5s`` or a dash for zero."""
    sec = F.coalesce(_c(col), F.lit(0)).cast("long")
    minutes = F.floor(sec / 60).cast("string")
    long_form = F.concat(minutes, F.lit("m "), (sec % 60).cast("string"), F.lit("s"))
    return (
        F.when(sec == 0, DASH)
        .when(sec < 60, F.concat(sec.cast("string"), F.lit("s")))
        .otherwise(long_form)
    )


def signed_count(sign: str, col: Column | str) -> Column:
    """``+1,234`` / ``-1,234``."""
    return F.concat(F.lit(sign), F.format_number(_c(col), 0))
