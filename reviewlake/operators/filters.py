"""Row filters. Each returns a ``Column`` or a filtered frame; lists that are empty are off.

Stored times are text. Bounds are written so that a plain comparison on the stored column is
part of the predicate wherever it can be: that part reaches the parquet scan, the parsed part
makes it exact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import short_repo
from reviewlake.functions.times import day_or_zero, parse_time, run_month
from reviewlake.params import (
    END_OF_DAY,
    PR_STATES,
    RESULT_SUCCESS,
    PipelineParams,
    PRParams,
    clean_list,
)
from reviewlake.schemas import ZERO_SECOND

#: Days after it have no coarse upper bound, which lies two days later.
LAST_DAY = dt.date.max - dt.timedelta(days=2)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def all_of(parts: Iterable[Column | None]) -> Column:
    """Conjunction of the given predicates, TRUE for none."""
    out = None
    for part in parts:
        if part is not None:
            out = part if out is None else out & part
    return F.lit(True) if out is None else out


def among(col: Column | str, values: Iterable[str]) -> Column | None:
    names = clean_list(values)
    return _c(col).isin(names) if names else None


def not_among(col: Column | str, values: Iterable[str]) -> Column | None:
    names = clean_list(values)
    return ~_c(col).isin(names) if names else None


def among_short(col: Column | str, values: Iterable[str]) -> Column | None:
    """Short repository name among ``values``. The stored name is then one of them or ends with one behind a
    slash, which reaches the scan and skips row groups whose dictionary has no such name."""
    names = clean_list(values)
    if not names:
        return None
    ends = [_c(col).endswith(f"/{n}") for n in names]
    return reduce(or_, ends, _c(col).isin(names)) & short_repo(col).isin(names)


def either_among(first: str, second: str, values: Iterable[str]) -> Column | None:
    names = clean_list(values)
    return F.col(first).isin(names) | F.col(second).isin(names) if names else None


# --- ingest ranges ---------------------------------------------------------------------------


def created_between(
    col: Column | str,
    from_: dt.date | None = None,
    to: dt.date | None = None,
    extra: str | None = None,
) -> Column:
    """Stored creation day within both bounds, and ``extra`` as one bracketed condition."""
    col = _c(col)
    return all_of(
        [
            col >= F.lit(from_.isoformat()) if from_ else None,
            col <= F.lit(to.isoformat()) if to else None,
            F.expr(f"({extra})") if extra else None,
        ]
    )


def in_known_states(col: Column | str = "state") -> Column:
    return _c(col).isin(list(PR_STATES))


def ts_between(
    col: Column | str, from_: dt.datetime | None = None, to: dt.datetime | None = None
) -> Column:
    """Timestamp within both bounds (taken as UTC), either may be open."""
    col = _c(col)
    utc = lambda t: F.lit(f"{t.isoformat()}Z").cast("timestamp")
    return all_of([col >= utc(from_) if from_ else None, col <= utc(to) if to else None])


def env_matches(col: Column | str, names: Iterable[str]) -> Column:
    """Environment name among ``names``, ignoring case; an empty list keeps all."""
    lowered = [n.lower() for n in clean_list(names)]
    return F.lower(_c(col)).isin(lowered) if lowered else F.lit(True)


# --- report rows -----------------------------------------------------------------------------


def _day_bounds(col: str, low: dt.date | None, high: dt.date | None) -> list[Column | None]:
    """Bounds on the stored text reach the scan. Texts that are no day count as the zero day, so the
    upper one holds for the text only where a lower bound drops that day."""
    exact = day_or_zero(col)
    from_ = F.lit(low.isoformat()) if low else None
    return [
        F.col(col) <= F.lit(high.isoformat()) if high and low and low > dt.date.min else None,
        F.col(col) >= from_ if low else None,
        exact >= from_ if low else None,
        exact <= F.lit(high.isoformat()) if high else None,
    ]


def pr_predicate(params: PRParams, bots: Iterable[str] = ()) -> Column:
    """Table rule: names match the author or the acting user."""
    drop = either_among("author", "activity_user", (*bots, *params.exclude_users))
    return all_of(
        [
            ~drop if drop is not None else None,
            *_day_bounds("updated", params.date_from, params.date_to),
            among_short("src_repo", params.repos),
            either_among("author", "activity_user", params.authors),
        ]
    )


def pr_filter(df: DataFrame, params: PRParams, bots: Iterable[str] = ()) -> DataFrame:
    return df.where(pr_predicate(params, bots))


def author_filter(df: DataFrame, params: PRParams) -> DataFrame:
    """Chart rule: include and exclude names match the author only."""
    return df.where(
        all_of([among("author", params.authors), not_among("author", params.exclude_users)])
    )


def reviewer_filter(df: DataFrame, params: PRParams, bots: Iterable[str] = ()) -> DataFrame:
    """Review chart rule: names match the acting user only, who must be named and no bot."""
    return df.where(
        all_of(
            [
                F.col("activity_user") != "",
                among("activity_user", params.authors),
                not_among("activity_user", (*bots, *params.exclude_users)),
            ]
        )
    )


def _instant_bounds(params: PipelineParams) -> list[Column | None]:
    zero = F.lit(ZERO_SECOND).cast("timestamp")
    exact = F.coalesce(parse_time("created_on"), zero)
    parts: list[Column | None] = []
    if params.date_from:
        # The text is in its own offset, less than a day away from UTC.
        low = dt.datetime.combine(params.date_from, dt.time())
        if params.date_from > dt.date.min:
            coarse = (params.date_from - dt.timedelta(days=1)).isoformat()
            parts.append(F.col("created_on") >= F.lit(coarse))
            # unreadable texts count as the zero time, which the lower bound drops
            if params.date_to and params.date_to < LAST_DAY:
                coarse = (params.date_to + dt.timedelta(days=2)).isoformat()
                parts.append(F.col("created_on") < F.lit(coarse))
        parts.append(ts_between(exact, low))
    if params.date_to:
        high = dt.datetime.combine(params.date_to, dt.time())
        high += END_OF_DAY if params.date_to_end_of_day else dt.timedelta()
        parts.append(ts_between(exact, None, high))
    return parts


def pipeline_predicate(params: PipelineParams, bots: Iterable[str] = ()) -> Column:
    return all_of(
        [
            not_among("creator", (*bots, *params.exclude_users)),
            *_instant_bounds(params),
            among("repo", params.repos),
            among("creator", params.creators),
            among("environment_name", params.environments),
            among("target_ref_name", params.targets),
            among("result_name", params.result_names),
        ]
    )


def pipeline_filter(df: DataFrame, params: PipelineParams, bots: Iterable[str] = ()) -> DataFrame:
    return df.where(pipeline_predicate(params, bots))


def creator_filter(df: DataFrame, params: PipelineParams, bots: Iterable[str] = ()) -> DataFrame:
    """Chart rule: names match the creator; environments, targets and results do not apply."""
    return df.where(
        all_of(
            [
                among("creator", params.creators),
                not_among("creator", (*bots, *params.exclude_users)),
            ]
        )
    )


def production_predicate(refs: Iterable[str]) -> Column:
    """Successful run with a date on a production ref; no refs, no rows."""
    names = clean_list(refs)
    if not names:
        return F.lit(False)
    return (
        (F.col("result_name") == RESULT_SUCCESS)
        & F.col("target_ref_name").isin(names)
        & run_month("created_on").isNotNull()
    )


def notebook_filter(
    df: DataFrame,
    repos: Iterable[str] = (),
    from_: dt.date | None = None,
    to: dt.date | None = None,
) -> DataFrame:
    """Pivot reports: full repository names and an inclusive range of ``Updated``."""
    as_ts = lambda d: F.lit(d.isoformat()).cast("timestamp")
    return df.where(
        all_of(
            [
                among("SrcRepo", repos),
                F.col("Updated") >= as_ts(from_) if from_ else None,
                F.col("Updated") <= as_ts(to) if to else None,
            ]
        )
    )
