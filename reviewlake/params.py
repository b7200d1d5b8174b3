"""Filter parameters: driver-side normalisation of lists and dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

END_OF_DAY = dt.timedelta(days=1) - dt.timedelta(microseconds=1)


def clean_list(values: Iterable[str] | None) -> list[str]:
    """Drop blank entries, keep order and spelling, remove repeats. Empty means filter off."""
    return list(dict.fromkeys(v for v in values or () if v and v.strip()))


def parse_day(value: str | dt.date | None) -> dt.date | None:
    """A ``YYYY-MM-DD`` day; anything else sets no bound."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date) or value is None:
        return value
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date() if len(value) == 10 else None
    except ValueError:
        return None


def parse_range(
    from_: str | None, to: str | None, end_of_day: bool = True
) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Ingest range: midnight of ``from_`` up to the last instant (or midnight) of ``to``."""
    low, high = parse_day(from_), parse_day(to)
    start = dt.datetime.combine(low, dt.time()) if low else None
    end = dt.datetime.combine(high, dt.time()) if high else None
    return start, (end + END_OF_DAY if end and end_of_day else end)


def lookback_start(period: str, today: dt.date | None = None) -> dt.date | None:
    """First day of a preset: ``daily`` since yesterday, ``monthly`` since the 1st, ``all`` open."""
    today = today or dt.date.today()
    if period == "daily":
        return today - dt.timedelta(days=1)
    if period == "monthly":
        return today.replace(day=1)
    if period == "all":
        return None
    raise ValueError(f"unknown look-back period: {period!r}")


def _names(d: Mapping, key: str) -> tuple[str, ...]:
    value = d.get(key)
    return tuple(clean_list([value] if isinstance(value, str) else value))


@dataclass(frozen=True)
class PRParams:
    """Pull-request filters. Include and exclude names match author or user in the table,
    author only in PR charts and user only in the review chart."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    repos: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    exclude_users: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, d: Mapping) -> PRParams:
        return cls(
            date_from=parse_day(d.get("dateFrom")),
            date_to=parse_day(d.get("dateTo")),
            repos=_names(d, "repos"),
            authors=_names(d, "authors"),
            exclude_users=_names(d, "excludeUsers"),
        )

    def scope(self) -> PRParams:
        """Only the parts that apply to every chart."""
        return PRParams(self.date_from, self.date_to, self.repos)


@dataclass(frozen=True)
class PipelineParams:
    """Pipeline filters. ``date_to`` is midnight unless ``date_to_end_of_day`` is set."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    repos: tuple[str, ...] = ()
    creators: tuple[str, ...] = ()
    exclude_users: tuple[str, ...] = ()
    environments: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    result_names: tuple[str, ...] = ()
    production_refs: tuple[str, ...] = field(default=())
    date_to_end_of_day: bool = False

    @classmethod
    def from_dict(cls, d: Mapping, production_refs: Iterable[str] = ()) -> PipelineParams:
        return cls(
            date_from=parse_day(d.get("dateFrom")),
            date_to=parse_day(d.get("dateTo")),
            repos=_names(d, "repos"),
            creators=_names(d, "creators"),
            exclude_users=_names(d, "excludeUsers"),
            environments=_names(d, "environments"),
            targets=_names(d, "targets"),
            result_names=_names(d, "resultNames"),
            production_refs=tuple(clean_list(production_refs)),
        )

    def scope(self) -> PipelineParams:
        """Only the parts that apply to every chart."""
        return PipelineParams(
            self.date_from,
            self.date_to,
            self.repos,
            date_to_end_of_day=self.date_to_end_of_day,
        )

    def production_deployments(self) -> PipelineParams:
        """Preset of the deployments table: successful runs, production refs added to targets."""
        return PipelineParams(
            self.date_from,
            self.date_to,
            self.repos,
            self.creators,
            self.exclude_users,
            self.environments,
            tuple(clean_list((*self.targets, *self.production_refs))),
            (RESULT_SUCCESS,),
            self.production_refs,
            self.date_to_end_of_day,
        )


# Pull-request states and run results named by the source system.
PR_STATES = ("OPEN", "MERGED", "DECLINED", "SUPERSEDED")
RESULT_SUCCESS = "SUCCESSFUL"
RESULT_FAILED = "FAILED"
RESULT_ERROR = "ERROR"
RESULT_STOPPED = "STOPPED"
