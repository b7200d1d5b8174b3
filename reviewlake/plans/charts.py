"""Chart bundles over the report tables.

All charts of a bundle but the review chart need the deduplicated rows. Those are computed once
and rolled up by all chart labels; every chart then adds up the roll-up. The roll-up has one row
per label combination, not per pull request, so it is what a caller keeps
(``roll.persist()``) when several charts are wanted, and ``chart_rows`` reads it in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators import aggregates, ordering
from reviewlake.operators.dedup import CHART_ROW, dedup_pipelines, dedup_prs
from reviewlake.operators.filters import (
    author_filter,
    creator_filter,
    pipeline_filter,
    pr_filter,
    reviewer_filter,
)
from reviewlake.params import PipelineParams, PRParams

#: Run columns the charts need; the environment only decides which row of a run is kept.
RUN_COLUMNS = (
    "pipeline_uuid",
    "created_on",
    "repo",
    "environment_name",
    "environment_uuid",
    "creator",
    "target_ref_name",
    "result_name",
    "duration_seconds",
)


# --- pull requests ---------------------------------------------------------------------------


def pr_roll(
    report: DataFrame,
    params: PRParams = PRParams(),
    bots: Iterable[str] = (),
    keys: tuple[str, ...] = ("pr_id",),
) -> DataFrame:
    """Roll-up of the pull requests that pass the scope and author filters."""
    rows = author_filter(pr_filter(report, params.scope(), bots), params)
    return aggregates.roll_prs(aggregates.pr_measures(dedup_prs(rows, keys, CHART_ROW)))


def review_activity(
    report: DataFrame, params: PRParams = PRParams(), bots: Iterable[str] = ()
) -> DataFrame:
    rows = reviewer_filter(pr_filter(report, params.scope(), bots), params, bots)
    return aggregates.activity_by_user(rows)


def pr_charts(
    report: DataFrame,
    params: PRParams = PRParams(),
    bots: Iterable[str] = (),
    keys: tuple[str, ...] = ("pr_id",),
    roll: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Summary and five ordered charts. Pass a persisted ``pr_roll`` to share it."""
    roll = pr_roll(report, params, bots, keys) if roll is None else roll
    return {
        "summary": aggregates.pr_summary(roll),
        "pr_count_by_author": ordering.order_by_value(aggregates.prs_by_author(roll)),
        "code_changes_by_author": ordering.order_by_total(aggregates.changes_by_author(roll)),
        "activity_by_user": ordering.order_by_activity(review_activity(report, params, bots)),
        "pr_count_by_month": ordering.order_by_label(aggregates.prs_by_month(roll)),
        "code_changes_by_repo": ordering.order_by_total(aggregates.changes_by_repo(roll)),
    }


# --- pipelines -------------------------------------------------------------------------------


def pipeline_roll(
    report: DataFrame, params: PipelineParams = PipelineParams(), bots: Iterable[str] = ()
) -> DataFrame:
    rows = creator_filter(pipeline_filter(report, params.scope(), bots), params, bots)
    unique = dedup_pipelines(rows.select(*RUN_COLUMNS))
    return aggregates.roll_runs(aggregates.run_measures(unique, params.production_refs))


def pipeline_charts(
    report: DataFrame,
    params: PipelineParams = PipelineParams(),
    bots: Iterable[str] = (),
    roll: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Summary and five ordered charts. Environments, targets and results do not filter them."""
    roll = pipeline_roll(report, params, bots) if roll is None else roll
    frequency = aggregates.deployment_frequency(roll)
    return {
        "summary": aggregates.pipeline_summary(roll),
        "deployment_frequency": ordering.order_by_month_and_environment(frequency),
        "results_by_repo": ordering.order_by_results(aggregates.results_by_repo(roll)),
        "pipelines_by_creator": ordering.order_by_value(aggregates.runs_by_creator(roll)),
        "avg_duration_by_repo": ordering.order_by_value(aggregates.mean_duration_by_repo(roll)),
        "pipelines_by_month": ordering.order_by_label(aggregates.runs_by_month(roll)),
    }


# --- whole bundles as one frame ---------------------------------------------------------------


def _cells(chart: str, label: str, cells: dict[str, str]) -> str:
    """SQL array of (chart, label, measure, value) for one grouped row."""
    rows = (
        f"struct('{chart}' as chart, {label} as label, '{name}' as measure, "
        f"cast({value} as bigint) as value)"
        for name, value in cells.items()
    )
    return f"array({', '.join(rows)})"


def _unfold(grouped: DataFrame, cells: str) -> DataFrame:
    rows = grouped.selectExpr(f"inline({cells})")
    return rows.where(F.col("value").isNotNull())


def pr_chart_rows(
    report: DataFrame,
    params: PRParams = PRParams(),
    bots: Iterable[str] = (),
    keys: tuple[str, ...] = ("pr_id",),
) -> DataFrame:
    """All PR charts as ``chart, label, measure, value`` rows from one pass over the roll-up."""
    # Distinct counts need the names outside the grouping columns, which grouping sets blank.
    roll = pr_roll(report, params, bots, keys).selectExpr(
        "*", "author as _author", "src_repo as _repo"
    )
    author, repo, month = F.col("author"), F.col("src_repo"), F.col("month")
    grouped = roll.groupingSets([[author], [repo], [month], []], author, repo, month).agg(
        F.grouping_id().alias("_set"),
        *(aggregates.total_of(c) for c in aggregates.PR_COUNTS),
        F.countDistinct("_author").alias("authors"),
        F.countDistinct("_repo").alias("repos"),
    )
    count = {"value": "prs"}
    changes = {"added": "added", "removed": "removed", "total": "total"}
    totals = {
        "total_prs": "prs",
        "total_added": "added",
        "total_removed": "removed",
        "total_changed": "total",
        "unique_authors": "authors",
        "unique_repos": "repos",
    }
    # grouping_id bits, left to right: author, repository, month; a set bit is a blanked column.
    cells = f"""case _set
        when 3 then concat({_cells("pr_count_by_author", "author", count)},
                           {_cells("code_changes_by_author", "author", changes)})
        when 5 then {_cells("code_changes_by_repo", "src_repo", changes)}
        when 6 then {_cells("pr_count_by_month", "month", count)}
        else {_cells("summary", "''", totals)} end"""
    reviews = {"approval": "approval", "comment": "comment"}
    return _unfold(grouped, cells).unionByName(
        _unfold(
            review_activity(report, params, bots), _cells("activity_by_user", "label", reviews)
        )
    )


def pipeline_chart_rows(
    report: DataFrame, params: PipelineParams = PipelineParams(), bots: Iterable[str] = ()
) -> DataFrame:
    """All pipeline charts as ``chart, label, measure, value`` rows from one pass; the label of
    the deployment frequency is ``month ref``."""
    roll = pipeline_roll(report, params, bots).selectExpr(
        "*", "nullif(creator, '') as _creator", "repo as _repo"
    )
    creator, repo = F.col("creator"), F.col("repo")
    month, ref = F.col("month"), F.col("production_ref")
    sets = [[creator], [repo], [month], [month, ref], []]
    grouped = roll.groupingSets(sets, creator, repo, month, ref).agg(
        F.grouping_id().alias("_set"),
        *(aggregates.total_of(c) for c in aggregates.RUN_COUNTS),
        F.countDistinct("_creator").alias("creators"),
        F.countDistinct("_repo").alias("repos"),
    )
    mean = "seconds div nullif(timed, 0)"
    results = {c: c for c in ("successful", "failed", "error", "stopped")}
    totals = {
        "total_pipelines": "runs",
        "success_count": "successful",
        "failed_count": "failed",
        "error_count": "error",
        "stopped_count": "stopped",
        "avg_duration_seconds": f"coalesce({mean}, 0)",
        "unique_creators": "creators",
        "unique_repos": "repos",
    }
    by_creator = {"value": "if(creator = '', null, runs)"}
    month_ref = "concat_ws(' ', month, production_ref)"
    by_month = {"value": "if(month is null, null, runs)"}
    frequency = {
        "count": "if(month is null or production_ref = '' or successful = 0, null, successful)"
    }
    # grouping_id bits, left to right: creator, repository, month, ref.
    cells = f"""case _set
        when 7 then {_cells("pipelines_by_creator", "creator", by_creator)}
        when 11 then concat({_cells("results_by_repo", "repo", results)},
                            {_cells("avg_duration_by_repo", "repo", {"value": mean})})
        when 13 then {_cells("pipelines_by_month", "month", by_month)}
        when 12 then {_cells("deployment_frequency", month_ref, frequency)}
        else {_cells("summary", "''", totals)} end"""
    return _unfold(grouped, cells)
