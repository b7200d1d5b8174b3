"""The two report tables, each one lazy plan over all requested repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.times import duration_seconds
from reviewlake.operators.joins import (
    join_deployments,
    join_diff_totals,
    join_link_deployment,
    join_pr_activity,
)
from reviewlake.operators.projections import KIND_APPROVAL, KIND_UPDATE
from reviewlake.schemas import SCHEMAS
from reviewlake.sources.raw import of_repos
from reviewlake.sources.store import write_replace

PR_REPORT_COLUMNS = SCHEMAS["pr_report"].names
PIPELINE_REPORT_COLUMNS = SCHEMAS["pipeline_report"].names
_LINK_COLUMNS = ["pipeline_uuid", "environment_name", "deployment_state", "deployment_status"]


def report_activity(activity: DataFrame) -> DataFrame:
    """Approvals and comments under the report's columns; updates are left out."""
    is_approval = F.col("activity_type") == KIND_APPROVAL
    content = F.when(is_approval, F.substring("approval_date", 1, 10)).otherwise(
        F.col("comment_content_raw")
    )
    return activity.where(F.col("activity_type") != KIND_UPDATE).select(
        "repo",
        "pr_id",
        "activity_type",
        F.col("user_display_name").alias("activity_user"),
        content.alias("activity_content"),
    )


def report_prs(
    prs: DataFrame, diffstat: DataFrame, links: DataFrame, deployments: DataFrame
) -> DataFrame:
    """One row per pull request with diff totals, first link and its deployment.

    Diffs, links and deployments are reduced to one row per key before they meet the pull
    requests, and all but the deployment lookup share the (repo, pr_id) partitioning.
    """
    rows = prs.select(
        "repo",
        "pr_id",
        "src_repo",
        "src_branch",
        "dest_repo",
        "dest_branch",
        "title",
        "description",
        "state",
        F.col("author_display_name").alias("author"),
        F.col("created_on").alias("created"),
        F.col("updated_on").alias("updated"),
    )
    rows = join_diff_totals(rows, diffstat)
    rows = rows.join(join_link_deployment(links, deployments), ["repo", "pr_id"], "left")
    return rows.fillna("", _LINK_COLUMNS)


def build_pr_report(
    prs: DataFrame,
    activity: DataFrame,
    diffstat: DataFrame,
    links: DataFrame,
    deployments: DataFrame,
    repos: Sequence[str] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """One row per approval or comment of a known pull request."""
    side = report_prs(
        of_repos(prs, repos),
        of_repos(diffstat, repos),
        of_repos(links, repos),
        of_repos(deployments, repos),
    )
    events = report_activity(of_repos(activity, repos))
    return join_pr_activity(side, events, pieces).select(*PR_REPORT_COLUMNS)


def build_pipeline_report(
    pipelines: DataFrame,
    deployments: DataFrame,
    repos: Sequence[str] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """One row per pipeline and deployment, the duration computed once per pipeline."""
    runs = of_repos(pipelines, repos).select(
        "pipeline_uuid",
        "repo",
        "build_number",
        "run_number",
        F.col("creator_name").alias("creator"),
        "target_ref_type",
        "target_ref_name",
        "trigger_name",
        F.col("state_name"),
        "result_name",
        "created_on",
        "completed_on",
        duration_seconds("created_on", "completed_on", "build_seconds_used").alias(
            "duration_seconds"
        ),
    )
    joined = join_deployments(runs, of_repos(deployments, repos), pieces)
    return joined.select(*PIPELINE_REPORT_COLUMNS)


def write_pr_report(
    spark: SparkSession, report: DataFrame, path: str, repos: Sequence[str]
) -> None:
    """Rebuild the stored report of ``repos``; a second run gives the same table."""
    write_replace(spark, report, path, "pr_report", repos)


def write_pipeline_report(
    spark: SparkSession, report: DataFrame, path: str, repos: Sequence[str]
) -> None:
    write_replace(spark, report, path, "pipeline_report", repos)
