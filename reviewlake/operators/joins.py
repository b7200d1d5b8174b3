"""Joins between the raw tables. Keys always include the repository."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import RESULT_MARKER, pipeline_uuid_from_url
from reviewlake.operators.filters import env_matches
from reviewlake.operators.skew import join_pieces, with_unmatched

PR_KEY = ["repo", "pr_id"]
RUN_KEY = ["repo", "pipeline_uuid"]


def join_pr_activity(prs: DataFrame, activity: DataFrame, pieces: int | None = None) -> DataFrame:
    """Activity with its pull request; activity of unknown ones and silent ones drop out.

    One pull request may hold much of the activity: as the left side of an inner join it can be split.
    ``pieces`` cuts every key besides.
    """
    if pieces:
        return join_pieces(activity, prs, PR_KEY, pieces)
    return activity.join(prs, PR_KEY)


def diff_totals(diffstat: DataFrame) -> DataFrame:
    """Files, added, removed and total lines per pull request."""
    added = F.sum("lines_added")
    removed = F.sum("lines_removed")
    return diffstat.groupBy(*PR_KEY).agg(
        F.count(F.lit(1)).alias("file_changed"),
        added.alias("added"),
        removed.alias("removed"),
        (added + removed).alias("total"),
    )


def join_diff_totals(prs: DataFrame, diffstat: DataFrame) -> DataFrame:
    """Diff totals next to each pull request, zeros where it has no diff rows."""
    joined = prs.join(diff_totals(diffstat), PR_KEY, "left")
    return joined.fillna(0, subset=["file_changed", "added", "removed", "total"])


def first_links(links: DataFrame) -> DataFrame:
    """The smallest pipeline id linked to each pull request."""
    return links.groupBy(*PR_KEY).agg(F.min("pipeline_uuid").alias("pipeline_uuid"))


def join_first_link(prs: DataFrame, links: DataFrame) -> DataFrame:
    return prs.join(first_links(links), PR_KEY, "left").fillna("", subset=["pipeline_uuid"])


def last_deployments(deployments: DataFrame) -> DataFrame:
    """Newest deployment per pipeline, the greatest id among equal times."""
    picked = F.struct("environment_name", "state_name", "status_name")
    newest = F.max_by(picked, F.struct("created_on", "deployment_uuid"))
    one = deployments.groupBy(*RUN_KEY).agg(newest.alias("d"))
    return one.select(
        *RUN_KEY,
        F.col("d.environment_name").alias("environment_name"),
        F.col("d.state_name").alias("deployment_state"),
        F.col("d.status_name").alias("deployment_status"),
    )


def join_link_deployment(links: DataFrame, deployments: DataFrame) -> DataFrame:
    """First link per pull request with its pipeline's deployment, ``''`` where it has none.
    Many pull requests may share one pipeline."""
    joined = first_links(links).join(last_deployments(deployments), RUN_KEY, "left")
    return joined.fillna("", ["environment_name", "deployment_state", "deployment_status"])


def join_deployments(
    pipelines: DataFrame, deployments: DataFrame, pieces: int | None = None
) -> DataFrame:
    """One row per pipeline and deployment; a pipeline without any has empty environment."""
    deps = deployments.select(
        *RUN_KEY,
        "environment_uuid",
        "environment_name",
        F.col("state_name").alias("deployment_state"),
        F.col("status_name").alias("deployment_status"),
    )
    both = join_pieces(deps, pipelines, RUN_KEY, pieces) if pieces else deps.join(pipelines, RUN_KEY)
    joined = with_unmatched(both, deps, pipelines, RUN_KEY)
    return joined.fillna(
        "", ["environment_uuid", "environment_name", "deployment_state", "deployment_status"]
    )


def new_keys(candidates: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct candidate keys that are not stored yet. The stored side is first reduced to keys of the
    batch, against its keys as one broadcast row set while they are small, so a large store is
    read but not shuffled; what is left of it is one row a key and task."""
    keys = list(keys)
    wanted = candidates.select(*keys).distinct()
    known = stored.select(*keys).join(wanted, keys, "left_semi").distinct()
    return wanted.join(known, keys, "left_anti")


def status_links(statuses: DataFrame) -> DataFrame:
    """Distinct pull request to pipeline links named by build statuses. Addresses without the
    marker are dropped by a plain test on the stored column first."""
    named = statuses.where(F.col("url").contains(RESULT_MARKER))
    uuid = pipeline_uuid_from_url("url").alias("pipeline_uuid")
    return named.select("repo", "pr_id", uuid).where("pipeline_uuid <> ''").distinct()


def pipelines_to_resolve(statuses: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Pipelines that statuses name and that are not stored yet."""
    return new_keys(status_links(statuses), pipelines, RUN_KEY)


def step_deployments(
    pipelines: DataFrame,
    steps: DataFrame,
    deployments: DataFrame,
    stored: DataFrame,
    environments: Iterable[str] = (),
) -> DataFrame:
    """Landed deployments that steps of not yet covered pipelines point to.

    ``steps`` carry ``repo``, ``pipeline_uuid`` and ``deployment_uuid``; ``deployments`` are the
    landed rows, ``stored`` the ones already in the table.
    """
    open_runs = new_keys(pipelines, stored, RUN_KEY)
    wanted = (
        steps.where("deployment_uuid <> ''")
        .select(*RUN_KEY, "deployment_uuid")
        .distinct()
        .join(open_runs, RUN_KEY, "left_semi")
        .select("repo", "deployment_uuid")
        .distinct()
    )
    matching = deployments.where(env_matches("environment_name", environments))
    return matching.join(wanted, ["repo", "deployment_uuid"], "left_semi")
