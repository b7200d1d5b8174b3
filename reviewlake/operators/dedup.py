"""Keep-first deduplication, always after filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.text import short_repo
from reviewlake.functions.times import day_or_zero
from reviewlake.sources.csvs import PR_COLUMNS

#: What the charts need of a pull request, and all of its columns. The first list starts the
#: second, so charts and table keep the same row whichever of the two is read.
CHART_ROW = ("repo", "src_repo", "author", "updated", "added", "removed", "total")
PR_ROW = (
    *CHART_ROW,
    "src_branch",
    "dest_repo",
    "dest_branch",
    "title",
    "state",
    "created",
    "file_changed",
)

#: Tie order of pipeline rows after the creation time, chart columns first again.
RUN_TIES = (
    "repo",
    "environment_name",
    "environment_uuid",
    "creator",
    "target_ref_name",
    "result_name",
    "duration_seconds",
    "deployment_state",
    "deployment_status",
)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key. Each input task keeps one row per key before the shuffle, so a key
    with very many rows costs one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dedup_prs(
    df: DataFrame, keys: Sequence[str] = ("pr_id",), columns: Sequence[str] = PR_ROW
) -> DataFrame:
    """One row per pull request, without activity columns.

    The default key merges equal ids of different repositories, the first repository wins;
    ``("repo", "pr_id")`` keeps them apart.
    """
    rest = [c for c in columns if c not in keys]
    return keep_first(df.select("pr_id", *columns), keys, rest)


def pr_rows(prs: DataFrame) -> DataFrame:
    """Table rows: short repository names, unreadable days as the zero day."""
    return prs.select(
        F.col("pr_id").alias("id"),
        short_repo("src_repo").alias("src_repo"),
        "src_branch",
        short_repo("dest_repo").alias("dest_repo"),
        "dest_branch",
        "title",
        "state",
        "author",
        day_or_zero("created").alias("created"),
        day_or_zero("updated").alias("updated"),
        "file_changed",
        "added",
        "removed",
        "total",
    )


def dedup_pipelines(df: DataFrame) -> DataFrame:
    """One row per pipeline: newest time text first, ties by repository and environment."""
    ties = [c for c in RUN_TIES if c in df.columns]
    return keep_first(df, ["pipeline_uuid"], [F.col("created_on").desc(), *ties])


def distinct_prs(activity: DataFrame) -> DataFrame:
    """Distinct pull requests of the CSV rows; copies collapse before the shuffle."""
    return activity.select(*PR_COLUMNS).distinct()
