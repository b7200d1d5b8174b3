"""Paged tables and their display form."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import (
    cut_title,
    dash_if_empty,
    duration_text,
    run_label,
    signed_count,
)
from reviewlake.operators.dedup import dedup_pipelines, dedup_prs, pr_rows
from reviewlake.operators.filters import pipeline_filter, pr_filter
from reviewlake.operators.paging import Page, paged
from reviewlake.params import PipelineParams, PRParams


def pr_table_rows(
    report: DataFrame,
    params: PRParams = PRParams(),
    bots: Iterable[str] = (),
    keys: tuple[str, ...] = ("pr_id",),
) -> DataFrame:
    """All filtered pull requests, one row each."""
    return pr_rows(dedup_prs(pr_filter(report, params, bots), keys))


def pr_table(
    report: DataFrame,
    params: PRParams = PRParams(),
    bots: Iterable[str] = (),
    page: int | None = None,
    size: int | None = None,
    keys: tuple[str, ...] = ("pr_id",),
    deep: bool = False,
) -> Page:
    """One page in pull-request id order, equal ids by repository.

    The page is found on the distinct keys alone; only its rows, at most 200 keys, are read in full.
    """
    matching = pr_filter(report, params, bots)
    order = [k for k in ("pr_id", "repo") if k in keys]
    picked = paged(matching.select(*keys).distinct(), order, page, size, deep=deep)
    held = matching.join(F.broadcast(picked.rows), list(keys), "left_semi")  # of at most 200 keys
    return replace(picked, rows=pr_rows(dedup_prs(held, keys).orderBy("pr_id", "repo")))


def pipeline_table_rows(
    report: DataFrame, params: PipelineParams = PipelineParams(), bots: Iterable[str] = ()
) -> DataFrame:
    """All filtered runs, one row each."""
    return dedup_pipelines(pipeline_filter(report, params, bots))


def pipeline_table(
    report: DataFrame,
    params: PipelineParams = PipelineParams(),
    bots: Iterable[str] = (),
    page: int | None = None,
    size: int | None = None,
) -> Page:
    """One page, newest first. As for pull requests, the page is found on narrow keys: a run's newest time and
    the least repository that has it."""
    order = [F.col("created_on").desc(), "repo", "pipeline_uuid"]
    matching = pipeline_filter(report, params, bots)
    newest = dedup_pipelines(matching.select("pipeline_uuid", "created_on", "repo"))
    picked = paged(newest, order, page, size)
    held = matching.join(F.broadcast(picked.rows.select("pipeline_uuid")), "pipeline_uuid", "left_semi")
    return replace(picked, rows=dedup_pipelines(held).orderBy(*order))


def deployments_table(
    report: DataFrame,
    params: PipelineParams,
    bots: Iterable[str] = (),
    page: int | None = None,
    size: int | None = None,
) -> Page:
    """Successful runs on the production refs (and any selected targets), newest first."""
    return pipeline_table(report, params.production_deployments(), bots, page, size)


def pr_display(rows: DataFrame) -> DataFrame:
    """Table cells of pull requests as shown."""
    return rows.select(
        F.concat(F.lit("#"), F.col("id").cast("string")).alias("number"),
        F.col("src_repo").alias("repo"),
        cut_title("title").alias("title"),
        "author",
        "state",
        "updated",
        signed_count("+", "added").alias("added"),
        signed_count("-", "removed").alias("removed"),
        F.col("file_changed").cast("string").alias("files"),
    )


def pipeline_display(rows: DataFrame) -> DataFrame:
    """Table cells of runs as shown."""
    return rows.select(
        run_label("run_number", "build_number").alias("number"),
        "repo",
        dash_if_empty("creator").alias("creator"),
        dash_if_empty("target_ref_name").alias("ref"),
        dash_if_empty("trigger_name").alias("trigger"),
        dash_if_empty("state_name").alias("state"),
        dash_if_empty("result_name").alias("result"),
        dash_if_empty("environment_name").alias("environment"),
        duration_text("duration_seconds").alias("duration"),
        dash_if_empty(F.substring("created_on", 1, 10)).alias("created"),
    )
