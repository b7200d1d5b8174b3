"""Every inventory row as a named query over the test tables.

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame. Sinks write into a fresh shared
folder and read back what they wrote.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake import fixtures
from reviewlake.functions.diffs import diff_line_counts
from reviewlake.functions.text import (
    pipeline_uuid_from_url,
    second_part,
    short_repo,
    trigger_name,
)
from reviewlake.functions.times import (
    day_text,
    duration_seconds,
    month_text,
    parse_time,
    seconds_text,
    time_or_null,
)
from reviewlake.operators import aggregates, ordering, pivots, projections
from reviewlake.operators.dedup import dedup_pipelines, dedup_prs, distinct_prs, pr_rows
from reviewlake.operators.filters import (
    author_filter,
    created_between,
    creator_filter,
    env_matches,
    in_known_states,
    notebook_filter,
    pipeline_filter,
    pr_filter,
    production_predicate,
    reviewer_filter,
    ts_between,
)
from reviewlake.operators.joins import (
    PR_KEY,
    RUN_KEY,
    diff_totals,
    join_deployments,
    join_diff_totals,
    join_first_link,
    join_link_deployment,
    join_pr_activity,
    new_keys,
    pipelines_to_resolve,
    status_links,
    step_deployments,
)
from reviewlake.operators.paging import page_count
from reviewlake.operators.skew import join_pieces, with_unmatched
from reviewlake.params import PipelineParams, PRParams, lookback_start, parse_range
from reviewlake.plans.charts import (
    pipeline_chart_rows,
    pipeline_charts,
    pr_chart_rows,
    pr_charts,
)
from reviewlake.plans.reports import report_activity, write_pipeline_report, write_pr_report
from reviewlake.plans.tables import (
    deployments_table,
    pipeline_display,
    pipeline_table,
    pipeline_table_rows,
    pr_display,
    pr_table,
    pr_table_rows,
)
from reviewlake.schemas import ADDED_LATER, RECORDS, SCHEMAS, evolve
from reviewlake.session import kept, shared_dir
from reviewlake.sources import store
from reviewlake.sources.csvs import (
    EXPORT_COLUMNS,
    export_csv,
    export_frame,
    parse_csv,
    read_activity_csv,
)
from reviewlake.sources.pages import read_pages, sorted_out, split_rejected
from reviewlake.sources.raw import decode_raw, pr_link_lists, pr_links, read_table
from reviewlake.sources.reports import (
    read_pipeline_report,
    read_pr_report,
    with_days,
    with_instants,
)
from reviewlake.streaming.ingest import flatten, start_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters the registered queries use; the check SQL states the same values.
BOTS = ("user-3",)
REFS = ("main", "master")
PR_REQUEST = {
    "dateFrom": "1994-01-01",
    "dateTo": "1997-12-31",
    "repos": ["repo-1", "repo-2", "repo-4", "repo-7", " "],
    "authors": ["user-5", "user-6", "user-7", "user-8", "user-9", ""],
    "excludeUsers": ["user-8", "user-11"],
}
RUN_REQUEST = {
    "dateFrom": "2024-02-01",
    "dateTo": "2024-05-31",
    "repos": ["repo-1", "repo-2", "repo-4", "repo-7"],
    "creators": ["user-5", "user-6", "user-7", "user-8", "user-9", "user-10"],
    "excludeUsers": ["user-8", ""],
    "environments": ["Staging", "Production"],
    "targets": ["main", "develop"],
    "resultNames": ["SUCCESSFUL", "FAILED"],
}
PR_PARAMS = PRParams.from_dict(PR_REQUEST)
PR_NAMES = PRParams(authors=PR_PARAMS.authors, exclude_users=PR_PARAMS.exclude_users)
RUN_PARAMS = PipelineParams.from_dict(RUN_REQUEST, REFS)
RUN_REFS = PipelineParams(production_refs=REFS)
RUN_NAMES = PipelineParams(
    creators=RUN_PARAMS.creators,
    exclude_users=RUN_PARAMS.exclude_users,
    production_refs=REFS,
)
REPLACED = ("repo-1", "repo-2", "repo-3")


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def _prs(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated pull requests as chart measures."""
    return aggregates.pr_measures(dedup_prs(fixtures.pr_report(spark, d)))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.run_measures(dedup_pipelines(fixtures.pipeline_report(spark, d)), REFS)


def _text(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns as text, so that both sides compare the same form."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _ranked(df: DataFrame) -> DataFrame:
    """An ordered result of chart rows with the place of every row."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("rank", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def _repos(df: DataFrame) -> list[str]:
    return store.touched_repos(df)


# --- scans, sources, sinks -------------------------------------------------------------------


@query("s1_page_scan")
def _(spark, d):
    rows = read_pages(spark, fixtures.land_pages(spark, d), RECORDS["pull_request"])
    return rows.select(
        "repo",
        F.col("id").alias("pr_id"),
        "title",
        "state",
        F.col("author.display_name").alias("author"),
        F.col("source.repository.full_name").alias("src_repo"),
    )


@query("s1_child_pages")
def _(spark, d):
    """Every kind of child page; what a record does not name itself comes from its page."""
    said = {"activity": "activity_type", "commit": "hash", "comment": "content_raw", "status": "url", "diffstat": "new_path"}
    parts = []
    for kind, column in said.items():
        rows = flatten(read_pages(spark, fixtures.land_pages(spark, d, kind), RECORDS[kind]), kind)
        parts.append(rows.select(F.lit(kind).alias("kind"), "repo", "pr_id", F.col(column).alias("said")))
    return functools.reduce(DataFrame.unionByName, parts)


@query("s1_rejected_records")
def _(spark, d):
    """Pull requests of which the declined ones have ids that are no numbers."""
    texts = spark.read.text(fixtures.land_pages(spark, d, broken="item.state = 'DECLINED'"))
    good, bad = split_rejected(sorted_out(texts, RECORDS["pull_request"]))
    rows = good.select("repo", "title", "state", F.lit("").alias("reason"))
    title = F.get_json_object("reject_text", "$.title").alias("title")
    return rows.unionByName(bad.select("repo", title, F.lit("DECLINED").alias("state"), F.col("reject_reason").alias("reason")))


@query("s2_decode_prs")
def _(spark, d):
    rows = decode_raw(fixtures.raw_json(spark, d, "pull_request"), RECORDS["pull_request"])
    return rows.select(
        "repo", "pr_id", "title", "description", F.col("author.display_name").alias("author")
    )


@query("s2_decode_activity")
def _(spark, d):
    rows = decode_raw(fixtures.raw_json(spark, d, "activity"), RECORDS["activity"])
    user = F.coalesce(
        "comment.user.display_name", "approval.user.display_name", "update.author.display_name"
    )
    return rows.select("repo", "pr_id", user.alias("activity_user"))


@query("s2_decode_diffstat")
def _(spark, d):
    texts = fixtures.raw_json(spark, d, "diffstat")
    rows = decode_raw(texts, RECORDS["diffstat"], ["repo-1", "repo-2"])
    return rows.select("repo", "pr_id", "lines_added", "lines_removed")


@query("s3_decode_runs")
def _(spark, d):
    rows = decode_raw(fixtures.raw_json(spark, d, "pipeline"), RECORDS["pipeline"])
    return rows.select(
        "repo",
        F.col("uuid").alias("pipeline_uuid"),
        "build_number",
        F.col("state.result.name").alias("result_name"),
        F.coalesce("creator.display_name", F.lit("")).alias("creator"),
    )


@query("s3_decode_deployments")
def _(spark, d):
    rows = decode_raw(fixtures.raw_json(spark, d, "deployment"), RECORDS["deployment"])
    return rows.select(
        "repo",
        F.col("uuid").alias("deployment_uuid"),
        F.col("pipeline.uuid").alias("pipeline_uuid"),
        F.col("environment.name").alias("environment_name"),
    )


@query("s4_pr_links")
def _(spark, d):
    return pr_links(fixtures.raw(spark, d, "pr_pipelines"))


@query("s4_pr_link_lists")
def _(spark, d):
    lists = pr_link_lists(fixtures.raw(spark, d, "pr_pipelines"))
    return lists.select(
        "repo", "pr_id", "part", F.array_join("pipeline_uuids", ",").alias("pipeline_uuids")
    )


@query("s5_pr_report_scan")
def _(spark, d):
    rows = with_days(fixtures.pr_report(spark, d))
    return _text(
        rows.select("repo", "pr_id", "author", "created_date", "updated_date"),
        "created_date",
        "updated_date",
    )


@query("s6_ci_report_scan")
def _(spark, d):
    rows = with_instants(fixtures.pipeline_report(spark, d))
    return rows.select(
        "pipeline_uuid",
        "environment_name",
        F.unix_seconds("created_ts").alias("created_epoch"),
        F.unix_seconds("completed_ts").alias("completed_epoch"),
    )


def _exported(spark: SparkSession, d: str) -> str:
    path = shared_dir(spark, "export")
    export_csv(fixtures.pr_report(spark, d), path)
    return path


@query("s7_csv_scan")
def _(spark, d):
    rows = read_activity_csv(spark, _exported(spark, d))
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("Created", "Updated")}
    return rows.withColumns(days).select(*EXPORT_COLUMNS)


@query("k1_upsert")
def _(spark, d):
    prs = fixtures.raw(spark, d, "pull_requests").drop("raw_json", "reviewers", "participants")
    merged = prs.where(F.col("state") == "MERGED")
    writes = [
        merged.withColumns(
            {"title": F.concat("title", F.lit(f" v{n}")), "seq": F.lit(n)}
        )
        for n in (1, 2)
    ]
    rows = store.upsert(prs, writes[0].unionByName(writes[1]), ("repo", "pr_id"), "seq")
    return rows.select("repo", "pr_id", "title", "state", "author_display_name")


def _streamed(spark: SparkSession, d: str, kind: str, table: str, stored: DataFrame, landed: str) -> DataFrame:
    """A stored table after pages of the ``landed`` records were streamed into it."""
    path = shared_dir(spark, f"stream-{table}")
    store.write_upsert(spark, evolve(stored, SCHEMAS[table]).withColumn("seq", F.lit(0)), path, table)
    start_ingest(spark, fixtures.land_pages(spark, d, kind, landed), kind, path).awaitTermination()
    return read_table(spark, path, table)


@query("k1_stream_upsert")
def _(spark, d):
    prs = fixtures.raw(spark, d, "pull_requests").withColumn("title", F.concat(F.lit("old "), "title"))
    rows = _streamed(spark, d, "pull_request", "pull_requests", prs, "item.state = 'MERGED'")
    return rows.select("repo", "pr_id", "title", "state", "created_on", "updated_on")


@query("k1_stream_runs")
def _(spark, d):
    runs = fixtures.raw(spark, d, "pipelines").withColumn("result_name", F.lit("UNKNOWN"))
    rows = _streamed(spark, d, "pipeline", "pipelines", runs, "item.state.name = 'COMPLETED'")
    return rows.select("repo", "pipeline_uuid", "build_number", "state_name", "result_name")


@query("k1_stream_deployments")
def _(spark, d):
    stored = fixtures.raw(spark, d, "deployments").withColumn("status_name", F.lit("UNKNOWN"))
    rows = _streamed(spark, d, "deployment", "deployments", stored, "item.state.status.name = 'FAILED'")
    return rows.select("repo", "deployment_uuid", "pipeline_uuid", "environment_name", "status_name")


@query("k2_insert_absent")
def _(spark, d):
    statuses = fixtures.view(spark, d, "fx_pr_statuses")
    stored = status_links(statuses.where(F.col("url").contains("?")))
    return store.insert_absent(stored, status_links(statuses), ("repo", "pr_id", "pipeline_uuid"))


@query("k3_replace_repos")
def _(spark, d):
    activity = fixtures.raw(spark, d, "pr_activity")
    path = shared_dir(spark, "activity")
    store.write_replace(spark, activity, path, "pr_activity", _repos(activity))
    approvals = activity.where((F.col("activity_type") == "approval") & (F.col("repo") != "repo-3"))
    store.write_replace(spark, approvals, path, "pr_activity", REPLACED)
    rows = read_table(spark, path, "pr_activity")
    return rows.select("repo", "pr_id", "activity_type", "user_display_name", "approval_date")


@query("k3_stream_runs")
def _(spark, d):
    """Comments by runs over several batches: the second run ends for three repositories, one of them empty."""
    path, repos = shared_dir(spark, "stream-comments"), _repos(fixtures.raw(spark, d, "pull_requests"))
    pages = fixtures.land_pages(spark, d, "comment", run="1")
    fixtures.land_run_ends(spark, pages, "1", repos)
    deleted = "item.deleted and repo in ('repo-1', 'repo-2', 'repo-3')"
    fixtures.land_pages(spark, d, "comment", deleted, pages, "2")
    fixtures.land_run_ends(spark, pages, "2", ["repo-1", "repo-2", "repo-4"])
    start_ingest(spark, pages, "comment", path, files_per_batch=20, runs=True).awaitTermination()
    rows = read_table(spark, path, "pr_comments")
    return rows.select("repo", "pr_id", "comment_id", "content_raw", "parent_id")


@query("k4_pr_report_rebuild")
def _(spark, d):
    report = kept(fixtures.pr_report(spark, d), "pr-report-rows")  # both rebuilds write these rows: joined once
    path, repos = shared_dir(spark, "pr-report"), _repos(fixtures.raw(spark, d, "pull_requests"))
    write_pr_report(spark, report, path, repos)
    write_pr_report(spark, report, path, repos)
    return read_pr_report(spark, path).select(*SCHEMAS["pr_report"].names)


@query("k4_ci_report_rebuild")
def _(spark, d):
    report = fixtures.pipeline_report(spark, d)
    path = shared_dir(spark, "run-report")
    write_pipeline_report(spark, report, path, _repos(fixtures.raw(spark, d, "pipelines")))
    return read_pipeline_report(spark, path).select(*SCHEMAS["pipeline_report"].names)


@query("k5_evolve_schema")
def _(spark, d):
    old = fixtures.pr_report(spark, d).drop(*ADDED_LATER["pr_report"])
    return evolve(old, SCHEMAS["pr_report"])


@query("k6_csv_export")
def _(spark, d):
    rows = spark.read.option("header", True).option("escape", '"').csv(_exported(spark, d))
    return rows.select("ID", "SrcRepo", "Title", "Author", "Updated", "Total", "Type", "repo")


# --- JSON to raw rows ------------------------------------------------------------------------


def _landed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Records decoded from JSON text with the id of the page they came on."""
    texts = fixtures.raw_json(spark, d, kind)
    rows = decode_raw(texts, RECORDS[kind])
    if "pr_id" in rows.columns:
        rows = rows.withColumnRenamed("pr_id", "pull_request_id")
    return rows


@query("p1_pull_requests")
def _(spark, d):
    return flatten(_landed(spark, d, "pull_request"), "pull_request")


@query("p2_commits")
def _(spark, d):
    return flatten(_landed(spark, d, "commit"), "commit")


@query("p3_activity")
def _(spark, d):
    return flatten(_landed(spark, d, "activity"), "activity")


@query("p4_diffstat")
def _(spark, d):
    return flatten(_landed(spark, d, "diffstat"), "diffstat")


@query("p5_comments")
def _(spark, d):
    rows = flatten(_landed(spark, d, "comment"), "comment")
    return rows.withColumn("deleted", F.col("deleted").cast("int"))


@query("p6_statuses")
def _(spark, d):
    return flatten(_landed(spark, d, "status"), "status")


@query("p7_runs")
def _(spark, d):
    return flatten(_landed(spark, d, "pipeline"), "pipeline")


@query("p8_deployments")
def _(spark, d):
    return flatten(_landed(spark, d, "deployment"), "deployment")


@query("p9_stamp_parent")
def _(spark, d):
    rows = projections.stamp_activity_parent(_landed(spark, d, "activity"))
    return rows.select(
        "repo",
        "pr_id",
        F.col("pull_request.id").isNull().cast("int").alias("stamped"),
        projections.activity_kind().alias("kind"),
    )


@query("p10_pr_rows")
def _(spark, d):
    return pr_rows(dedup_prs(fixtures.pr_report(spark, d)))


@query("p11_pr_display")
def _(spark, d):
    rows = pr_table_rows(fixtures.pr_report(spark, d), keys=("repo", "pr_id"))
    long_title = F.concat_ws(" / ", "title", "src_branch", "dest_repo", "state", "author")
    return pr_display(rows.withColumn("title", long_title))


@query("p11_ci_display")
def _(spark, d):
    rows = pipeline_table_rows(fixtures.pipeline_report(spark, d))
    return pipeline_display(rows)


# --- filters ---------------------------------------------------------------------------------

_PR_SLIM = ("repo", "pr_id", "author", "updated", "activity_type", "activity_user")
_RUN_SLIM = ("pipeline_uuid", "repo", "creator", "created_on", "environment_name", "result_name")


@query("f1_created_between")
def _(spark, d):
    rows = fixtures.raw(spark, d, "pull_requests")
    extra = "state = 'MERGED' OR state = 'OPEN'"
    inside = created_between("created_on", dt.date(1995, 1, 1), dt.date(1996, 6, 30), extra)
    return rows.where(inside & in_known_states()).select("repo", "pr_id", "state", "created_on")


@query("f2_ts_between")
def _(spark, d):
    low, high = dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 15, 12)
    rows = fixtures.raw(spark, d, "pipelines")
    rows = rows.where(ts_between(parse_time("created_on"), low, high))
    return rows.select("repo", "pipeline_uuid", "created_on")


@query("f3_pr_filter")
def _(spark, d):
    return pr_filter(fixtures.pr_report(spark, d), PR_PARAMS, BOTS).select(*_PR_SLIM)


@query("f4_run_filter")
def _(spark, d):
    return pipeline_filter(fixtures.pipeline_report(spark, d), RUN_PARAMS, BOTS).select(*_RUN_SLIM)


@query("f5_author_filter")
def _(spark, d):
    return author_filter(fixtures.pr_report(spark, d), PR_PARAMS).select(*_PR_SLIM)


@query("f6_reviewer_filter")
def _(spark, d):
    return reviewer_filter(fixtures.pr_report(spark, d), PR_PARAMS, BOTS).select(*_PR_SLIM)


@query("f7_creator_filter")
def _(spark, d):
    return creator_filter(fixtures.pipeline_report(spark, d), RUN_PARAMS, BOTS).select(*_RUN_SLIM)


@query("f8_environment_filter")
def _(spark, d):
    rows = fixtures.raw(spark, d, "deployments")
    rows = rows.where(env_matches("environment_name", ["PRODUCTION"]))
    return rows.select("repo", "deployment_uuid", "environment_name")


@query("f9_production_runs")
def _(spark, d):
    rows = fixtures.pipeline_report(spark, d).where(production_predicate(REFS))
    return rows.select(*_RUN_SLIM, "target_ref_name")


@query("f10_production_table")
def _(spark, d):
    params = PipelineParams(targets=("develop",), production_refs=REFS)
    rows = pipeline_table_rows(fixtures.pipeline_report(spark, d), params.production_deployments())
    return rows.select(*_RUN_SLIM, "target_ref_name")


@query("f11_csv_filter")
def _(spark, d):
    rows = notebook_filter(
        parse_csv(export_frame(fixtures.pr_report(spark, d))),
        ["ws/repo-1", "ws/repo-2", "ws/repo-5"],
        dt.date(1995, 10, 1),
        dt.date(1996, 12, 31),
    )
    return rows.select(
        "ID", "SrcRepo", "Author", F.date_format("Updated", "yyyy-MM-dd").alias("Updated"), "Type"
    )


@query("f12_list_parameters")
def _(spark, d):
    params = PRParams.from_dict({"repos": ["", "  ", "repo-3"], "authors": [" "]})
    return pr_filter(fixtures.pr_report(spark, d), params).select(*_PR_SLIM)


@query("f13_date_parameters")
def _(spark, d):
    low, high = parse_range("not a day", "2024-03-15")
    rows = fixtures.raw(spark, d, "pipelines")
    rows = rows.where(ts_between(parse_time("created_on"), low, high))
    return rows.select("repo", "pipeline_uuid", "created_on")


@query("f14_lookback")
def _(spark, d):
    since = lookback_start("monthly", dt.date(1998, 3, 17))
    rows = fixtures.raw(spark, d, "pull_requests").where(created_between("created_on", since))
    return rows.select("repo", "pr_id", "created_on")


# --- joins -----------------------------------------------------------------------------------


def _slim_prs(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.raw(spark, d, "pull_requests").select(
        "repo", "pr_id", "title", F.col("author_display_name").alias("author")
    )


@query("j1_pr_activity")
def _(spark, d):
    events = report_activity(fixtures.raw(spark, d, "pr_activity"))
    return join_pr_activity(_slim_prs(spark, d), events)


@query("j1_pr_activity_salted")
def _(spark, d):
    events = report_activity(fixtures.raw(spark, d, "pr_activity"))
    return join_pieces(events, _slim_prs(spark, d), PR_KEY, 4)


@query("j2_diff_totals")
def _(spark, d):
    return join_diff_totals(_slim_prs(spark, d), fixtures.raw(spark, d, "pr_diffstat"))


@query("j3_first_link")
def _(spark, d):
    return join_first_link(_slim_prs(spark, d), fixtures.raw(spark, d, "pr_pipelines"))


@query("j4_link_deployment")
def _(spark, d):
    return join_link_deployment(
        fixtures.raw(spark, d, "pr_pipelines"), fixtures.raw(spark, d, "deployments")
    )


@query("j5_run_deployments")
def _(spark, d):
    runs = fixtures.raw(spark, d, "pipelines").select("repo", "pipeline_uuid", "result_name")
    return join_deployments(runs, fixtures.raw(spark, d, "deployments"))


@query("j5_run_deployments_salted")
def _(spark, d):
    runs = fixtures.raw(spark, d, "pipelines").select("repo", "pipeline_uuid", "result_name")
    deployments = fixtures.raw(spark, d, "deployments").select(*RUN_KEY, "environment_name")
    both = join_pieces(deployments, runs, RUN_KEY, 4)
    rows = with_unmatched(both, deployments, runs, RUN_KEY)
    return rows.fillna("", ["environment_name"])


@query("j6_new_keys")
def _(spark, d):
    runs, deployments = fixtures.raw(spark, d, "pipelines"), fixtures.raw(spark, d, "deployments")
    return new_keys(runs, deployments, ["repo", "pipeline_uuid"])


@query("j7_status_links")
def _(spark, d):
    statuses = fixtures.view(spark, d, "fx_pr_statuses")
    return pipelines_to_resolve(statuses, fixtures.raw(spark, d, "pipelines"))


@query("j8_step_deployments")
def _(spark, d):
    deployments = fixtures.raw(spark, d, "deployments")
    rows = step_deployments(
        fixtures.raw(spark, d, "pipelines"),
        fixtures.view(spark, d, "fx_pipeline_steps"),
        deployments,
        deployments.where(F.col("status_name") == "FAILED"),
        ["staging"],
    )
    return rows.select("repo", "deployment_uuid", "pipeline_uuid", "environment_name")


# --- reports ---------------------------------------------------------------------------------


@query("r1_pr_report")
def _(spark, d):
    return fixtures.pr_report(spark, d)


@query("r2_ci_report")
def _(spark, d):
    return fixtures.pipeline_report(spark, d)


@query("r3_pr_chart_rows")
def _(spark, d):
    return pr_chart_rows(fixtures.pr_report(spark, d), PR_NAMES, BOTS)


@query("r3t_pr_table")
def _(spark, d):
    return pr_table(fixtures.pr_report(spark, d), PR_NAMES, BOTS, page=2, size=50).rows


@query("r4_ci_chart_rows")
def _(spark, d):
    return pipeline_chart_rows(fixtures.pipeline_report(spark, d), RUN_NAMES, BOTS)


@query("r4t_ci_table")
def _(spark, d):
    return pipeline_table(fixtures.pipeline_report(spark, d), RUN_REFS, BOTS, page=3, size=100).rows


@query("r4t_production_table")
def _(spark, d):
    report = fixtures.pipeline_report(spark, d)
    return deployments_table(report, RUN_REFS, BOTS, page=1, size=100).rows


# --- aggregations ----------------------------------------------------------------------------


@query("a1_diff_totals")
def _(spark, d):
    return diff_totals(fixtures.raw(spark, d, "pr_diffstat"))


@query("a2_pr_summary")
def _(spark, d):
    return aggregates.pr_summary(aggregates.roll_prs(_prs(spark, d)))


@query("a3_prs_by_author")
def _(spark, d):
    return aggregates.prs_by_author(_prs(spark, d))


@query("a4_changes_by_author")
def _(spark, d):
    return aggregates.changes_by_author(_prs(spark, d))


@query("a5_activity_by_user")
def _(spark, d):
    rows = reviewer_filter(fixtures.pr_report(spark, d), PR_NAMES, BOTS)
    return aggregates.activity_by_user(rows)


@query("a6_prs_by_month")
def _(spark, d):
    return aggregates.prs_by_month(_prs(spark, d))


@query("a7_changes_by_repo")
def _(spark, d):
    prs = dedup_prs(fixtures.pr_report(spark, d), ("repo", "pr_id"))
    return aggregates.changes_by_repo(aggregates.pr_measures(prs))


@query("a8_pr_meta")
def _(spark, d):
    return aggregates.pr_meta(fixtures.pr_report(spark, d), BOTS)


@query("a9_ci_summary")
def _(spark, d):
    return aggregates.pipeline_summary(aggregates.roll_runs(_runs(spark, d)))


@query("a10_runs_by_creator")
def _(spark, d):
    return aggregates.runs_by_creator(_runs(spark, d))


@query("a11_runs_by_month")
def _(spark, d):
    return aggregates.runs_by_month(_runs(spark, d))


@query("a12_results_by_repo")
def _(spark, d):
    return aggregates.results_by_repo(_runs(spark, d))


@query("a13_mean_duration_by_repo")
def _(spark, d):
    return aggregates.mean_duration_by_repo(_runs(spark, d))


@query("a14_deployment_frequency")
def _(spark, d):
    return aggregates.deployment_frequency(_runs(spark, d))


@query("a15_ci_meta")
def _(spark, d):
    return aggregates.pipeline_meta(fixtures.pipeline_report(spark, d), BOTS, REFS)


# --- pivot reports ---------------------------------------------------------------------------


def _csv_activity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the CSV export as the pivot reports read them."""
    return pivots.with_report_columns(parse_csv(export_frame(fixtures.pr_report(spark, d))))


def _csv_prs(spark: SparkSession, d: str) -> DataFrame:
    rows = parse_csv(export_frame(fixtures.pr_report(spark, d)))
    return pivots.with_report_columns(distinct_prs(rows))


@query("n1_total_by_repo")
def _(spark, d):
    return pivots.total_by(_csv_prs(spark, d), ["SrcRepo"])


@query("n1_total_by_author")
def _(spark, d):
    return pivots.total_by(_csv_prs(spark, d), ["Author"])


@query("n2_count_by_repo")
def _(spark, d):
    return pivots.count_by(_csv_prs(spark, d), ["SrcRepo"])


@query("n2_count_by_author")
def _(spark, d):
    return pivots.count_by(_csv_prs(spark, d), ["Author"])


@query("n3_month_repo_pivot")
def _(spark, d):
    return pivots.total_pivot(_csv_prs(spark, d)).fillna(0)


@query("n4_mean_total")
def _(spark, d):
    return pivots.mean_total(_csv_prs(spark, d))


@query("n5_activity_by_repo")
def _(spark, d):
    return pivots.activity_pivot(_csv_activity(spark, d), "SrcRepo")


@query("n6_activity_by_user")
def _(spark, d):
    return pivots.activity_pivot(_csv_activity(spark, d), "User")


@query("n7_cross_activity_by_repo")
def _(spark, d):
    return pivots.activity_pivot(_csv_activity(spark, d), "SrcRepo", drop_self=True)


@query("n7_cross_activity_by_user")
def _(spark, d):
    return pivots.activity_pivot(_csv_activity(spark, d), "User", drop_self=True)


@query("n8_share_of_total")
def _(spark, d):
    return pivots.share_of_total(pivots.total_by(_csv_prs(spark, d), ["Author"]), "total")


# --- dedup -----------------------------------------------------------------------------------


@query("d1_dedup_prs")
def _(spark, d):
    return dedup_prs(pr_filter(fixtures.pr_report(spark, d), PR_NAMES, BOTS))


@query("d2_dedup_runs")
def _(spark, d):
    return dedup_pipelines(fixtures.pipeline_report(spark, d))


@query("d3_distinct_prs")
def _(spark, d):
    rows = distinct_prs(parse_csv(export_frame(fixtures.pr_report(spark, d))))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("Created", "Updated")})


# --- orders, limits, pages -------------------------------------------------------------------


@query("o1_by_value")
def _(spark, d):
    return _ranked(ordering.order_by_value(aggregates.prs_by_author(_prs(spark, d))))


@query("o2_by_label")
def _(spark, d):
    return _ranked(ordering.order_by_label(aggregates.runs_by_month(_runs(spark, d))))


@query("o3_by_total")
def _(spark, d):
    return _ranked(ordering.order_by_total(aggregates.changes_by_repo(_prs(spark, d))))


@query("o4_by_activity")
def _(spark, d):
    return _ranked(pr_charts(fixtures.pr_report(spark, d), bots=BOTS)["activity_by_user"])


@query("o5_by_results")
def _(spark, d):
    return _ranked(ordering.order_by_results(aggregates.results_by_repo(_runs(spark, d))))


@query("o6_by_month_and_ref")
def _(spark, d):
    return _ranked(pipeline_charts(fixtures.pipeline_report(spark, d), RUN_REFS)["deployment_frequency"])


@query("o7_page")
def _(spark, d):
    return pr_table(fixtures.pr_report(spark, d), page=0, size=500).rows


@query("o7_deep_page")
def _(spark, d):
    report = fixtures.pr_report(spark, d)
    return pr_table(report, page=5, size=200, keys=("repo", "pr_id"), deep=True).rows


@query("o7_page_total")
def _(spark, d):
    return pr_table(fixtures.pr_report(spark, d), PR_PARAMS, BOTS).total


@query("o8_page_count")
def _(spark, d):
    page = pipeline_table(fixtures.pipeline_report(spark, d), RUN_PARAMS, BOTS)
    return page.total.select("total", page_count("total", page.size).alias("pages"))


@query("o9_top_creators")
def _(spark, d):
    charts = pipeline_charts(fixtures.pipeline_report(spark, d))
    return ordering.top(charts["pipelines_by_creator"], ordering.TOP_CREATORS)


@query("o9_top_durations")
def _(spark, d):
    charts = pipeline_charts(fixtures.pipeline_report(spark, d))
    return ordering.top(charts["avg_duration_by_repo"], ordering.TOP_DURATIONS)


@query("o9_preview")
def _(spark, d):
    rows = _csv_activity(spark, d)
    order = ["ID", "SrcRepo", "Type", "User"]
    return ordering.preview(rows, order).select(*order, "Author", "DateGroup", "Total")


# --- unions and dense grids ------------------------------------------------------------------


@query("u1_concat")
def _(spark, d):
    report = export_frame(fixtures.pr_report(spark, d))
    approvals = report.where(F.col("Type") == "approval").drop("Description")
    comments = report.where(F.col("Type") != "approval").select(*reversed(report.columns))
    rows = pivots.concat_frames(comments, approvals)
    return rows.select("ID", "repo", "Type", F.coalesce("Description", F.lit("-")).alias("note"))


@query("u2_people")
def _(spark, d):
    return aggregates.author_user_options(aggregates.pr_meta(fixtures.pr_report(spark, d), BOTS))


@query("u3_dense_frequency")
def _(spark, d):
    frequency = aggregates.deployment_frequency(_runs(spark, d))
    return aggregates.dense_frequency(frequency, (*REFS, "never-used"))


# --- expressions -----------------------------------------------------------------------------


@query("c1_short_repo")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pull_requests")
    return rows.select(
        "repo",
        "pr_id",
        short_repo("src_repo").alias("two_parts"),
        short_repo("repo").alias("one_part"),
        short_repo(F.concat("src_repo", F.lit("/"), F.col("state"))).alias("three_parts"),
    )


@query("c2_second_part")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pull_requests")
    nested = second_part(F.concat("src_repo", F.lit("/"), F.col("state")))
    return rows.select(
        "repo",
        "pr_id",
        second_part("src_repo").alias("two_parts"),
        F.coalesce(second_part("repo"), F.lit("(none)")).alias("one_part"),
        nested.alias("three_parts"),
    )


@query("c3_day_text")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pull_requests")
    full = F.when(
        F.col("state") != "DECLINED", F.concat("created_on", F.lit("T23:59:59.9-11:00"))
    )
    return rows.select("repo", "pr_id", day_text(full).alias("day"))


@query("c4_seconds_text")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pipelines")
    exact = F.regexp_replace("created_on", "Z$", ".000123+00:00")
    local = F.regexp_replace("created_on", "Z$", ".5+05:30")
    return rows.select(
        "pipeline_uuid",
        seconds_text(exact).alias("utc"),
        seconds_text(local).alias("local"),
        seconds_text(F.nullif("completed_on", F.lit("")), missing="").alias("completed"),
    )


@query("c5_month_text")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pipelines").select(month_text("created_on").alias("month"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("c6_duration")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pipelines")
    seconds = duration_seconds("created_on", "completed_on", "build_seconds_used")
    return rows.select("pipeline_uuid", seconds.alias("duration_seconds"))


@query("c7_trigger_name")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pipelines")
    return rows.select("pipeline_uuid", trigger_name("trigger_type").alias("trigger_name"))


@query("c8_url_uuid")
def _(spark, d):
    rows = fixtures.view(spark, d, "fx_pr_statuses")
    return rows.select("repo", "pr_id", pipeline_uuid_from_url("url").alias("pipeline_uuid"))


@query("c9_diff_line_counts")
def _(spark, d):
    return diff_line_counts(fixtures.view(spark, d, "fx_pr_diffs"))


@query("c10_time_or_null")
def _(spark, d):
    rows = decode_raw(fixtures.raw_json(spark, d, "pipeline"), RECORDS["pipeline"])
    none = F.lit("(none)")
    return rows.select(
        F.col("uuid").alias("pipeline_uuid"),
        F.coalesce(time_or_null("expired"), none).alias("expired"),
        F.coalesce(time_or_null("completed_on"), none).alias("completed_on"),
    )


@query("c11_activity_kind")
def _(spark, d):
    rows = _landed(spark, d, "activity").select("repo", projections.activity_kind().alias("kind"))
    return rows.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))
