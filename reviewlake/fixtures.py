"""Code-review and CI data derived from the star-schema test tables.

``VIEWS`` is portable SQL: Spark reads it as the input of the jobs, and the check queries read
the same text on their side.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.text import trigger_name
from reviewlake.operators.joins import status_links
from reviewlake.operators.projections import KIND_APPROVAL, KIND_UPDATE
from reviewlake.plans.reports import build_pipeline_report, build_pr_report
from reviewlake.schemas import SCHEMAS, evolve
from reviewlake.session import shared_dir

#: Columns of the test tables the views read. Stating them saves a look into the files.
SOURCES = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "documents": "doc_id long, text string, source string",
}

#: Spark's setting for aggregates that collect lists.
HASHED_LISTS = "spark.sql.execution.useObjectHashAggregateExec"

VIEWS: dict[str, str] = {}

VIEWS["fx_pull_requests"] = """
SELECT CAST(FLOOR(o_orderkey / 25) AS BIGINT) AS pr_id,
       'repo-' || CAST(o_orderkey % 25 AS STRING) AS repo,
       'ws/repo-' || CAST(o_orderkey % 25 AS STRING) AS src_repo,
       'feature/' || CAST(o_orderkey AS STRING) AS src_branch,
       'ws/repo-' || CAST(o_orderkey % 25 AS STRING) AS dest_repo,
       'main' AS dest_branch,
       'PR ' || CAST(o_orderkey AS STRING) AS title,
       o_orderpriority AS description,
       CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'OPEN' ELSE 'DECLINED' END AS state,
       'user-' || CAST(o_custkey % 40 AS STRING) AS author,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_on,
       CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS STRING) AS updated_on
FROM orders"""

VIEWS["fx_pr_activity"] = """
SELECT CAST(FLOOR(l_orderkey / 25) AS BIGINT) AS pr_id,
       'repo-' || CAST(l_orderkey % 25 AS STRING) AS repo,
       CASE l_returnflag WHEN 'A' THEN 'approval' WHEN 'N' THEN 'pullrequest_comment'
            ELSE 'update' END AS activity_type,
       'user-' || CAST(l_suppkey % 40 AS STRING) AS activity_user,
       CASE l_returnflag WHEN 'A' THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
            ELSE 'note ' || CAST(l_partkey AS STRING) END AS activity_content
FROM lineitem"""

VIEWS["fx_pr_diffstat"] = """
SELECT CAST(FLOOR(l_orderkey / 25) AS BIGINT) AS pr_id,
       'repo-' || CAST(l_orderkey % 25 AS STRING) AS repo,
       CAST(FLOOR(l_quantity) AS INT) AS lines_added,
       CAST(l_linenumber AS INT) AS lines_removed
FROM lineitem"""

VIEWS["fx_pr_statuses"] = """
SELECT CAST(FLOOR(l_orderkey / 25) AS BIGINT) AS pr_id,
       'repo-' || CAST(l_orderkey % 25 AS STRING) AS repo,
       CASE WHEN l_returnflag = 'R' THEN 'https://ci.example/none'
            ELSE 'https://ci.example/ws/r/pipelines/results/{'
                 || CAST(l_partkey * 25 + l_orderkey % 25 AS STRING) || '}'
                 || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '?a=1' ELSE '#s' END
            END AS url
FROM lineitem"""

VIEWS["fx_pr_commits"] = """
SELECT CAST(FLOOR(l_orderkey / 25) AS BIGINT) AS pr_id,
       'repo-' || CAST(l_orderkey % 25 AS STRING) AS repo,
       'h' || CAST(l_orderkey AS STRING) || '-' || CAST(l_partkey AS STRING) AS hash,
       'commit ' || CAST(l_linenumber AS STRING) AS message,
       CASE WHEN l_linestatus = 'F' THEN ''
            ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) || 'T08:30:00Z' END AS date,
       'user-' || CAST(l_suppkey % 40 AS STRING) AS author
FROM lineitem"""

VIEWS["fx_pr_comments"] = """
SELECT CAST(FLOOR(l_orderkey / 25) AS BIGINT) AS pr_id,
       'repo-' || CAST(l_orderkey % 25 AS STRING) AS repo,
       CAST(l_partkey AS INT) AS comment_id,
       'note ' || CAST(l_suppkey AS STRING) AS content,
       CASE WHEN l_returnflag = 'R' THEN '' ELSE 'src/f' || CAST(l_suppkey AS STRING) END AS path,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END AS line_from,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber + 2 END AS line_to,
       CASE WHEN l_returnflag = 'A' THEN CAST(l_suppkey AS INT) ELSE 0 END AS parent_id,
       'user-' || CAST(l_suppkey % 40 AS STRING) AS comment_user,
       l_linestatus = 'F' AS deleted,
       CAST(CAST(l_shipdate AS DATE) AS STRING) AS created_day
FROM lineitem"""

VIEWS["fx_pipelines"] = """
SELECT '{' || CAST(event_id AS STRING) || '}' AS pipeline_uuid,
       'repo-' || CAST(event_id % 25 AS STRING) AS repo,
       CAST(event_id AS INT) AS build_number,
       CAST(event_id AS INT) AS run_number,
       CASE WHEN user_id % 40 = 0 THEN ''
            ELSE 'user-' || CAST(user_id % 40 AS STRING) END AS creator,
       'branch' AS target_ref_type,
       CASE event_id % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'master' WHEN 2 THEN 'develop'
            ELSE 'release/1.0' END AS target_ref_name,
       CASE event_id % 3 WHEN 0 THEN 'pipeline_trigger_push' WHEN 1 THEN 'pipeline_trigger_manual'
            ELSE '' END AS trigger_type,
       CASE WHEN event_id % 5 = 0 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS state_name,
       CASE event_type WHEN 'purchase' THEN 'SUCCESSFUL' WHEN 'view' THEN 'SUCCESSFUL'
            WHEN 'click' THEN 'FAILED' WHEN 'error' THEN 'ERROR' ELSE 'STOPPED' END AS result_name,
       CAST(CAST(ts AS DATE) + CAST((user_id % 6) * 30 AS INT) AS STRING) || 'T'
            || SUBSTRING(CAST(ts AS STRING), 12, 8) || 'Z' AS created_on,
       CASE WHEN event_id % 5 = 0 THEN '' ELSE
         CAST(CAST(te AS DATE) + CAST((user_id % 6) * 30 AS INT) AS STRING) || 'T'
            || SUBSTRING(CAST(te AS STRING), 12, 8) || 'Z' END AS completed_on,
       CAST(FLOOR(value) AS INT) AS build_seconds_used
FROM (SELECT *, CASE event_id % 5 WHEN 1 THEN ts + INTERVAL '1' MINUTE
                     WHEN 2 THEN ts + INTERVAL '7' MINUTE
                     WHEN 3 THEN ts - INTERVAL '1' MINUTE
                     ELSE ts + INTERVAL '90' SECOND END AS te FROM events) e"""

VIEWS["fx_deployments"] = """
SELECT '{s-' || CAST(event_id AS STRING) || '}' AS deployment_uuid,
       'repo-' || CAST(event_id % 25 AS STRING) AS repo,
       '{' || CAST(event_id AS STRING) || '}' AS pipeline_uuid, '{env-s}' AS environment_uuid,
       'Staging' AS environment_name, 'COMPLETED' AS state_name, 'SUCCESSFUL' AS status_name,
       CAST(CAST(ts AS DATE) AS STRING) AS created_on
FROM events WHERE event_type IN ('purchase', 'view')
UNION ALL
SELECT '{p-' || CAST(event_id AS STRING) || '}', 'repo-' || CAST(event_id % 25 AS STRING),
       '{' || CAST(event_id AS STRING) || '}', '{env-p}', 'Production',
       'COMPLETED', CASE WHEN event_id % 7 = 0 THEN 'FAILED' ELSE 'SUCCESSFUL' END,
       CAST(CAST(ts AS DATE) AS STRING)
FROM events WHERE event_type = 'purchase'"""

VIEWS["fx_pipeline_steps"] = """
SELECT 'repo-' || CAST(event_id % 25 AS STRING) AS repo,
       '{' || CAST(event_id AS STRING) || '}' AS pipeline_uuid,
       CASE WHEN event_type IN ('purchase', 'view')
            THEN '{s-' || CAST(event_id AS STRING) || '}' ELSE '' END AS deployment_uuid
FROM events
UNION ALL
SELECT 'repo-' || CAST(event_id % 25 AS STRING), '{' || CAST(event_id AS STRING) || '}',
       '{p-' || CAST(event_id AS STRING) || '}'
FROM events WHERE event_type = 'purchase'"""

VIEWS["fx_pr_diffs"] = """
SELECT doc_id AS pr_id, source AS repo,
       REPLACE(REPLACE(text, CHR(10), CHR(10) || '-'), '. ', '.' || CHR(10) || '+') AS diff
FROM documents"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in ``sf_dir``."""
    sql = VIEWS[name]
    for table, columns in SOURCES.items():
        if re.search(rf"FROM {table}\b", sql):
            rows = spark.read.schema(columns).parquet(f"{sf_dir}/{table}.parquet")
            rows.createOrReplaceTempView(table)
    return spark.sql(sql)


# --- raw tables ------------------------------------------------------------------------------


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A raw table in its declared schema."""
    if table == "pr_pipelines":
        return status_links(view(spark, sf_dir, "fx_pr_statuses"))
    df = view(spark, sf_dir, f"fx_{table}")
    if table == "pull_requests":
        df = df.withColumnRenamed("author", "author_display_name")
    elif table == "pr_activity":
        approval = F.col("activity_type") == KIND_APPROVAL
        comment = ~F.col("activity_type").isin(KIND_APPROVAL, KIND_UPDATE)
        time = F.concat("activity_content", F.lit("T09:00:00Z"))
        df = df.withColumnsRenamed({"activity_user": "user_display_name"}).withColumns(
            {
                "comment_content_raw": F.when(comment, F.col("activity_content")).otherwise(""),
                "approval_date": F.when(approval, time).otherwise(""),
            }
        )
    elif table == "pipelines":
        df = df.withColumnRenamed("creator", "creator_name").withColumn(
            "trigger_name", trigger_name("trigger_type")
        )
    return evolve(df, SCHEMAS[table])


def pr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_pr_report(
        *(
            raw(spark, sf_dir, t)
            for t in ("pull_requests", "pr_activity", "pr_diffstat", "pr_pipelines", "deployments")
        )
    )


def pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_pipeline_report(raw(spark, sf_dir, "pipelines"), raw(spark, sf_dir, "deployments"))


# --- landed JSON -----------------------------------------------------------------------------


def _s(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _person(col: str) -> Column:
    return _s(display_name=F.col(col), uuid=F.concat(F.lit("{"), F.col(col), F.lit("}")))


def _at(col: str, time: str) -> Column:
    return F.concat(F.col(col), F.lit(time))


def _end(prefix: str) -> Column:
    return _s(
        branch=_s(name=F.col(f"{prefix}_branch")),
        repository=_s(full_name=F.col(f"{prefix}_repo")),
    )


def _filled(col: str) -> Column:
    """The text, or an absent JSON field where it is empty."""
    return F.nullif(F.col(col), F.lit(""))


#: Landed record kind -> the view its rows come from.
RECORD_VIEWS = {
    "pull_request": "fx_pull_requests",
    "activity": "fx_pr_activity",
    "commit": "fx_pr_commits",
    "comment": "fx_pr_comments",
    "status": "fx_pr_statuses",
    "diffstat": "fx_pr_diffstat",
    "pipeline": "fx_pipelines",
    "deployment": "fx_deployments",
}


def _page_key(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """``df`` and its column that tells the pages of a repository apart: children lie on pages of their pull
    request, others by 50 ids, which are unique within a repository."""
    if kind not in ("pull_request", "pipeline", "deployment"):
        return df, "pr_id"
    number = F.col("pr_id")
    if "pipeline_uuid" in df.columns:
        number = F.regexp_extract("pipeline_uuid", r"\d+", 0).cast("long") / 25
    return df.withColumn("page", F.floor(number / 50)), "page"


def record(spark: SparkSession, sf_dir: str, kind: str, paged: bool = False) -> DataFrame:
    """``repo, pr_id (or key), item``: the nested record the flat fixture row came from.

    Times carry fractions and offsets, absent values are absent fields. With ``paged``, rows of a page lie in one
    task, in ranges of (repo, page): the flat row is moved, a fraction of its record's text.
    """
    df = view(spark, sf_dir, RECORD_VIEWS[kind])
    if paged:
        df, key = _page_key(df, kind)
        df = df.repartitionByRange("repo", key).sortWithinPartitions("repo", key)
    if kind == "pull_request":
        person = _s(
            display_name=F.col("author"), approved=F.col("state") == "MERGED", role=F.lit("AUTHOR")
        )
        item = _s(
            id=F.col("pr_id"),
            type=F.lit("pullrequest"),
            title=F.col("title"),
            description=F.col("description"),
            state=F.col("state"),
            comment_count=F.lit(2),
            author=_person("author"),
            reviewers=F.array(person),
            created_on=_at("created_on", "T23:30:00.123456-07:00"),
            updated_on=_at("updated_on", "T00:30:00.5+07:00"),
            source=_end("src"),
            destination=_end("dest"),
        )
    elif kind == "activity":
        kind_is = F.col("activity_type")
        approval = _s(
            date=_at("activity_content", "T09:00:00.000001+02:00"), user=_person("activity_user")
        )
        comment = _s(
            id=F.length("activity_content"),
            type=kind_is,
            created_on=F.lit("2024-01-02T03:04:05.999+00:00"),
            updated_on=F.lit("2024-01-02T03:04:06Z"),
            content=_s(raw=F.col("activity_content")),
            user=_person("activity_user"),
        )
        update = _s(author=_person("activity_user"), state=F.lit("OPEN"))
        item = _s(
            pull_request=F.when(kind_is != "approval", _s(id=F.col("pr_id"))),
            approval=F.when(kind_is == "approval", approval),
            comment=F.when(kind_is == "pullrequest_comment", comment),
            update=F.when(kind_is == "update", update),
        )
    elif kind == "commit":
        item = _s(
            hash=F.col("hash"),
            message=F.col("message"),
            date=F.regexp_replace(_filled("date"), "Z$", ".25+00:00"),
            author=_s(user=_person("author")),
        )
    elif kind == "comment":
        inline = _s(
            **{"from": F.col("line_from"), "to": F.col("line_to"), "path": F.col("path")}
        )
        item = _s(
            id=F.col("comment_id"),
            created_on=_at("created_day", "T01:02:03.5Z"),
            content=_s(raw=F.col("content")),
            inline=F.when(F.col("path") != "", inline),
            parent=F.when(F.col("parent_id") != 0, _s(id=F.col("parent_id"))),
            user=_person("comment_user"),
            deleted=F.when(F.col("deleted"), F.lit(True)),
        )
    elif kind == "status":
        item = _s(
            state=F.lit("SUCCESSFUL"),
            key=F.lit("build"),
            url=F.col("url"),
            created_on=F.lit("2024-01-02T03:04:05.999-03:00"),
        )
    elif kind == "diffstat":
        item = _s(
            type=F.lit("diffstat"),
            lines_added=F.col("lines_added"),
            lines_removed=F.col("lines_removed"),
            status=F.lit("modified"),
            new=_s(path=F.lit("src/a")),
        )
    elif kind == "pipeline":
        item = _s(
            uuid=F.col("pipeline_uuid"),
            build_number=F.col("build_number"),
            run_number=F.col("run_number"),
            creator=F.when(F.col("creator") != "", _person("creator")),
            target=_s(ref_type=F.col("target_ref_type"), ref_name=F.col("target_ref_name")),
            trigger=_s(type=_filled("trigger_type")),
            state=_s(name=F.col("state_name"), result=_s(name=F.col("result_name"))),
            created_on=F.regexp_replace("created_on", "Z$", ".75Z"),
            completed_on=F.regexp_replace(_filled("completed_on"), "Z$", ".25+00:00"),
            build_seconds_used=F.col("build_seconds_used"),
            expired=F.lit(False),
        )
    elif kind == "deployment":
        item = _s(
            uuid=F.col("deployment_uuid"),
            state=_s(name=F.col("state_name"), status=_s(name=F.col("status_name"))),
            pipeline=_s(uuid=F.col("pipeline_uuid")),
            environment=_s(uuid=F.col("environment_uuid"), name=F.col("environment_name")),
            created_on=_at("created_on", "T05:06:07.123Z"),
        )
    else:
        raise KeyError(kind)
    keys = [c for c in ("pr_id", "pipeline_uuid", "page") if c in df.columns]
    return df.select("repo", *keys, item.alias("item"))


def raw_json(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """``repo, (pr_id,) raw_json`` rows of one record kind."""
    rows = record(spark, sf_dir, kind)
    keys = [c for c in ("repo", "pr_id") if c in rows.columns]
    return rows.select(*keys, F.to_json("item").alias("raw_json"))


def paged_texts(rows: DataFrame, text: Column) -> DataFrame:
    """The ``records`` of every page as one text, from ``paged`` records: they are in place already."""
    key = "page" if "page" in rows.columns else "pr_id"
    return rows.groupBy("repo", key).agg(F.array_join(F.collect_list(text), ",").alias("records"))


def land_pages(
    spark: SparkSession,
    sf_dir: str,
    kind: str = "pull_request",
    where: str = "true",
    path: str | None = None,
    run: str | None = None,
    broken: str = "false",
) -> str:
    """Write records as page documents, one per line, in ``repo=`` folders; returns the path.

    Ids are unique within a repository, so a page holds at most 50 of them; children lie on pages of their pull
    request, which names it. ``where`` and ``broken`` are SQL: the records that land, and those whose id is no number.

    Files are ranges of pages, a repository in few of them, and compressed.
    """
    rows = record(spark, sf_dir, kind, paged=True).where(where)
    odd = F.regexp_replace(F.to_json("item"), r'"id":(\d+)', '"id":"no $1"')
    text = F.when(F.expr(broken), odd).otherwise(F.to_json("item"))
    pages = paged_texts(rows, text)
    parent = F.col("pr_id") if "pr_id" in pages.columns else F.lit(None).cast("long")
    head = F.to_json(_s(next=F.lit(""), run=F.lit(run), pull_request_id=parent))
    start = F.left(head, F.length(head) - 1)
    document = F.concat(start, F.lit(',"values":['), F.col("records"), F.lit("]}"))
    path = path or shared_dir(spark, "pages")
    files = pages.select(document.alias("value"), "repo").write.mode("append").partitionBy("repo")
    # rows come in the order of their pages: one page is held at a time, where a hash of pages keeps and sorts all texts
    by_hash = spark.conf.get(HASHED_LISTS)
    spark.conf.set(HASHED_LISTS, "false")
    try:
        files.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).text(path)
    finally:
        spark.conf.set(HASHED_LISTS, by_hash)
    return path


def land_run_ends(spark: SparkSession, path: str, run: str, repos: list[str]) -> None:
    """The pages that end a run of the given repositories."""
    page = json.dumps({"next": "", "run": run, "run_end": True, "values": []})
    ends = spark.createDataFrame([(page, repo) for repo in repos], "value string, repo string")
    ends.coalesce(1).write.mode("append").partitionBy("repo").text(path)
