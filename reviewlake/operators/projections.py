"""Nested records to flat raw-table rows. Missing fields become zero values on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import trigger_name
from reviewlake.functions.times import day_text, seconds_text
from reviewlake.schemas import RECORD_TEXT, RECORDS, conform

KIND_APPROVAL = "approval"
KIND_UPDATE = "update"

#: Landed record kind -> raw table.
TABLE_OF = {
    "pull_request": "pull_requests",
    "commit": "pr_commits",
    "activity": "pr_activity",
    "diffstat": "pr_diffstat",
    "comment": "pr_comments",
    "status": "pr_statuses",
    "pipeline": "pipelines",
    "deployment": "deployments",
}


def _flat(df: DataFrame, record: str, *columns: Column | str) -> DataFrame:
    """The raw table's columns plus the record itself as JSON text: as it was landed, or made from the
    declared fields where the input has no text. An ingest's ``seq`` and ``run`` ride along where the input has them."""
    declared = F.to_json(F.struct(*(F.col(n) for n in RECORDS[record].names)))
    raw = (F.col(RECORD_TEXT) if RECORD_TEXT in df.columns else declared).alias("raw_json")
    ingest = [c for c in ("seq", "run") if c in df.columns]
    rows = df.select(*columns, raw, *ingest)
    return conform(rows, TABLE_OF[record], keep=ingest)


def _people(col: str) -> Column:
    """Reviewer or participant list as JSON text with zero values spelled out."""
    fields = RECORDS["pull_request"][col].dataType.elementType.names

    def filled(p: Column) -> Column:
        zero = lambda n: F.lit(False) if n == "approved" else F.lit("")
        return F.struct(*(F.coalesce(p[n], zero(n)).alias(n) for n in fields))

    return F.coalesce(F.to_json(F.transform(col, filled)), F.lit("null"))


def stamp_parent(df: DataFrame, parent: Column | str = "pull_request_id") -> DataFrame:
    """Children without an own pull-request id get the id of the page they came on."""
    return df.withColumn("pr_id", F.col(parent) if isinstance(parent, str) else parent)


def stamp_activity_parent(df: DataFrame, parent: Column | str = "pull_request_id") -> DataFrame:
    """Activity keeps the id it names and takes the parent's only where it names none."""
    own = F.coalesce(F.col("pull_request.id"), F.lit(0))
    parent = F.col(parent) if isinstance(parent, str) else parent
    return df.withColumn("pr_id", F.when(own == 0, parent).otherwise(own))


def pull_requests(df: DataFrame) -> DataFrame:
    return _flat(
        df,
        "pull_request",
        F.col("id").alias("pr_id"),
        "repo",
        "type",
        "title",
        "description",
        "state",
        "comment_count",
        "task_count",
        F.col("author.display_name").alias("author_display_name"),
        F.col("author.uuid").alias("author_uuid"),
        F.col("author.account_id").alias("author_account_id"),
        F.col("author.nickname").alias("author_nickname"),
        F.col("source.repository.full_name").alias("src_repo"),
        F.col("source.branch.name").alias("src_branch"),
        F.col("destination.repository.full_name").alias("dest_repo"),
        F.col("destination.branch.name").alias("dest_branch"),
        day_text("created_on").alias("created_on"),
        day_text("updated_on").alias("updated_on"),
        _people("reviewers").alias("reviewers"),
        _people("participants").alias("participants"),
    )


def pr_commits(df: DataFrame) -> DataFrame:
    return _flat(
        df,
        "commit",
        "pr_id",
        "repo",
        "hash",
        "message",
        seconds_text("date", missing="").alias("date"),
        F.col("author.user.display_name").alias("author_display_name"),
        F.col("author.user.uuid").alias("author_uuid"),
        F.col("author.user.account_id").alias("author_account_id"),
    )


def activity_kind() -> Column:
    """``comment``, ``approval`` or ``update``: the first whose user is named."""
    return (
        F.when(F.coalesce("comment.user.display_name", F.lit("")) != "", "comment")
        .when(F.coalesce("approval.user.display_name", F.lit("")) != "", KIND_APPROVAL)
        .otherwise(KIND_UPDATE)
    )


def pr_activity(df: DataFrame) -> DataFrame:
    df = df.withColumn("_kind", activity_kind())
    is_comment = F.col("_kind") == "comment"
    is_approval = F.col("_kind") == KIND_APPROVAL

    def actor(field: str) -> Column:
        return (
            F.when(is_comment, F.col(f"comment.user.{field}"))
            .when(is_approval, F.col(f"approval.user.{field}"))
            .otherwise(F.col(f"update.author.{field}"))
        )

    return _flat(
        df,
        "activity",
        "pr_id",
        "repo",
        F.when(is_comment, F.col("comment.type")).otherwise(F.col("_kind")).alias("activity_type"),
        actor("display_name").alias("user_display_name"),
        actor("uuid").alias("user_uuid"),
        actor("account_id").alias("user_account_id"),
        F.when(is_comment, F.col("comment.id")).alias("comment_id"),
        F.when(is_comment, F.col("comment.content.raw")).alias("comment_content_raw"),
        F.when(is_comment, seconds_text("comment.created_on")).alias("comment_created_on"),
        F.when(is_comment, seconds_text("comment.updated_on")).alias("comment_updated_on"),
        F.when(is_approval, seconds_text("approval.date")).alias("approval_date"),
    )


def pr_diffstat(df: DataFrame) -> DataFrame:
    return _flat(
        df,
        "diffstat",
        "pr_id",
        "repo",
        F.col("type").alias("file_type"),
        "lines_added",
        "lines_removed",
        "status",
        F.col("old.path").alias("old_path"),
        F.col("new.path").alias("new_path"),
    )


def pr_comments(df: DataFrame) -> DataFrame:
    return _flat(
        df,
        "comment",
        "pr_id",
        "repo",
        F.col("id").alias("comment_id"),
        F.col("content.raw").alias("content_raw"),
        F.col("inline.path").alias("inline_path"),
        F.col("inline.from").alias("inline_from"),
        F.col("inline.to").alias("inline_to"),
        F.col("parent.id").alias("parent_id"),
        F.col("user.display_name").alias("user_display_name"),
        F.col("user.uuid").alias("user_uuid"),
        "deleted",
        seconds_text("created_on").alias("created_on"),
        seconds_text("updated_on").alias("updated_on"),
    )


def pr_statuses(df: DataFrame) -> DataFrame:
    return _flat(
        df,
        "status",
        "pr_id",
        "repo",
        "key",
        "name",
        "state",
        "url",
        "description",
        seconds_text("created_on").alias("created_on"),
        seconds_text("updated_on").alias("updated_on"),
    )


def pipelines(df: DataFrame) -> DataFrame:
    return _flat(
        df,
        "pipeline",
        F.col("uuid").alias("pipeline_uuid"),
        "repo",
        "build_number",
        "run_number",
        F.col("creator.display_name").alias("creator_name"),
        F.col("creator.uuid").alias("creator_uuid"),
        F.col("creator.account_id").alias("creator_account_id"),
        F.col("target.ref_type").alias("target_ref_type"),
        F.col("target.ref_name").alias("target_ref_name"),
        trigger_name("trigger.type").alias("trigger_name"),
        F.col("state.name").alias("state_name"),
        F.col("state.result.name").alias("result_name"),
        seconds_text("created_on").alias("created_on"),
        seconds_text("completed_on", missing="").alias("completed_on"),
        "build_seconds_used",
    )


def deployments(df: DataFrame) -> DataFrame:
    return _flat(
        df,
        "deployment",
        F.col("uuid").alias("deployment_uuid"),
        "repo",
        F.col("pipeline.uuid").alias("pipeline_uuid"),
        F.col("environment.uuid").alias("environment_uuid"),
        F.col("environment.name").alias("environment_name"),
        F.col("state.name").alias("state_name"),
        F.col("state.status.name").alias("status_name"),
        F.col("release.name").alias("release_name"),
        seconds_text("created_on").alias("created_on"),
        seconds_text("state.completed_on", missing="").alias("completed_on"),
    )


#: Landed record kind -> projection.
PROJECTIONS = {
    "pull_request": pull_requests,
    "commit": pr_commits,
    "activity": pr_activity,
    "diffstat": pr_diffstat,
    "comment": pr_comments,
    "status": pr_statuses,
    "pipeline": pipelines,
    "deployment": deployments,
}
