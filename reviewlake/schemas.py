"""Declared table schemas and additive evolution.

Every table is one ``StructType``. Text columns default to ``''``, integers to ``0`` and
booleans to ``false``: a value missing from the source is a zero value, never NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ZERO_DAY = "0001-01-01"
ZERO_SECOND = "0001-01-01T00:00:00Z"


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _table(columns: str) -> T.StructType:
    """Schema from ``name`` (text) and ``name:type`` words."""
    fields = (word.partition(":") for word in columns.split())
    return T.StructType(
        [T.StructField(name, _TYPES[kind] if kind else T.StringType()) for name, _, kind in fields]
    )


def _struct(flat: str = "", **nested: T.DataType) -> T.StructType:
    """Flat columns as in ``_table`` plus nested fields."""
    schema = _table(flat)
    for name, data_type in nested.items():
        schema = schema.add(name, data_type)
    return schema


SCHEMAS: dict[str, T.StructType] = {
    "pull_requests": _table(
        "pr_id:long repo type title description state comment_count:int task_count:int "
        "author_display_name author_uuid author_account_id author_nickname src_repo "
        "src_branch dest_repo dest_branch created_on updated_on reviewers participants "
        "raw_json"
    ),
    "pr_commits": _table(
        "pr_id:long repo hash message date author_display_name author_uuid author_account_id "
        "raw_json"
    ),
    "pr_activity": _table(
        "pr_id:long repo activity_type user_display_name user_uuid user_account_id "
        "comment_id:int comment_content_raw comment_created_on comment_updated_on "
        "approval_date raw_json"
    ),
    "pr_diffstat": _table(
        "pr_id:long repo file_type lines_added:int lines_removed:int status old_path new_path "
        "raw_json"
    ),
    "pr_comments": _table(
        "pr_id:long repo comment_id:int content_raw inline_path inline_from:int inline_to:int "
        "parent_id:int user_display_name user_uuid deleted:boolean created_on updated_on "
        "raw_json"
    ),
    "pr_statuses": _table(
        "pr_id:long repo key name state url description created_on updated_on raw_json"
    ),
    "pipelines": _table(
        "pipeline_uuid repo build_number:int run_number:int creator_name creator_uuid "
        "creator_account_id target_ref_type target_ref_name trigger_name state_name "
        "result_name created_on completed_on build_seconds_used:int raw_json"
    ),
    "deployments": _table(
        "deployment_uuid repo pipeline_uuid environment_uuid environment_name state_name "
        "status_name release_name created_on completed_on raw_json"
    ),
    "pr_pipelines": _table("pr_id:long repo pipeline_uuid"),
    "pr_report": _table(
        "pr_id:long repo src_repo src_branch dest_repo dest_branch title description state "
        "author created updated file_changed:long added:long removed:long total:long "
        "activity_type activity_user activity_content pipeline_uuid environment_name "
        "deployment_state deployment_status"
    ),
    "pipeline_report": _table(
        "pipeline_uuid repo build_number:int run_number:int creator target_ref_type "
        "target_ref_name trigger_name state_name result_name environment_uuid "
        "environment_name deployment_state deployment_status created_on completed_on "
        "duration_seconds:long"
    ),
}

#: Columns older tables were written without.
ADDED_LATER: dict[str, tuple[str, ...]] = {
    "pr_report": ("pipeline_uuid", "environment_name", "deployment_state", "deployment_status"),
}

#: Upsert keys of the merged tables; the other raw tables are replaced per repository.
KEYS: dict[str, tuple[str, ...]] = {
    "pull_requests": ("repo", "pr_id"),
    "pipelines": ("repo", "pipeline_uuid"),
    "deployments": ("repo", "deployment_uuid"),
    "pr_pipelines": ("repo", "pr_id", "pipeline_uuid"),
}

#: Buckets by key that a new table's repositories are cut into; tables that are only replaced need one.
BUCKETS: dict[str, int] = {"pull_requests": 8, "pipelines": 8, "deployments": 8, "pr_pipelines": 8}

#: File order within a repository: the date the table is filtered on, or the parent's id.
SORTED_BY: dict[str, tuple[str, ...]] = {
    "pull_requests": ("created_on",),
    "pipelines": ("created_on",),
    "deployments": ("created_on",),
    "pr_report": ("updated",),
    "pipeline_report": ("created_on",),
    "pr_commits": ("pr_id",),
    "pr_activity": ("pr_id",),
    "pr_diffstat": ("pr_id",),
    "pr_comments": ("pr_id",),
    "pr_statuses": ("pr_id",),
    "pr_pipelines": ("pr_id",),
}

_NAME = _table("name")
_UUID = _table("uuid")
_PERSON = _table("display_name uuid account_id nickname")
_MEMBERS = T.ArrayType(
    _table("display_name uuid account_id nickname type approved:boolean state role")
)
_END = _struct(branch=_NAME, repository=_table("full_name"))

#: Shape of one landed JSON record. Times stay text: their own UTC offset decides the day.
#: Free-form fields stay JSON text.
RECORDS: dict[str, T.StructType] = {
    "pull_request": _struct(
        "id:long type title description state comment_count:int task_count:int "
        "merge_commit closed_by created_on updated_on",
        author=_PERSON,
        reviewers=_MEMBERS,
        participants=_MEMBERS,
        source=_END,
        destination=_END,
    ),
    "activity": _struct(
        pull_request=_table("id:long title"),
        approval=_struct("date", user=_PERSON),
        comment=_struct("id:int type created_on updated_on", content=_table("raw"), user=_PERSON),
        update=_struct("date state", author=_PERSON),
    ),
    "commit": _struct("hash message date", author=_struct(user=_PERSON)),
    "comment": _struct(
        "id:int created_on updated_on deleted:boolean",
        content=_table("raw"),
        inline=_table("from:int to:int path"),
        parent=_table("id:int"),
        user=_PERSON,
    ),
    "status": _table("state key name url description created_on updated_on"),
    "diffstat": _struct(
        "type lines_added:int lines_removed:int status", old=_table("path"), new=_table("path")
    ),
    "pipeline": _struct(
        "uuid build_number:int run_number:int created_on completed_on build_seconds_used:int "
        "first_successful expired",
        creator=_PERSON,
        target=_table("ref_type ref_name"),
        trigger=_table("type"),
        state=_struct("name", result=_NAME),
    ),
    "deployment": _struct(
        "uuid created_on",
        state=_struct("name completed_on", status=_NAME),
        pipeline=_UUID,
        environment=_table("uuid name"),
        release=_NAME,
    ),
    "step": _table("uuid name type deployment_uuid"),
}


#: Malformed JSON stops the job; read leniently, its records would vanish unnoticed.
JSON_OPTIONS = {"mode": "FAILFAST"}

PR_PARENT = "pull_request_id:long"
PIPELINE_PARENT = "pipeline_uuid"


#: A landed record as its JSON text, carried until it is stored as ``raw_json``.
RECORD_TEXT = "record_json"


def page_schema(parent: str = PR_PARENT) -> T.StructType:
    """Envelope of one landed page; its records stay text. Child pages carry their parent's id; the
    repository is a page field or the ``repo=`` folder the page lies in, ``run`` likewise. The last page of a
    repository's run has ``run_end``."""
    return _struct(f"repo next run run_end:boolean {parent}", values=T.ArrayType(T.StringType()))


def _zero(data_type: T.DataType) -> str:
    """The value a missing field of this type stands for, as SQL."""
    if isinstance(data_type, T.StringType):
        return "''"
    if isinstance(data_type, T.BooleanType):
        return "false"
    return f"cast(0 as {data_type.simpleString()})"


def _cast(field: T.StructField) -> str:
    return f"cast(`{field.name}` as {field.dataType.simpleString()})"


def conform(df: DataFrame, table: str, keep: Sequence[str] = ()) -> DataFrame:
    """Select the declared columns, in order, typed, with zero values for NULL (and ``keep``)."""
    columns = [
        f"coalesce({_cast(f)}, {_zero(f.dataType)}) as `{f.name}`" for f in SCHEMAS[table]
    ]
    return df.selectExpr(*columns, *keep)


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring an older frame to ``schema``: absent columns appear with their zero value."""
    have = set(df.columns)
    return df.selectExpr(
        *(f"{_cast(f) if f.name in have else _zero(f.dataType)} as `{f.name}`" for f in schema)
    )
