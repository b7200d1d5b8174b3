"""Check SQL of the registered queries, written against the test tables.

Each text is a chain of named subqueries, of which only the needed ones are emitted.
"""

from __future__ import annotations

import re

from reviewlake.fixtures import VIEWS

_IN_PR_REPOS = "('repo-1','repo-2','repo-4','repo-7')"
_PR_NAMES = "('user-5','user-6','user-7','user-8','user-9')"
_PR_DROP = "('user-8','user-11')"
_RUN_NAMES = "('user-5','user-6','user-7','user-8','user-9','user-10')"

PARTS: dict[str, str] = dict(VIEWS)

PARTS["links"] = """
SELECT DISTINCT repo, pr_id, pipeline_uuid FROM (
  SELECT repo, pr_id, regexp_extract(url, '/pipelines/results/([^?#]*)', 1) AS pipeline_uuid
  FROM fx_pr_statuses) t WHERE pipeline_uuid <> ''"""

PARTS["diffs"] = """
SELECT repo, pr_id, CAST(count(*) AS BIGINT) AS file_changed,
       CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_removed) AS BIGINT) AS removed,
       CAST(sum(lines_added) + sum(lines_removed) AS BIGINT) AS total
FROM fx_pr_diffstat GROUP BY repo, pr_id"""

PARTS["first_links"] = """
SELECT repo, pr_id, min(pipeline_uuid) AS pipeline_uuid FROM links GROUP BY repo, pr_id"""

PARTS["last_deps"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, pipeline_uuid
  ORDER BY created_on DESC, deployment_uuid DESC) AS rn FROM fx_deployments) t WHERE rn = 1"""

PARTS["pr_links_env"] = """
SELECT l.repo, l.pr_id, l.pipeline_uuid,
       coalesce(d.environment_name, '') AS environment_name,
       coalesce(d.state_name, '') AS deployment_state,
       coalesce(d.status_name, '') AS deployment_status
FROM first_links l LEFT JOIN last_deps d
  ON l.repo = d.repo AND l.pipeline_uuid = d.pipeline_uuid"""

PARTS["rep"] = """
SELECT p.pr_id, p.repo, p.src_repo, p.src_branch, p.dest_repo, p.dest_branch, p.title,
       p.description, p.state, p.author, p.created_on AS created, p.updated_on AS updated,
       coalesce(f.file_changed, 0) AS file_changed, coalesce(f.added, 0) AS added,
       coalesce(f.removed, 0) AS removed, coalesce(f.total, 0) AS total,
       a.activity_type, a.activity_user, a.activity_content,
       coalesce(e.pipeline_uuid, '') AS pipeline_uuid,
       coalesce(e.environment_name, '') AS environment_name,
       coalesce(e.deployment_state, '') AS deployment_state,
       coalesce(e.deployment_status, '') AS deployment_status
FROM fx_pull_requests p
JOIN fx_pr_activity a ON a.repo = p.repo AND a.pr_id = p.pr_id AND a.activity_type <> 'update'
LEFT JOIN diffs f ON f.repo = p.repo AND f.pr_id = p.pr_id
LEFT JOIN pr_links_env e ON e.repo = p.repo AND e.pr_id = p.pr_id"""

PARTS["ci"] = """
SELECT p.pipeline_uuid, p.repo, p.build_number, p.run_number, p.creator, p.target_ref_type,
       p.target_ref_name, upper(replace(p.trigger_type, 'pipeline_trigger_', '')) AS trigger_name,
       p.state_name, p.result_name, coalesce(d.environment_uuid, '') AS environment_uuid,
       coalesce(d.environment_name, '') AS environment_name,
       coalesce(d.state_name, '') AS deployment_state,
       coalesce(d.status_name, '') AS deployment_status, p.created_on, p.completed_on,
       CASE WHEN try_cast(p.completed_on AS TIMESTAMP) > CAST(p.created_on AS TIMESTAMP)
            THEN CAST(epoch(try_cast(p.completed_on AS TIMESTAMP))
                      - epoch(CAST(p.created_on AS TIMESTAMP)) AS INTEGER)
            ELSE p.build_seconds_used END AS duration_seconds
FROM fx_pipelines p LEFT JOIN fx_deployments d
  ON d.repo = p.repo AND d.pipeline_uuid = p.pipeline_uuid"""

_PR_ROW = (
    "pr_id, repo, src_repo, author, updated, added, removed, total, src_branch, dest_repo, "
    "dest_branch, title, state, created, file_changed"
)


def _first_pr(rows: str, keys: str = "pr_id") -> str:
    return (
        f"SELECT {_PR_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} "
        f"ORDER BY repo, src_repo) AS rn FROM {rows}) t WHERE rn = 1"
    )


def _first_run(rows: str) -> str:
    return (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_uuid "
        "ORDER BY created_on DESC, repo, environment_name, environment_uuid) AS rn "
        f"FROM {rows}) t WHERE rn = 1"
    )


PARTS["prs"] = _first_pr("rep")
PARTS["prs_by_repo"] = _first_pr("rep", "repo, pr_id")
PARTS["runs"] = _first_run("ci")

# Table rule: bots and excluded names match author or user, included names too.
PARTS["rep_named"] = f"""
SELECT * FROM rep
WHERE author <> 'user-3' AND activity_user <> 'user-3'
  AND author NOT IN {_PR_DROP} AND activity_user NOT IN {_PR_DROP}
  AND (author IN {_PR_NAMES} OR activity_user IN {_PR_NAMES})"""
PARTS["rep_filtered"] = f"""
SELECT * FROM rep_named
WHERE updated >= '1994-01-01' AND updated <= '1997-12-31'
  AND split_part(src_repo, '/', 2) IN {_IN_PR_REPOS}"""
PARTS["prs_named"] = _first_pr("rep_named")
# Chart rule: author only for pull requests, user only for reviews.
PARTS["rep_no_bots"] = "SELECT * FROM rep WHERE author <> 'user-3' AND activity_user <> 'user-3'"
PARTS["rep_by_author"] = f"""
SELECT * FROM rep_no_bots WHERE author IN {_PR_NAMES} AND author NOT IN {_PR_DROP}"""
PARTS["chart_prs"] = _first_pr("rep_by_author")
PARTS["runs_named"] = _first_run(
    f"(SELECT * FROM ci WHERE creator <> 'user-3' AND creator IN {_RUN_NAMES} "
    "AND creator <> 'user-8') c"
)
PARTS["runs_no_bots"] = _first_run("(SELECT * FROM ci WHERE creator <> 'user-3') c")

PARTS["csv_rows"] = """
SELECT pr_id AS "ID", src_repo AS "SrcRepo", src_branch AS "SrcBranch", dest_repo AS "DestRepo",
       dest_branch AS "DestBranch", title AS "Title", description AS "Description",
       state AS "State", author AS "Author", created AS "Created", updated AS "Updated",
       file_changed AS "FileChanged", added AS "Added", removed AS "Removed", total AS "Total",
       activity_type AS "Type", activity_user AS "User", repo FROM rep"""
PARTS["csv_prs"] = """
SELECT DISTINCT "ID", "SrcRepo", "SrcBranch", "DestRepo", "DestBranch", "Title", "Description",
       "State", "Author", "Created", "Updated", "FileChanged", "Added", "Removed", "Total"
FROM csv_rows"""


def _with(body: str) -> str:
    """Prefix ``body`` with the named subqueries it needs, in definition order."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name in PARTS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                needed.add(name)
                queue.append(PARTS[name])
    chain = ",\n".join(f"{n} AS ({sql})" for n, sql in PARTS.items() if n in needed)
    return f"WITH {chain}\n{body}"


_N = "CAST(count(*) AS BIGINT)"
_CHANGES = (
    "CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, "
    "CAST(sum(total) AS BIGINT) AS total"
)
_FOUR = (
    "CAST(count(*) FILTER (WHERE result_name = 'SUCCESSFUL') AS BIGINT) AS successful, "
    "CAST(count(*) FILTER (WHERE result_name = 'FAILED') AS BIGINT) AS failed, "
    "CAST(count(*) FILTER (WHERE result_name = 'ERROR') AS BIGINT) AS error, "
    "CAST(count(*) FILTER (WHERE result_name = 'STOPPED') AS BIGINT) AS stopped"
)
_MEAN = (
    "CAST(sum(duration_seconds) FILTER (WHERE duration_seconds > 0) // "
    "count(*) FILTER (WHERE duration_seconds > 0) AS BIGINT)"
)
_PR_SLIM = "repo, pr_id, author, updated, activity_type, activity_user"
_RUN_SLIM = "pipeline_uuid, repo, creator, created_on, environment_name, result_name"
_REVIEWS = (
    "CAST(count(*) FILTER (WHERE activity_type = 'approval') AS BIGINT) AS approval, "
    "CAST(count(*) FILTER (WHERE activity_type <> 'approval') AS BIGINT) AS comment"
)
_RUN_EPOCH = "epoch(CAST(created_on AS TIMESTAMP))"


def _pivot(index: str, column: str, names: list[str], value: str, rows: str, where: str) -> str:
    cells = (value.format(cond=f"\"{column}\" = '{n}'") + f' AS "{n}"' for n in names)
    return f"SELECT {index}, {', '.join(cells)} FROM {rows} WHERE {where} GROUP BY 1"


def _long(chart: str, label: str, rows: str, measures: dict[str, str], where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, {label} AS label, '{m}' AS measure, "
        f"CAST({v} AS BIGINT) AS value FROM {rows} WHERE {where} "
        + ("" if label == "''" else "GROUP BY 2")
        for m, v in measures.items()
    )


_SUM3 = {"added": "sum(added)", "removed": "sum(removed)", "total": "sum(total)"}
_RESULT = "count(*) FILTER (WHERE result_name = '{}')"
_RESULTS = {n.lower(): _RESULT.format(n) for n in ("SUCCESSFUL", "FAILED", "ERROR", "STOPPED")}

_PR_CHARTS = " UNION ALL ".join(
    [
        _long(
            "summary",
            "''",
            "chart_prs",
            {
                "total_prs": "count(*)",
                "total_added": "sum(added)",
                "total_removed": "sum(removed)",
                "total_changed": "sum(total)",
                "unique_authors": "count(DISTINCT author)",
                "unique_repos": "count(DISTINCT src_repo)",
            },
        ),
        _long("pr_count_by_author", "author", "chart_prs", {"value": "count(*)"}),
        _long("code_changes_by_author", "author", "chart_prs", _SUM3),
        _long("pr_count_by_month", "substring(updated, 1, 7)", "chart_prs", {"value": "count(*)"}),
        _long("code_changes_by_repo", "split_part(src_repo, '/', 2)", "chart_prs", _SUM3),
        _long(
            "activity_by_user",
            "activity_user",
            "rep_no_bots",
            {
                "approval": "count(*) FILTER (WHERE activity_type = 'approval')",
                "comment": "count(*) FILTER (WHERE activity_type <> 'approval')",
            },
            f"activity_user IN {_PR_NAMES} AND activity_user NOT IN {_PR_DROP}",
        ),
    ]
)
_RUN_CHARTS = " UNION ALL ".join(
    [
        _long(
            "summary",
            "''",
            "runs_named",
            {
                "total_pipelines": "count(*)",
                "success_count": _RESULTS["successful"],
                "failed_count": _RESULTS["failed"],
                "error_count": _RESULTS["error"],
                "stopped_count": _RESULTS["stopped"],
                "avg_duration_seconds": _MEAN,
                "unique_creators": "count(DISTINCT creator)",
                "unique_repos": "count(DISTINCT repo)",
            },
        ),
        _long("pipelines_by_creator", "creator", "runs_named", {"value": "count(*)"}),
        _long("results_by_repo", "repo", "runs_named", _RESULTS),
        _long(
            "avg_duration_by_repo", "repo", "runs_named", {"value": _MEAN}, "duration_seconds > 0"
        ),
        _long(
            "pipelines_by_month", "substring(created_on, 1, 7)", "runs_named", {"value": "count(*)"}
        ),
        _long(
            "deployment_frequency",
            "substring(created_on, 1, 7) || ' ' || target_ref_name",
            "runs_named",
            {"count": "count(*)"},
            "result_name = 'SUCCESSFUL' AND target_ref_name IN ('main','master')",
        ),
    ]
)

_FREQUENCY = (
    f"SELECT substring(created_on, 1, 7) AS month, target_ref_name AS environment, {_N} AS count "
    "FROM runs WHERE result_name = 'SUCCESSFUL' AND target_ref_name IN ('main','master') "
    "GROUP BY 1, 2"
)
PARTS["frequency"] = _FREQUENCY
_COMMENT_SQL = "activity_type NOT IN ('approval','update')"
_TABLE_RUNS = (
    "pipeline_uuid, repo, build_number, run_number, creator, target_ref_type, target_ref_name, "
    "trigger_name, state_name, result_name, environment_uuid, environment_name, "
    "deployment_state, deployment_status, created_on, completed_on, duration_seconds"
)
_TABLE_PRS = (
    "pr_id AS id, split_part(src_repo, '/', 2) AS src_repo, src_branch, "
    "split_part(dest_repo, '/', 2) AS dest_repo, dest_branch, title, state, author, created, "
    "updated, file_changed, added, removed, total"
)
_RUN_PAGE = "ORDER BY created_on DESC, repo, pipeline_uuid"



def _user(column: str) -> str:
    return f"json_object('display_name', {column}, 'uuid', '{{' || {column} || '}}')"


def _text(*members: str) -> str:
    """The record as JSON text, absent members left out; appended to a projection."""
    return f", CAST(json_merge_patch('{{}}', json_object({', '.join(members)})) AS VARCHAR) AS raw_json "


def _ref(side: str) -> str:
    return f"json_object('branch', json_object('name', {side}_branch), 'repository', json_object('full_name', {side}_repo))"


RAW_JSON = {
    "p1_pull_requests": _text(
        "'id', pr_id, 'type', 'pullrequest', 'title', title, 'description', description, 'state', state, 'comment_count', 2",
        f"'author', {_user('author')}",
        "'reviewers', json_array(json_object('display_name', author, 'approved', state = 'MERGED', 'role', 'AUTHOR'))",
        "'created_on', created_on || 'T23:30:00.123456-07:00', 'updated_on', updated_on || 'T00:30:00.5+07:00'",
        f"'source', {_ref('src')}, 'destination', {_ref('dest')}",
    ),
    "p2_commits": _text(
        "'hash', hash, 'message', message, 'date', CASE WHEN date <> '' THEN replace(date, 'Z', '.25+00:00') END",
        f"'author', json_object('user', {_user('author')})",
    ),
    "p3_activity": _text(
        "'pull_request', CASE WHEN activity_type <> 'approval' THEN json_object('id', pr_id) END",
        "'approval', CASE WHEN activity_type = 'approval' THEN json_object('date', activity_content || 'T09:00:00.000001+02:00', "
        f"'user', {_user('activity_user')}) END",
        "'comment', CASE WHEN activity_type = 'pullrequest_comment' THEN json_object('id', length(activity_content), "
        "'type', activity_type, 'created_on', '2024-01-02T03:04:05.999+00:00', 'updated_on', '2024-01-02T03:04:06Z', "
        f"'content', json_object('raw', activity_content), 'user', {_user('activity_user')}) END",
        f"'update', CASE WHEN activity_type = 'update' THEN json_object('author', {_user('activity_user')}, 'state', 'OPEN') END",
    ),
    "p4_diffstat": _text(
        "'type', 'diffstat', 'lines_added', lines_added, 'lines_removed', lines_removed, 'status', 'modified'",
        "'new', json_object('path', 'src/a')",
    ),
    "p5_comments": _text(
        "'id', comment_id, 'created_on', created_day || 'T01:02:03.5Z', 'content', json_object('raw', content)",
        "'inline', CASE WHEN path <> '' THEN json_object('from', line_from, 'to', line_to, 'path', path) END",
        "'parent', CASE WHEN parent_id <> 0 THEN json_object('id', parent_id) END",
        f"'user', {_user('comment_user')}, 'deleted', CASE WHEN deleted THEN true END",
    ),
    "p6_statuses": _text(
        "'state', 'SUCCESSFUL', 'key', 'build', 'url', url, 'created_on', '2024-01-02T03:04:05.999-03:00'"
    ),
    "p7_runs": _text(
        "'uuid', pipeline_uuid, 'build_number', build_number, 'run_number', run_number",
        f"'creator', CASE WHEN creator <> '' THEN {_user('creator')} END",
        "'target', json_object('ref_type', target_ref_type, 'ref_name', target_ref_name)",
        "'trigger', json_object('type', nullif(trigger_type, ''))",
        "'state', json_object('name', state_name, 'result', json_object('name', result_name))",
        "'created_on', replace(created_on, 'Z', '.75Z'), 'completed_on', replace(nullif(completed_on, ''), 'Z', '.25+00:00')",
        "'build_seconds_used', build_seconds_used, 'expired', false",
    ),
    "p8_deployments": _text(
        "'uuid', deployment_uuid, 'state', json_object('name', state_name, 'status', json_object('name', status_name))",
        "'pipeline', json_object('uuid', pipeline_uuid)",
        "'environment', json_object('uuid', environment_uuid, 'name', environment_name)",
        "'created_on', created_on || 'T05:06:07.123Z'",
    ),
}


def _placed(body: str, order: str) -> str:
    return f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM ({body}) placed"


BODIES: dict[str, str] = {
    # scans, sources, sinks
    "s1_page_scan": "SELECT repo, pr_id, title, state, author, src_repo FROM fx_pull_requests",
    "s1_child_pages": "SELECT 'activity' AS kind, repo, pr_id, activity_type AS said FROM fx_pr_activity "
    "UNION ALL SELECT 'commit', repo, pr_id, hash FROM fx_pr_commits "
    "UNION ALL SELECT 'comment', repo, pr_id, content FROM fx_pr_comments "
    "UNION ALL SELECT 'status', repo, pr_id, url FROM fx_pr_statuses "
    "UNION ALL SELECT 'diffstat', repo, pr_id, 'src/a' FROM fx_pr_diffstat",
    "s1_rejected_records": "SELECT repo, title, state, CASE WHEN state = 'DECLINED' THEN 'record' ELSE '' END "
    "AS reason FROM fx_pull_requests",
    "s2_decode_prs": "SELECT repo, pr_id, title, description, author FROM fx_pull_requests",
    "s2_decode_activity": "SELECT repo, pr_id, activity_user FROM fx_pr_activity",
    "s2_decode_diffstat": "SELECT * FROM fx_pr_diffstat WHERE repo IN ('repo-1','repo-2')",
    "s3_decode_runs": "SELECT repo, pipeline_uuid, build_number, result_name, creator "
    "FROM fx_pipelines",
    "s3_decode_deployments": "SELECT repo, deployment_uuid, pipeline_uuid, environment_name "
    "FROM fx_deployments",
    "s4_pr_links": "SELECT * FROM links",
    "s4_pr_link_lists": "SELECT repo, pr_id, 0 AS part, "
    "string_agg(pipeline_uuid, ',' ORDER BY pipeline_uuid) AS pipeline_uuids "
    "FROM links GROUP BY repo, pr_id",
    "s5_pr_report_scan": "SELECT repo, pr_id, author, created AS created_date, "
    "updated AS updated_date FROM rep",
    "s6_ci_report_scan": f"SELECT pipeline_uuid, environment_name, "
    f"CAST({_RUN_EPOCH} AS BIGINT) AS created_epoch, "
    "CASE WHEN completed_on = '' THEN -62135596800 ELSE "
    "CAST(epoch(try_cast(completed_on AS TIMESTAMP)) AS BIGINT) END AS completed_epoch FROM ci",
    "s7_csv_scan": "SELECT * EXCLUDE (repo) FROM csv_rows",
    "k1_upsert": "SELECT repo, pr_id, CASE WHEN state = 'MERGED' THEN title || ' v2' ELSE title "
    "END AS title, state, author AS author_display_name FROM fx_pull_requests",
    "k1_stream_upsert": "SELECT repo, pr_id, CASE WHEN state = 'MERGED' THEN '' ELSE 'old ' END || title "
    "AS title, state, created_on, updated_on FROM fx_pull_requests",
    "k1_stream_runs": "SELECT repo, pipeline_uuid, build_number, state_name, CASE WHEN state_name = 'COMPLETED' "
    "THEN result_name ELSE 'UNKNOWN' END AS result_name FROM fx_pipelines",
    "k1_stream_deployments": "SELECT repo, deployment_uuid, pipeline_uuid, environment_name, "
    "CASE WHEN status_name = 'FAILED' THEN status_name ELSE 'UNKNOWN' END AS status_name FROM fx_deployments",
    "k3_stream_runs": "SELECT repo, pr_id, comment_id, content AS content_raw, parent_id FROM fx_pr_comments "
    "WHERE repo NOT IN ('repo-1','repo-2','repo-4') OR (repo IN ('repo-1','repo-2') AND deleted)",
    "k2_insert_absent": "SELECT * FROM links EXCEPT SELECT repo, pr_id, "
    "regexp_extract(url, '/pipelines/results/([^?#]*)', 1) FROM fx_pr_statuses "
    "WHERE contains(url, '?')",
    "k3_replace_repos": "SELECT repo, pr_id, activity_type, activity_user AS user_display_name, "
    "CASE WHEN activity_type = 'approval' THEN activity_content || 'T09:00:00Z' ELSE '' END "
    "AS approval_date FROM fx_pr_activity WHERE repo NOT IN ('repo-1','repo-2','repo-3') "
    "OR (repo IN ('repo-1','repo-2') AND activity_type = 'approval')",
    "k4_pr_report_rebuild": "SELECT * FROM rep",
    "k4_ci_report_rebuild": "SELECT * FROM ci",
    "k5_evolve_schema": "SELECT * REPLACE ('' AS pipeline_uuid, '' AS environment_name, "
    "'' AS deployment_state, '' AS deployment_status) FROM rep",
    "k6_csv_export": 'SELECT CAST("ID" AS VARCHAR) AS "ID", "SrcRepo", "Title", "Author", '
    '"Updated", CAST("Total" AS VARCHAR) AS "Total", "Type", repo FROM csv_rows',
    # JSON to raw rows
    "p1_pull_requests": "SELECT pr_id, repo, 'pullrequest' AS type, title, description, state, "
    "2 AS comment_count, 0 AS task_count, author AS author_display_name, "
    "'{' || author || '}' AS author_uuid, '' AS author_account_id, '' AS author_nickname, "
    "src_repo, src_branch, dest_repo, dest_branch, created_on, updated_on, "
    "'[{\"display_name\":\"' || author || '\",\"uuid\":\"\",\"account_id\":\"\",\"nickname\":\"\","
    "\"type\":\"\",\"approved\":' || CASE WHEN state = 'MERGED' THEN 'true' ELSE 'false' END "
    "|| ',\"state\":\"\",\"role\":\"AUTHOR\"}]' AS reviewers, 'null' AS participants "
    "FROM fx_pull_requests",
    "p2_commits": "SELECT pr_id, repo, hash, message, date, author AS author_display_name, "
    "'{' || author || '}' AS author_uuid, '' AS author_account_id FROM fx_pr_commits",
    "p3_activity": "SELECT pr_id, repo, activity_type, activity_user AS user_display_name, "
    "'{' || activity_user || '}' AS user_uuid, '' AS user_account_id, "
    f"CASE WHEN {_COMMENT_SQL} THEN CAST(length(activity_content) AS INTEGER) ELSE 0 END "
    "AS comment_id, "
    f"CASE WHEN {_COMMENT_SQL} THEN activity_content ELSE '' END AS comment_content_raw, "
    f"CASE WHEN {_COMMENT_SQL} THEN '2024-01-02T03:04:05Z' ELSE '' END AS comment_created_on, "
    f"CASE WHEN {_COMMENT_SQL} THEN '2024-01-02T03:04:06Z' ELSE '' END AS comment_updated_on, "
    "CASE WHEN activity_type = 'approval' THEN activity_content || 'T09:00:00+02:00' ELSE '' END "
    "AS approval_date FROM fx_pr_activity",
    "p4_diffstat": "SELECT pr_id, repo, 'diffstat' AS file_type, lines_added, lines_removed, "
    "'modified' AS status, '' AS old_path, 'src/a' AS new_path FROM fx_pr_diffstat",
    "p5_comments": "SELECT pr_id, repo, comment_id, content AS content_raw, path AS inline_path, "
    "line_from AS inline_from, line_to AS inline_to, parent_id, "
    "comment_user AS user_display_name, '{' || comment_user || '}' AS user_uuid, "
    "CASE WHEN deleted THEN 1 ELSE 0 END AS deleted, created_day || 'T01:02:03Z' AS created_on, "
    "'0001-01-01T00:00:00Z' AS updated_on FROM fx_pr_comments",
    "p6_statuses": "SELECT pr_id, repo, 'build' AS key, '' AS name, 'SUCCESSFUL' AS state, url, "
    "'' AS description, '2024-01-02T03:04:05-03:00' AS created_on, "
    "'0001-01-01T00:00:00Z' AS updated_on FROM fx_pr_statuses",
    "p7_runs": "SELECT pipeline_uuid, repo, build_number, run_number, creator AS creator_name, "
    "CASE WHEN creator = '' THEN '' ELSE '{' || creator || '}' END AS creator_uuid, "
    "'' AS creator_account_id, target_ref_type, target_ref_name, "
    "upper(replace(trigger_type, 'pipeline_trigger_', '')) AS trigger_name, state_name, "
    "result_name, created_on, completed_on, build_seconds_used FROM fx_pipelines",
    "p8_deployments": "SELECT deployment_uuid, repo, pipeline_uuid, environment_uuid, "
    "environment_name, state_name, status_name, '' AS release_name, "
    "created_on || 'T05:06:07Z' AS created_on, '' AS completed_on FROM fx_deployments",
    "p9_stamp_parent": "SELECT repo, pr_id, CASE WHEN activity_type = 'approval' THEN 1 ELSE 0 "
    "END AS stamped, CASE WHEN activity_type IN ('approval','update') THEN activity_type "
    "ELSE 'comment' END AS kind FROM fx_pr_activity",
    "p10_pr_rows": f"SELECT {_TABLE_PRS} FROM prs",
    "p11_pr_display": "SELECT '#' || CAST(pr_id AS VARCHAR) AS number, "
    "split_part(src_repo, '/', 2) AS repo, CASE WHEN length(t) > 50 THEN left(t, 50) || '…' "
    "ELSE t END AS title, author, state, updated, '+' || format('{:,}', added) AS added, "
    "'-' || format('{:,}', removed) AS removed, CAST(file_changed AS VARCHAR) AS files "
    "FROM (SELECT *, title || ' / ' || src_branch || ' / ' || split_part(dest_repo, '/', 2) "
    "|| ' / ' || state || ' / ' || author AS t FROM prs_by_repo) x",
    "p11_ci_display": "SELECT "
    "'#' || CAST(coalesce(nullif(run_number, 0), build_number) AS VARCHAR) AS number, repo, "
    "CASE creator WHEN '' THEN '—' ELSE creator END AS creator, "
    "target_ref_name AS ref, "
    "CASE trigger_name WHEN '' THEN '—' ELSE trigger_name END AS trigger, "
    "state_name AS state, result_name AS result, "
    "CASE environment_name WHEN '' THEN '—' ELSE environment_name END AS environment, "
    "CASE WHEN duration_seconds = 0 THEN '—' WHEN duration_seconds < 60 "
    "THEN CAST(duration_seconds AS VARCHAR) || 's' "
    "ELSE CAST(duration_seconds // 60 AS VARCHAR) || 'm ' "
    "|| CAST(duration_seconds % 60 AS VARCHAR) || 's' END AS duration, "
    "substring(created_on, 1, 10) AS created FROM runs",
    # filters
    "f1_created_between": "SELECT repo, pr_id, state, created_on FROM fx_pull_requests "
    "WHERE created_on BETWEEN '1995-01-01' AND '1996-06-30' AND state IN ('MERGED','OPEN')",
    "f2_ts_between": "SELECT repo, pipeline_uuid, created_on FROM fx_pipelines "
    "WHERE CAST(created_on AS TIMESTAMP) >= TIMESTAMP '2024-02-01 00:00:00' "
    "AND CAST(created_on AS TIMESTAMP) <= TIMESTAMP '2024-03-15 12:00:00'",
    "f3_pr_filter": f"SELECT {_PR_SLIM} FROM rep_filtered",
    "f4_run_filter": f"SELECT {_RUN_SLIM} FROM ci WHERE creator NOT IN ('user-3','user-8') "
    "AND CAST(created_on AS TIMESTAMP) >= TIMESTAMP '2024-02-01 00:00:00' "
    "AND CAST(created_on AS TIMESTAMP) <= TIMESTAMP '2024-05-31 00:00:00' "
    f"AND repo IN {_IN_PR_REPOS} AND creator IN {_RUN_NAMES} "
    "AND environment_name IN ('Staging','Production') "
    "AND target_ref_name IN ('main','develop') AND result_name IN ('SUCCESSFUL','FAILED')",
    "f5_author_filter": f"SELECT {_PR_SLIM} FROM rep WHERE author IN {_PR_NAMES} "
    f"AND author NOT IN {_PR_DROP}",
    "f6_reviewer_filter": f"SELECT {_PR_SLIM} FROM rep WHERE activity_user IN {_PR_NAMES} "
    f"AND activity_user NOT IN {_PR_DROP} AND activity_user NOT IN ('', 'user-3')",
    "f7_creator_filter": f"SELECT {_RUN_SLIM} FROM ci WHERE creator IN {_RUN_NAMES} "
    "AND creator NOT IN ('user-3','user-8')",
    "f8_environment_filter": "SELECT repo, deployment_uuid, environment_name FROM fx_deployments "
    "WHERE lower(environment_name) = 'production'",
    "f9_production_runs": f"SELECT {_RUN_SLIM}, target_ref_name FROM ci "
    "WHERE result_name = 'SUCCESSFUL' AND target_ref_name IN ('main','master')",
    "f10_production_table": f"SELECT {_RUN_SLIM}, target_ref_name FROM runs "
    "WHERE result_name = 'SUCCESSFUL' AND target_ref_name IN ('develop','main','master')",
    "f11_csv_filter": 'SELECT "ID", "SrcRepo", "Author", "Updated", "Type" FROM csv_rows '
    "WHERE \"SrcRepo\" IN ('ws/repo-1','ws/repo-2','ws/repo-5') "
    "AND \"Updated\" BETWEEN '1995-10-01' AND '1996-12-31'",
    "f12_list_parameters": f"SELECT {_PR_SLIM} FROM rep WHERE src_repo = 'ws/repo-3'",
    "f13_date_parameters": "SELECT repo, pipeline_uuid, created_on FROM fx_pipelines "
    "WHERE CAST(created_on AS TIMESTAMP) < TIMESTAMP '2024-03-16 00:00:00'",
    "f14_lookback": "SELECT repo, pr_id, created_on FROM fx_pull_requests "
    "WHERE created_on >= '1998-03-01'",
    # joins
    "j1_pr_activity": "SELECT a.repo, a.pr_id, a.activity_type, a.activity_user, "
    "a.activity_content, p.title, p.author FROM fx_pr_activity a JOIN fx_pull_requests p "
    "ON p.repo = a.repo AND p.pr_id = a.pr_id WHERE a.activity_type <> 'update'",
    "j2_diff_totals": "SELECT p.repo, p.pr_id, p.title, p.author, "
    "coalesce(d.file_changed, 0) AS file_changed, coalesce(d.added, 0) AS added, "
    "coalesce(d.removed, 0) AS removed, coalesce(d.total, 0) AS total FROM fx_pull_requests p "
    "LEFT JOIN diffs d ON d.repo = p.repo AND d.pr_id = p.pr_id",
    "j3_first_link": "SELECT p.repo, p.pr_id, p.title, p.author, "
    "coalesce(l.pipeline_uuid, '') AS pipeline_uuid FROM fx_pull_requests p "
    "LEFT JOIN first_links l ON l.repo = p.repo AND l.pr_id = p.pr_id",
    "j4_link_deployment": "SELECT * FROM pr_links_env",
    "j5_run_deployments": "SELECT repo, pipeline_uuid, result_name, environment_uuid, "
    "environment_name, deployment_state, deployment_status FROM ci",
    "j6_new_keys": "SELECT repo, pipeline_uuid FROM fx_pipelines EXCEPT "
    "SELECT repo, pipeline_uuid FROM fx_deployments",
    "j7_status_links": "SELECT repo, pipeline_uuid FROM links EXCEPT "
    "SELECT repo, pipeline_uuid FROM fx_pipelines",
    "j8_step_deployments": "SELECT DISTINCT d.repo, d.deployment_uuid, d.pipeline_uuid, "
    "d.environment_name FROM fx_deployments d JOIN fx_pipeline_steps s "
    "ON s.repo = d.repo AND s.deployment_uuid = d.deployment_uuid "
    "WHERE lower(d.environment_name) = 'staging' AND (s.repo, s.pipeline_uuid) NOT IN "
    "(SELECT (repo, pipeline_uuid) FROM fx_deployments WHERE status_name = 'FAILED') "
    "AND (s.repo, s.pipeline_uuid) IN (SELECT (repo, pipeline_uuid) FROM fx_pipelines)",
    # reports
    "r1_pr_report": "SELECT * FROM rep",
    "r2_ci_report": "SELECT * FROM ci",
    "r3_pr_chart_rows": _PR_CHARTS,
    "r3t_pr_table": f"SELECT {_TABLE_PRS} FROM prs_named ORDER BY pr_id LIMIT 50 OFFSET 50",
    "r4_ci_chart_rows": _RUN_CHARTS,
    "r4t_ci_table": f"SELECT {_TABLE_RUNS} FROM runs_no_bots {_RUN_PAGE} LIMIT 100 OFFSET 200",
    "r4t_production_table": f"SELECT {_TABLE_RUNS} FROM runs_no_bots "
    "WHERE result_name = 'SUCCESSFUL' AND target_ref_name IN ('main','master') "
    f"{_RUN_PAGE} LIMIT 100",
    # aggregations
    "a1_diff_totals": "SELECT * FROM diffs",
    "a2_pr_summary": f"SELECT {_N} AS total_prs, CAST(sum(added) AS BIGINT) AS total_added, "
    "CAST(sum(removed) AS BIGINT) AS total_removed, CAST(sum(total) AS BIGINT) AS total_changed, "
    "count(DISTINCT author) AS unique_authors, count(DISTINCT src_repo) AS unique_repos FROM prs",
    "a3_prs_by_author": f"SELECT author AS label, {_N} AS value FROM prs GROUP BY 1",
    "a4_changes_by_author": f"SELECT author AS label, {_CHANGES} FROM prs GROUP BY 1",
    "a5_activity_by_user": f"SELECT activity_user AS label, {_REVIEWS} FROM rep "
    f"WHERE activity_user IN {_PR_NAMES} AND activity_user NOT IN {_PR_DROP} GROUP BY 1",
    "a6_prs_by_month": f"SELECT substring(updated, 1, 7) AS label, {_N} AS value "
    "FROM prs GROUP BY 1",
    "a7_changes_by_repo": f"SELECT split_part(src_repo, '/', 2) AS label, {_CHANGES} "
    "FROM prs_by_repo GROUP BY 1",
    "a8_pr_meta": "SELECT DISTINCT 'repo' AS kind, split_part(src_repo, '/', 2) AS value FROM rep "
    "UNION ALL SELECT DISTINCT 'author', author FROM rep WHERE author NOT IN ('', 'user-3') "
    "UNION ALL SELECT DISTINCT 'user', activity_user FROM rep "
    "WHERE activity_user NOT IN ('', 'user-3') "
    "UNION ALL SELECT 'date_min', min(updated) FROM rep "
    "UNION ALL SELECT 'date_max', max(updated) FROM rep UNION ALL SELECT 'excluded', 'user-3'",
    "a9_ci_summary": f"SELECT {_N} AS total_pipelines, "
    f"{_RESULTS['successful']} AS success_count, {_RESULTS['failed']} AS failed_count, "
    f"{_RESULTS['error']} AS error_count, {_RESULTS['stopped']} AS stopped_count, "
    f"{_MEAN} AS avg_duration_seconds, "
    "count(DISTINCT nullif(creator, '')) AS unique_creators, "
    "count(DISTINCT repo) AS unique_repos FROM runs",
    "a10_runs_by_creator": f"SELECT creator AS label, {_N} AS value FROM runs "
    "WHERE creator <> '' GROUP BY 1",
    "a11_runs_by_month": f"SELECT substring(created_on, 1, 7) AS label, {_N} AS value "
    "FROM runs GROUP BY 1",
    "a12_results_by_repo": f"SELECT repo AS label, {_FOUR} FROM runs GROUP BY 1",
    "a13_mean_duration_by_repo": f"SELECT repo AS label, {_MEAN} AS value FROM runs "
    "WHERE duration_seconds > 0 GROUP BY 1",
    "a14_deployment_frequency": _FREQUENCY,
    "a15_ci_meta": "SELECT DISTINCT 'repo' AS kind, repo AS value FROM ci "
    "UNION ALL SELECT DISTINCT 'creator', creator FROM ci WHERE creator NOT IN ('', 'user-3') "
    "UNION ALL SELECT DISTINCT 'environment', environment_name FROM ci "
    "WHERE environment_name <> '' "
    "UNION ALL SELECT DISTINCT 'target', target_ref_name FROM ci "
    "UNION ALL SELECT 'date_min', substring(min(created_on), 1, 10) FROM ci "
    "UNION ALL SELECT 'date_max', substring(max(created_on), 1, 10) FROM ci "
    "UNION ALL SELECT 'excluded', 'user-3' "
    "UNION ALL SELECT 'production_ref', unnest(['main', 'master'])",
    # pivot reports
    "n1_total_by_repo": "SELECT split_part(\"SrcRepo\", '/', 2) AS \"SrcRepo\", "
    'CAST(sum("Total") AS BIGINT) AS total FROM csv_prs GROUP BY 1',
    "n1_total_by_author": 'SELECT "Author", CAST(sum("Total") AS BIGINT) AS total '
    "FROM csv_prs GROUP BY 1",
    "n2_count_by_repo": "SELECT split_part(\"SrcRepo\", '/', 2) AS \"SrcRepo\", "
    'count("Total") AS n FROM csv_prs GROUP BY 1',
    "n2_count_by_author": 'SELECT "Author", count("Total") AS n FROM csv_prs GROUP BY 1',
    "n3_month_repo_pivot": _pivot(
        'substring("Updated", 1, 7) AS "DateGroup"',
        "SrcRepo",
        [f"repo-{n}" for n in range(25)],
        'CAST(coalesce(sum("Total") FILTER (WHERE {cond}), 0) AS BIGINT)',
        "(SELECT * REPLACE (split_part(\"SrcRepo\", '/', 2) AS \"SrcRepo\") FROM csv_prs) c",
        "true",
    ),
    "n4_mean_total": 'SELECT avg("Total") AS mean_total FROM csv_prs',
    "n5_activity_by_repo": _pivot(
        "split_part(\"SrcRepo\", '/', 2) AS \"SrcRepo\"",
        "Type",
        ["approval", "pullrequest_comment"],
        'count("Total") FILTER (WHERE {cond})',
        "csv_rows",
        "true",
    ),
    "n6_activity_by_user": _pivot(
        '"User"',
        "Type",
        ["approval", "pullrequest_comment"],
        'count("Total") FILTER (WHERE {cond})',
        "csv_rows",
        "true",
    ),
    "n7_cross_activity_by_repo": _pivot(
        "split_part(\"SrcRepo\", '/', 2) AS \"SrcRepo\"",
        "Type",
        ["approval", "pullrequest_comment"],
        'count("Total") FILTER (WHERE {cond})',
        "csv_rows",
        '"User" <> "Author"',
    ),
    "n7_cross_activity_by_user": _pivot(
        '"User"',
        "Type",
        ["approval", "pullrequest_comment"],
        'count("Total") FILTER (WHERE {cond})',
        "csv_rows",
        '"User" <> "Author"',
    ),
    "n8_share_of_total": 'SELECT "Author", CAST(sum("Total") AS BIGINT) AS total, '
    'round(sum("Total") * 100.0 / (SELECT sum("Total") FROM csv_prs), 1) AS pct, '
    'CAST(sum("Total") AS BIGINT) AS absolute FROM csv_prs GROUP BY 1',
    # dedup
    "d1_dedup_prs": "SELECT * FROM prs_named",
    "d2_dedup_runs": "SELECT * FROM runs",
    "d3_distinct_prs": "SELECT * FROM csv_prs",
    # orders, limits, pages
    "o4_by_activity": f"SELECT activity_user AS label, {_REVIEWS} FROM rep_no_bots GROUP BY 1",
    "o7_page": f"SELECT {_TABLE_PRS} FROM prs ORDER BY pr_id LIMIT 20",
    "o7_deep_page": f"SELECT {_TABLE_PRS} FROM prs_by_repo ORDER BY pr_id, repo "
    "LIMIT 200 OFFSET 800",
    "o7_page_total": f"SELECT {_N} AS total FROM ({_first_pr('rep_filtered')}) p",
    "o8_page_count": "SELECT total, greatest(1, CAST(ceil(total / 20.0) AS BIGINT)) AS pages "
    f"FROM (SELECT {_N} AS total FROM runs WHERE creator NOT IN ('user-3','user-8') "
    "AND CAST(created_on AS TIMESTAMP) >= TIMESTAMP '2024-02-01 00:00:00' "
    "AND CAST(created_on AS TIMESTAMP) <= TIMESTAMP '2024-05-31 00:00:00' "
    f"AND repo IN {_IN_PR_REPOS} AND creator IN {_RUN_NAMES} AND environment_name <> '' "
    "AND target_ref_name IN ('main','develop') AND result_name IN ('SUCCESSFUL','FAILED')) t",
    "o9_top_creators": f"SELECT creator AS label, {_N} AS value FROM runs WHERE creator <> '' "
    "GROUP BY 1 ORDER BY value DESC, label LIMIT 15",
    "o9_top_durations": f"SELECT repo AS label, {_MEAN} AS value FROM runs "
    "WHERE duration_seconds > 0 GROUP BY 1 ORDER BY value DESC, label LIMIT 12",
    "o9_preview": "SELECT \"ID\", split_part(\"SrcRepo\", '/', 2) AS \"SrcRepo\", \"Type\", "
    '"User", "Author", substring("Updated", 1, 7) AS "DateGroup", "Total" FROM csv_rows '
    "ORDER BY 1, 2, 3, 4 LIMIT 5",
    # unions and dense grids
    "u1_concat": 'SELECT "ID", repo, "Type", CASE WHEN "Type" = \'approval\' THEN \'-\' '
    'ELSE "Description" END AS note FROM csv_rows',
    "u2_people": "SELECT author AS name FROM rep WHERE author <> 'user-3' UNION "
    "SELECT activity_user FROM rep WHERE activity_user <> 'user-3'",
    "u3_dense_frequency": "SELECT m.month, e.environment, coalesce(f.count, 0) AS count "
    "FROM (SELECT DISTINCT month FROM frequency) m "
    "CROSS JOIN (SELECT DISTINCT environment FROM frequency) e "
    "LEFT JOIN frequency f ON f.month = m.month AND f.environment = e.environment",
    # expressions
    "c1_short_repo": "SELECT repo, pr_id, repo AS two_parts, repo AS one_part, "
    "repo || '/' || state AS three_parts FROM fx_pull_requests",
    "c2_second_part": "SELECT repo, pr_id, repo AS two_parts, '(none)' AS one_part, "
    "repo AS three_parts FROM fx_pull_requests",
    "c3_day_text": "SELECT repo, pr_id, CASE WHEN state = 'DECLINED' THEN '0001-01-01' "
    "ELSE created_on END AS day FROM fx_pull_requests",
    "c4_seconds_text": "SELECT pipeline_uuid, created_on AS utc, "
    "replace(created_on, 'Z', '+05:30') AS local, completed_on AS completed FROM fx_pipelines",
    "c5_month_text": f"SELECT substring(created_on, 1, 7) AS month, {_N} AS n "
    "FROM fx_pipelines GROUP BY 1",
    "c6_duration": "SELECT DISTINCT pipeline_uuid, duration_seconds FROM ci",
    "c7_trigger_name": "SELECT pipeline_uuid, CASE trigger_type WHEN 'pipeline_trigger_push' "
    "THEN 'PUSH' WHEN 'pipeline_trigger_manual' THEN 'MANUAL' ELSE '' END AS trigger_name "
    "FROM fx_pipelines",
    "c8_url_uuid": "SELECT repo, pr_id, "
    "regexp_extract(url, '/pipelines/results/([^?#]*)', 1) AS pipeline_uuid FROM fx_pr_statuses",
    "c9_diff_line_counts": "SELECT repo, pr_id, "
    "CAST(len(list_filter(string_split(diff, chr(10)), "
    "lambda l: l LIKE '+%' AND l NOT LIKE '+++%')) AS INTEGER) AS lines_added, "
    "CAST(len(list_filter(string_split(diff, chr(10)), "
    "lambda l: l LIKE '-%' AND l NOT LIKE '---%')) AS INTEGER) AS lines_removed "
    "FROM fx_pr_diffs",
    "c10_time_or_null": "SELECT pipeline_uuid, '(none)' AS expired, "
    "CASE completed_on WHEN '' THEN '(none)' "
    "ELSE replace(completed_on, 'Z', '.25+00:00') END AS completed_on FROM fx_pipelines",
    "c11_activity_kind": "SELECT repo, CASE WHEN activity_type IN ('approval','update') "
    f"THEN activity_type ELSE 'comment' END AS kind, {_N} AS n FROM fx_pr_activity GROUP BY 1, 2",
}

# A salted join gives the rows of the plain one. Ordered results are the aggregate they order with the place of every row.
BODIES["j1_pr_activity_salted"] = BODIES["j1_pr_activity"]
BODIES["j5_run_deployments_salted"] = (
    "SELECT repo, pipeline_uuid, result_name, environment_name FROM ci"
)
BODIES["o1_by_value"] = _placed(BODIES["a3_prs_by_author"], "value DESC, label")
BODIES["o2_by_label"] = _placed(BODIES["a11_runs_by_month"], "label")
BODIES["o3_by_total"] = _placed(
    f"SELECT split_part(src_repo, '/', 2) AS label, {_CHANGES} FROM prs GROUP BY 1", "total DESC, label"
)
BODIES["o4_by_activity"] = _placed(BODIES["o4_by_activity"], "approval + comment DESC, label")
BODIES["o5_by_results"] = _placed(
    BODIES["a12_results_by_repo"], "successful + failed + error + stopped DESC, label"
)
BODIES["o6_by_month_and_ref"] = _placed(BODIES["a14_deployment_frequency"], "month, environment")
for name, text in RAW_JSON.items():
    projection, view = BODIES[name].rsplit("FROM fx_", 1)
    BODIES[name] = f"{projection.rstrip()}{text}FROM fx_{view}"


ORACLES: dict[str, str] = {name: _with(body) for name, body in BODIES.items()}
