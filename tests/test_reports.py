import datetime as dt

import pytest

from reviewlake.operators.joins import (
    diff_totals,
    join_deployments,
    join_link_deployment,
    new_keys,
    status_links,
    step_deployments,
)
from reviewlake.operators.skew import join_pieces, with_unmatched
from reviewlake.plans.reports import build_pipeline_report, build_pr_report
from reviewlake.sources.raw import pr_link_lists

PR = {"repo": "r", "pr_id": 1, "title": "T", "author_display_name": "Ann", "src_repo": "ws/r",
      "created_on": "2024-01-01", "updated_on": "2024-01-02"}
APPROVAL = {"repo": "r", "pr_id": 1, "activity_type": "approval", "user_display_name": "Bob",
            "approval_date": "2024-01-03T01:00:00+09:00"}
COMMENT = {"repo": "r", "pr_id": 1, "activity_type": "pullrequest_comment",
           "user_display_name": "Cy", "comment_content_raw": "hm"}
UPDATE = {"repo": "r", "pr_id": 1, "activity_type": "update", "user_display_name": "Ann"}


def report(rows, prs=(PR,), activity=(APPROVAL,), diffs=(), links=(), deployments=(), **kw):
    return build_pr_report(
        rows("pull_requests", *prs),
        rows("pr_activity", *activity),
        rows("pr_diffstat", *diffs),
        rows("pr_pipelines", *links),
        rows("deployments", *deployments),
        **kw,
    ).collect()


def test_report_has_one_row_per_approval_or_comment(rows):
    got = report(rows, activity=(APPROVAL, COMMENT, UPDATE))
    assert sorted((r.activity_type, r.activity_user, r.activity_content) for r in got) == [
        ("approval", "Bob", "2024-01-03"),
        ("pullrequest_comment", "Cy", "hm"),
    ]
    assert report(rows, activity=(UPDATE,)) == []


def test_unknown_pull_requests_and_silent_ones_drop_out(rows):
    prs = (PR, {**PR, "pr_id": 20})
    activity = (APPROVAL, APPROVAL, {**APPROVAL, "pr_id": 999}, {**APPROVAL, "repo": "other"})
    assert [r.pr_id for r in report(rows, prs=prs, activity=activity)] == [1, 1]


def test_diff_totals_and_missing_diffs(rows):
    diffs = (
        {"repo": "r", "pr_id": 1, "lines_added": 10, "lines_removed": 3},
        {"repo": "r", "pr_id": 1, "lines_added": 5, "lines_removed": 1},
        {"repo": "other", "pr_id": 1, "lines_added": 99, "lines_removed": 9},
    )
    (r,) = report(rows, diffs=diffs)
    assert (r.file_changed, r.added, r.removed, r.total) == (2, 15, 4, 19)
    (r,) = report(rows)
    assert (r.file_changed, r.added, r.removed, r.total) == (0, 0, 0, 0)


def test_diff_totals_beyond_int(rows):
    diffs = [{"repo": "r", "pr_id": 1, "lines_added": 2**31 - 1, "lines_removed": 1}] * 3
    assert diff_totals(rows("pr_diffstat", *diffs)).first().total == 3 * 2**31


def test_smallest_link_and_newest_deployment(rows):
    links = [{"repo": "r", "pr_id": 1, "pipeline_uuid": u} for u in ("{b}", "{a}")]
    dep = {"repo": "r", "pipeline_uuid": "{a}", "state_name": "COMPLETED"}
    deployments = [
        {**dep, "deployment_uuid": "{1}", "environment_name": "old", "created_on": "2024-01-01"},
        {**dep, "deployment_uuid": "{2}", "environment_name": "tie", "created_on": "2024-01-02"},
        {**dep, "deployment_uuid": "{3}", "environment_name": "new", "created_on": "2024-01-02"},
        {**dep, "repo": "x", "environment_name": "other", "created_on": "2025-01-01"},
    ]
    (r,) = report(rows, links=links, deployments=deployments)
    assert (r.pipeline_uuid, r.environment_name, r.deployment_state) == ("{a}", "new", "COMPLETED")
    (r,) = report(rows, links=links)
    assert (r.pipeline_uuid, r.environment_name, r.deployment_status) == ("{a}", "", "")
    (r,) = report(rows)
    assert r.pipeline_uuid == ""


def test_report_of_requested_repos_only(rows):
    prs = (PR, {**PR, "repo": "s"})
    activity = (APPROVAL, {**APPROVAL, "repo": "s"})
    assert [r.repo for r in report(rows, prs=prs, activity=activity, repos=["s"])] == ["s"]


RUN = {"repo": "r", "pipeline_uuid": "{a}", "created_on": "2024-01-01T10:00:00Z",
       "completed_on": "2024-01-01T10:01:00Z", "build_seconds_used": 5}


@pytest.mark.parametrize("pieces", [None, 3])
def test_pipeline_report_keeps_runs_without_deployment(rows, pieces):
    deps = [
        {"repo": "r", "pipeline_uuid": "{a}", "environment_name": e, "status_name": "SUCCESSFUL"}
        for e in ("Staging", "Production")
    ] + [{"repo": "x", "pipeline_uuid": "{a}", "environment_name": "other"}]
    runs = (RUN, {**RUN, "pipeline_uuid": "{b}", "completed_on": ""})
    got = build_pipeline_report(rows("pipelines", *runs), rows("deployments", *deps), pieces=pieces)
    assert sorted(
        (r.pipeline_uuid, r.environment_name, r.deployment_status, r.duration_seconds)
        for r in got.collect()
    ) == [
        ("{a}", "Production", "SUCCESSFUL", 60),
        ("{a}", "Staging", "SUCCESSFUL", 60),
        ("{b}", "", "", 5),
    ]


# --- hot keys --------------------------------------------------------------------------------


@pytest.fixture
def skewed(spark):
    """A third of the rows under one key, most of them identical copies."""
    hot = spark.range(0, 1000, 1, 4).selectExpr("'r' as repo", "1L as pr_id", "'same' as v")
    cold = spark.range(0, 2000, 1, 4).selectExpr(
        "'r' as repo", "10 + id % 500 as pr_id", "cast(id as string) as v"
    )
    return hot.unionByName(cold)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_in_pieces_equals_plain_join(spark, skewed, how):
    keys = ["repo", "pr_id"]
    unique = spark.range(0, 400).selectExpr("'r' as repo", "id as pr_id", "id * 2 as w")
    plain, cut = skewed.join(unique, keys, how), join_pieces(skewed, unique, keys, 7, how)
    assert cut.columns == plain.columns
    assert plain.exceptAll(cut).count() == 0 and cut.exceptAll(plain).count() == 0


def test_unmatched_rows_join_the_inner_ones(spark, skewed):
    keys = ["repo", "pr_id"]
    unique = spark.range(0, 700).selectExpr("'r' as repo", "id as pr_id", "id * 2 as w")
    outer = skewed.join(unique, keys, "right")
    both = with_unmatched(skewed.join(unique, keys), skewed, unique, keys).select(outer.columns)
    assert outer.exceptAll(both).count() == 0 and both.exceptAll(outer).count() == 0


def test_link_lists_in_parts(spark):
    links = spark.range(0, 1000).selectExpr(
        "'r' as repo", "if(id < 600, 1L, id) as pr_id", "concat('{', id, '}') as pipeline_uuid"
    )
    hot = [r for r in pr_link_lists(links, parts=4).collect() if r.pr_id == 1]
    assert sorted(r.part for r in hot) == [0, 1, 2, 3] and max(len(r.pipeline_uuids) for r in hot) < 300
    assert sorted(u for r in hot for u in r.pipeline_uuids) == sorted("{%d}" % i for i in range(600))
    plain = pr_link_lists(links).collect()
    assert len(plain) == 401 and all(r.part == 0 for r in plain)


def test_report_is_the_same_in_pieces(rows):
    activity = [{**COMMENT, "comment_content_raw": str(i % 4)} for i in range(30)] + [APPROVAL]
    plain, cut = (report(rows, activity=activity, pieces=n) for n in (None, 5))
    assert sorted(map(str, plain)) == sorted(map(str, cut)) and len(plain) == 31


# --- other joins -----------------------------------------------------------------------------


def test_shared_pipeline_deployment_lookup(rows):
    links = rows("pr_pipelines", *({"repo": "r", "pr_id": i, "pipeline_uuid": "{a}"} for i in range(5)))
    deps = rows("deployments", {"repo": "r", "pipeline_uuid": "{a}", "environment_name": "P"})
    got = join_link_deployment(links, deps).collect()
    assert sorted(r.pr_id for r in got) == [0, 1, 2, 3, 4]
    assert {r.environment_name for r in got} == {"P"}


def test_new_keys(spark):
    cand = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("s", "a")], "repo string, u string")
    stored = spark.createDataFrame([("r", "a"), ("r", "zzz")], "repo string, u string")
    assert sorted(map(tuple, new_keys(cand, stored, ["repo", "u"]).collect())) == [("r", "b"), ("s", "a")]


def test_status_links(rows):
    urls = ["http://h/pipelines/results/{a}", "http://h/pipelines/results/{a}?x", "http://h/none"]
    got = status_links(rows("pr_statuses", *({"repo": "r", "pr_id": 1, "url": u} for u in urls)))
    assert [tuple(r) for r in got.collect()] == [("r", 1, "{a}")]


def test_step_deployments(spark, rows):
    runs = rows("pipelines", *({"repo": "r", "pipeline_uuid": u} for u in ("{a}", "{b}", "{c}")))
    steps = spark.createDataFrame(
        [("r", "{a}", "{d1}"), ("r", "{a}", ""), ("r", "{b}", "{d2}"), ("r", "{c}", "{d3}")],
        "repo string, pipeline_uuid string, deployment_uuid string",
    )
    deps = rows(
        "deployments",
        *(
            {"repo": "r", "deployment_uuid": d, "environment_name": e, "pipeline_uuid": p}
            for d, e, p in (("{d1}", "Prod", "{a}"), ("{d2}", "Test", "{b}"), ("{d3}", "PROD", "{c}"))
        ),
    )
    stored = rows("deployments", {"repo": "r", "deployment_uuid": "{x}", "pipeline_uuid": "{c}"})
    got = step_deployments(runs, steps, deps, stored, ["prod"])
    assert [r.deployment_uuid for r in got.collect()] == ["{d1}"]
    got = step_deployments(runs, steps, deps, stored)
    assert sorted(r.deployment_uuid for r in got.collect()) == ["{d1}", "{d2}"]


def test_deployments_of_unknown_pipelines_are_left_out(rows):
    deps = rows("deployments", {"repo": "r", "pipeline_uuid": "{zz}"})
    assert join_deployments(rows("pipelines", RUN).drop("state_name", "raw_json"), deps).count() == 1


def test_rebuilds_join_the_report_once(spark, tmp_path, monkeypatch):
    """Both rebuilds write rows that were joined before; repeated orders and lines and rows without keys are whole."""
    from reviewlake import catalog, fixtures

    day, plans, real = dt.datetime(1995, 3, 4), [], catalog.write_pr_report
    tables = {
        "orders": [(n % 60, n, "FOP"[n % 3], day, "high") for n in range(65)] + [(None, 1, "F", day, "low")],
        "lineitem": [(n % 50, n, n % 7, n % 5, 2.0, "ANR"[n % 3], "OF"[n % 2], day) for n in range(300)] + [(None, 1, 1, 1, 1.0, "A", "F", day)],
        "events": [(n, day, n, ("purchase", "view", "click")[n % 3], 1.0) for n in range(90)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, fixtures.SOURCES[name]).write.parquet(str(tmp_path / f"{name}.parquet"))

    def seen(session, report, *rest):
        plans.append(report._jdf.queryExecution().executedPlan().toString())
        real(session, report, *rest)

    monkeypatch.setattr(catalog, "write_pr_report", seen)
    got = catalog.QUERIES["k4_pr_report_rebuild"](spark, str(tmp_path))
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    want = fixtures.pr_report(spark, str(tmp_path))
    key = lambda r: tuple(str(v) for v in r)
    assert got.columns == want.columns and sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert got.count() > 200
