"""Landed pages of every kind -> raw tables -> reports -> charts, run twice."""

import json

import pytest

from reviewlake.functions.diffs import diff_line_counts
from reviewlake.operators.joins import pipelines_to_resolve, status_links, step_deployments
from reviewlake.params import PipelineParams
from reviewlake.plans.charts import pipeline_charts, pr_charts
from reviewlake.plans.reports import (
    build_pipeline_report,
    build_pr_report,
    write_pipeline_report,
    write_pr_report,
)
from reviewlake.plans.tables import deployments_table, pipeline_display, pr_display, pr_table
from reviewlake.schemas import BUCKETS, PIPELINE_PARENT, RECORDS, SCHEMAS, evolve
from reviewlake.sources.pages import read_pages
from reviewlake.sources.raw import read_table
from reviewlake.sources.reports import read_pipeline_report, read_pr_report
from reviewlake.sources.store import version, write_absent, write_replace
from reviewlake.streaming.ingest import start_ingest

ANN, BOB = {"display_name": "Ann"}, {"display_name": "Bob"}
DIFF = "--- a\n+++ b\n+one\n+two\n-gone\n"


def end(repo):
    return {"branch": {"name": "main"}, "repository": {"full_name": f"ws/{repo}"}}


PAGES = {
    "pull_request": [({}, [
        {"id": 1, "title": "First", "state": "MERGED", "author": ANN, "source": end("r"),
         "destination": end("r"), "created_on": "2024-01-05T10:00:00.5+07:00",
         "updated_on": "2024-01-31T23:00:00-05:00"},
        {"id": 2, "title": "Silent", "author": BOB, "source": end("r")},
    ])],
    "activity": [({"pull_request_id": 1}, [
        {"approval": {"date": "2024-01-06T00:00:00Z", "user": BOB}},
        {"comment": {"id": 5, "type": "pullrequest_comment", "content": {"raw": "nice"}, "user": BOB}},
        {"update": {"author": ANN, "state": "OPEN"}},
    ])],
    "commit": [({"pull_request_id": 1}, [{"hash": "abc", "author": {"user": ANN}}])],
    "comment": [({"pull_request_id": 1}, [{"id": 5, "content": {"raw": "nice"}, "user": BOB}])],
    "status": [({"pull_request_id": 1}, [
        {"key": "k", "url": "https://h/w/r/pipelines/results/{run}?x=1"},
        {"key": "k2", "url": "https://h/w/r/pipelines/results/{unknown}"},
    ])],
    "pipeline": [({}, [
        {"uuid": "{run}", "build_number": 7, "creator": ANN, "target": {"ref_name": "main"},
         "trigger": {"type": "pipeline_trigger_push"},
         "state": {"name": "COMPLETED", "result": {"name": "SUCCESSFUL"}},
         "created_on": "2024-01-06T10:00:00.1Z", "completed_on": "2024-01-06T10:03:05Z",
         "expired": False},
    ])],
    "deployment": [({}, [
        {"uuid": "{dep}", "pipeline": {"uuid": "{run}"}, "environment": {"uuid": "{e}", "name": "Production"},
         "state": {"name": "COMPLETED", "status": {"name": "SUCCESSFUL"}},
         "created_on": "2024-01-06T10:02:00Z"},
    ])],
}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    for kind, pages in PAGES.items():
        folder = root / kind / "repo=r"
        folder.mkdir(parents=True)
        lines = [json.dumps({"values": values, "next": "", **head}) for head, values in pages]
        (folder / "p.json").write_text("\n".join(lines))
    return root


def test_everything_twice(spark, landed, tmp_path):
    lake = lambda t: str(tmp_path / t)
    table = lambda t: read_table(spark, lake(t), t, ["r"])
    from reviewlake.operators.projections import TABLE_OF

    for run in range(2):
        for kind in PAGES:
            checkpoint = str(tmp_path / f"chk-{run}-{kind}")
            start_ingest(
                spark, str(landed / kind), kind, lake(TABLE_OF[kind]), checkpoint
            ).awaitTermination()
        diffs = spark.createDataFrame([("r", 1, DIFF)], "repo string, pr_id long, diff string")
        rows = evolve(diff_line_counts(diffs), SCHEMAS["pr_diffstat"])
        write_replace(spark, rows, lake("pr_diffstat"), "pr_diffstat", ["r"])
        links = status_links(table("pr_statuses"))
        write_absent(spark, links, lake("pr_pipelines"), "pr_pipelines")
        report = build_pr_report(
            *(table(t) for t in ("pull_requests", "pr_activity", "pr_diffstat", "pr_pipelines", "deployments"))
        )
        write_pr_report(spark, report, lake("pr_report"), ["r"])
        runs = build_pipeline_report(table("pipelines"), table("deployments"))
        write_pipeline_report(spark, runs, lake("pipeline_report"), ["r"])
        for name, n in (("pull_requests", 2), ("pr_activity", 3), ("pr_commits", 1), ("pr_comments", 1),
                        ("pr_statuses", 2), ("pipelines", 1), ("deployments", 1), ("pr_pipelines", 2),
                        ("pr_diffstat", 1), ("pr_report", 2), ("pipeline_report", 1)):
            assert table(name).count() == n, name

    rep, ci = read_pr_report(spark, lake("pr_report")), read_pipeline_report(spark, lake("pipeline_report"))
    got = sorted(
        (r.pr_id, r.author, r.created, r.updated, r.file_changed, r.added, r.removed, r.total,
         r.activity_type, r.activity_user, r.activity_content, r.pipeline_uuid, r.environment_name,
         r.deployment_state, r.deployment_status)
        for r in rep.collect()
    )
    head = (1, "Ann", "2024-01-05", "2024-01-31", 1, 2, 1, 3)
    tail = ("{run}", "Production", "COMPLETED", "SUCCESSFUL")
    assert got == [
        (*head, "approval", "Bob", "2024-01-06", *tail),
        (*head, "pullrequest_comment", "Bob", "nice", *tail),
    ]
    charts = pr_charts(rep)
    assert tuple(charts["summary"].first()) == (1, 2, 1, 3, 1, 1)
    assert [tuple(r) for r in charts["activity_by_user"].collect()] == [("Bob", 1, 1)]
    assert tuple(pr_display(pr_table(rep).rows).first()) == (
        "#1", "r", "First", "Ann", "MERGED", "2024-01-31", "+2", "-1", "1"
    )

    params = PipelineParams(production_refs=("main",))
    assert tuple(pipeline_charts(ci, params)["summary"].first()) == (1, 1, 0, 0, 0, 185, 1, 1)
    page = deployments_table(ci, params)
    assert tuple(pipeline_display(page.rows).first()) == (
        "#7", "r", "Ann", "main", "PUSH", "COMPLETED", "SUCCESSFUL", "Production", "3m 5s", "2024-01-06"
    )
    missing = pipelines_to_resolve(table("pr_statuses"), table("pipelines"))
    assert [r.pipeline_uuid for r in missing.collect()] == ["{unknown}"]


def test_steps_lead_to_deployments(spark, rows, tmp_path):
    folder = tmp_path / "steps" / "repo=r"
    folder.mkdir(parents=True)
    page = {"pipeline_uuid": "{run}", "values": [{"uuid": "{s}", "deployment_uuid": "{dep}"}, {"uuid": "{t}"}]}
    (folder / "p.json").write_text(json.dumps(page))
    steps = read_pages(spark, str(tmp_path / "steps"), RECORDS["step"], PIPELINE_PARENT)
    deployments = rows(
        "deployments", {"repo": "r", "deployment_uuid": "{dep}", "pipeline_uuid": "{run}", "environment_name": "Prod"}
    )
    got = step_deployments(
        rows("pipelines", {"repo": "r", "pipeline_uuid": "{run}"}),
        steps,
        deployments,
        deployments.where("false"),
        ["PROD"],
    )
    assert [r.deployment_uuid for r in got.collect()] == ["{dep}"]


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(BUCKETS, "pr_pipelines", 1)
    rows = evolve(
        spark.range(0, 200_000, 1, 8).selectExpr(
            "id as pr_id", "if(id % 10 = 0, 'small', 'large') as repo", "uuid() as pipeline_uuid"
        ),
        SCHEMAS["pr_pipelines"],
    )
    path = str(tmp_path / "links")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        write_replace(spark, rows, path, "pr_pipelines", ["large", "small"])
    finally:
        spark.conf.set(key, before)
    assert len(version(spark, path, "pr_pipelines").live({"large"})) >= 4
    assert read_table(spark, path, "pr_pipelines").count() == 200_000
