import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import projections as P
from reviewlake.schemas import KEYS, RECORDS, SCHEMAS, evolve
from reviewlake.sources import store
from reviewlake.sources.csvs import export_csv, read_activity_csv
from reviewlake.sources.pages import decode_pages, read_pages
from reviewlake.sources.raw import decode_raw, read_table
from reviewlake.sources.reports import read_pipeline_report, read_pr_report
from reviewlake.streaming.ingest import start_ingest


def pr(pr_id, repo="r", title="T", **kw):
    return {"pr_id": pr_id, "repo": repo, "title": title, **kw}


def act(pr_id, repo="r", kind="approval"):
    return {"pr_id": pr_id, "repo": repo, "activity_type": kind}


def seq(df, n):
    return df.withColumn("seq", F.lit(n))


def stored(spark, path, table, *cols):
    return sorted(tuple(r) for r in read_table(spark, path, table).select(*cols).collect())


# --- frames ----------------------------------------------------------------------------------


def test_upsert_last_write_wins(rows):
    old = rows("pull_requests", pr(1), pr(2), pr(1, repo="s"))
    first = seq(rows("pull_requests", pr(1, title="one"), pr(3)), 1)
    last = seq(rows("pull_requests", pr(1, title="two")), 2)
    got = store.upsert(old, last.unionByName(first), KEYS["pull_requests"], "seq")
    assert got.columns == old.columns
    assert sorted((r.repo, r.pr_id, r.title) for r in got.collect()) == [
        ("r", 1, "two"), ("r", 2, "T"), ("r", 3, "T"), ("s", 1, "T")
    ]


def test_insert_absent(rows):
    link = lambda i, u: {"repo": "r", "pr_id": i, "pipeline_uuid": u}
    old = rows("pr_pipelines", link(1, "{a}"), link(9, "{z}"))
    new = rows("pr_pipelines", link(1, "{a}"), link(1, "{b}"), link(1, "{b}"), link(2, "{a}"))
    got = store.insert_absent(old, new, KEYS["pr_pipelines"])
    assert sorted((r.pr_id, r.pipeline_uuid) for r in got.collect()) == [(1, "{b}"), (2, "{a}")]


def test_replace_partition_frame(rows):
    old = rows("pr_activity", act(1), act(2), act(3, "s"), act(4, "t"))
    new = rows("pr_activity", act(7), act(8, "t"))
    got = store.replace_partition(old, new, ["r", "s"])
    assert sorted((r.repo, r.pr_id) for r in got.collect()) == [("r", 7), ("t", 4)]


# --- writers ---------------------------------------------------------------------------------


def test_write_upsert_twice_is_the_same(spark, rows, tmp_path):
    path = str(tmp_path / "prs")
    for _ in range(2):
        store.write_upsert(spark, seq(rows("pull_requests", pr(1), pr(2, "s")), 1), path, "pull_requests")
    assert stored(spark, path, "pull_requests", "repo", "pr_id", "title") == [("r", 1, "T"), ("s", 2, "T")]
    batch = seq(rows("pull_requests", pr(1, title="new"), pr(5)), 2)
    for _ in range(2):
        store.write_upsert(spark, batch, path, "pull_requests")
    assert stored(spark, path, "pull_requests", "repo", "pr_id", "title") == [
        ("r", 1, "new"), ("r", 5, "T"), ("s", 2, "T")
    ]


def many(rows, n, **kw):
    return rows("pull_requests", *(pr(i, **kw) for i in range(n)))


def files(spark, path, table):
    return {f.file for f in store.version(spark, path, table).live()}


def test_ten_changed_rows_rewrite_their_buckets_only(spark, rows, tmp_path):
    path = str(tmp_path / "prs")
    store.write_upsert(spark, seq(many(rows, 400).unionByName(many(rows, 400, repo="s")), 1), path, "pull_requests", buckets=16)
    before = store.version(spark, path, "pull_requests").live()
    assert {(f.repo, f.bucket) for f in before} == {(r, b) for r in "rs" for b in range(16)}
    assert sum(f.rows for f in before) == 800
    batch = seq(rows("pull_requests", *(pr(i, title="new") for i in (3, 4))), 2)
    store.write_upsert(spark, batch, path, "pull_requests")
    after = store.version(spark, path, "pull_requests").live()
    changed = {f for f in before if f not in after}
    assert 1 <= len(changed) <= 2 and all(f.repo == "r" for f in changed)
    assert {(f.repo, f.bucket) for f in set(after) - set(before)} == {(f.repo, f.bucket) for f in changed}
    got = stored(spark, path, "pull_requests", "repo", "pr_id", "title")
    assert got == [(r, i, "new" if r == "r" and i in (3, 4) else "T") for r in "rs" for i in range(400)]


def test_an_upsert_opens_only_buckets_of_its_keys(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "prs")
    store.write_upsert(spark, seq(many(rows, 200), 1), path, "pull_requests", buckets=16)
    opened = []
    read = store.versions.read_files
    monkeypatch.setattr(store.versions, "read_files", lambda spark, path, table, files: read(spark, path, table, opened.append(list(files)) or opened[-1]))
    store.write_upsert(spark, seq(rows("pull_requests", pr(7, title="new")), 2), path, "pull_requests")
    (some,) = opened
    assert len(some) == 1 and some[0].rows < 40


@pytest.mark.parametrize("step", ["add_files", "commit"])
def test_a_write_stopped_at_any_step_leaves_the_old_rows(spark, rows, tmp_path, monkeypatch, step):
    path = str(tmp_path / "prs")
    store.write_upsert(spark, seq(rows("pull_requests", pr(1), pr(2), pr(3, "s")), 1), path, "pull_requests")
    batch = seq(rows("pull_requests", pr(2, title="new")), 2)
    real = getattr(store.versions, step)

    def stop(*args, **kw):
        if step == "add_files":
            real(*args, **kw)  # files are there, no manifest names them
        else:  # a commit that began: a folder without its file
            (tmp_path / "prs" / "manifest" / "v=2" / "_temporary").mkdir(parents=True)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(store.versions, step, stop)
    with pytest.raises(RuntimeError):
        store.write_upsert(spark, batch, path, "pull_requests")
    monkeypatch.setattr(store.versions, step, real)
    assert stored(spark, path, "pull_requests", "repo", "pr_id", "title") == [("r", 1, "T"), ("r", 2, "T"), ("s", 3, "T")]
    for _ in range(2):
        store.write_upsert(spark, batch, path, "pull_requests")
        assert stored(spark, path, "pull_requests", "repo", "pr_id", "title") == [("r", 1, "T"), ("r", 2, "new"), ("s", 3, "T")]


def test_compact_and_vacuum(spark, rows, tmp_path):
    path = str(tmp_path / "links")
    link = lambda i: {"repo": "r", "pr_id": i, "pipeline_uuid": "{a}"}
    for i in range(6):
        store.write_absent(spark, rows("pr_pipelines", *(link(k) for k in range(10 * i, 10 * i + 10))), path, "pr_pipelines")
    many_files = files(spark, path, "pr_pipelines")
    store.compact(spark, path, "pr_pipelines", files=2)
    few = files(spark, path, "pr_pipelines")
    assert len(few) < len(many_files)
    want = [(i,) for i in range(60)]
    assert stored(spark, path, "pr_pipelines", "pr_id") == want
    assert store.versions.vacuum(spark, path, "pr_pipelines", keep=1) == len(many_files - few)
    assert stored(spark, path, "pr_pipelines", "pr_id") == want
    assert store.versions.vacuum(spark, path, "pr_pipelines", keep=1) == 0
    on_disk = {str(p.relative_to(path)) for p in (tmp_path / "links" / "data").rglob("*.parquet")}
    assert on_disk == few


def test_odd_names_of_repositories(spark, rows, tmp_path):
    path, names = str(tmp_path / "prs"), ["a/b c", "x=1", "100%", "{v}*[0]?", "é#:", "2024-01-01", "007"]
    for n in (1, 2):
        store.write_upsert(spark, seq(rows("pull_requests", *(pr(n, r, title=f"{n}") for r in names)), n), path, "pull_requests")
    assert stored(spark, path, "pull_requests", "repo", "pr_id") == sorted((r, n) for r in names for n in (1, 2))
    assert [r.repo for r in read_table(spark, path, "pull_requests", ["{v}*[0]?"]).collect()] == ["{v}*[0]?"] * 2


def run_rows(rows, run, *dicts):
    return rows("pr_comments", *dicts).withColumn("run", F.lit(run))


def test_runs_replace_when_they_end(spark, rows, tmp_path):
    path = str(tmp_path / "comments")
    note = lambda i, repo="r": {"repo": repo, "pr_id": 1, "comment_id": i}
    write = lambda run, batch, ended, *d: store.write_run(
        spark, run_rows(rows, run, *d) if d else run_rows(rows, run, note(0)).where("false"), path, "pr_comments", batch, ended
    )
    show = lambda: stored(spark, path, "pr_comments", "repo", "comment_id")
    write("run-1", 0, [("r", "run-1"), ("s", "run-1")], note(1), note(2), note(3, "s"))
    old = [("r", 1), ("r", 2), ("s", 3)]
    assert show() == old
    write("run-2", 1, [], note(10), note(11))
    write("run-2", 2, [], note(12))
    write("run-2", 2, [], note(12))  # delivered again
    assert show() == old  # not ended
    for _ in range(2):
        write("run-2", 3, [("r", "run-2"), ("s", "run-2")], note(13))
        assert show() == [("r", i) for i in (10, 11, 12, 13)]  # s ends empty
    write("run-3", 4, [], note(99))  # never ends
    write("run-4", 5, [("r", "run-4")], note(20))
    assert show() == [("r", 20)]
    assert all(f.live for f in store.version(spark, path, "pr_comments").files)


def test_write_absent_appends_only_new(spark, rows, tmp_path):
    path = str(tmp_path / "links")
    link = lambda i, u: {"repo": "r", "pr_id": i, "pipeline_uuid": u}
    for _ in range(2):
        store.write_absent(spark, rows("pr_pipelines", link(1, "{a}"), link(1, "{a}")), path, "pr_pipelines")
    store.write_absent(spark, rows("pr_pipelines", link(1, "{a}"), link(2, "{a}")), path, "pr_pipelines")
    assert stored(spark, path, "pr_pipelines", "pr_id", "pipeline_uuid") == [(1, "{a}"), (2, "{a}")]


def test_write_replace_with_rows_and_without(spark, rows, tmp_path):
    path = str(tmp_path / "activity")
    write = lambda repos, *d: store.write_replace(
        spark, rows("pr_activity", *d) if d else rows("pr_activity", act(0)).where("false"), path, "pr_activity", repos
    )
    write(["r", "a/b c"], act(1), act(2), act(3, "a/b c"))
    assert stored(spark, path, "pr_activity", "repo", "pr_id") == [("a/b c", 3), ("r", 1), ("r", 2)]
    for _ in range(2):
        write(["r"], act(9))
        assert stored(spark, path, "pr_activity", "repo", "pr_id") == [("a/b c", 3), ("r", 9)]
    write(["a/b c"])
    assert stored(spark, path, "pr_activity", "repo", "pr_id") == [("r", 9)]
    write(["r"])
    write(["never-stored"])
    assert store.version(spark, path, "pr_activity").number == 6


def test_numeric_repository_names_stay_text(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    store.write_replace(spark, rows("pr_activity", act(1, "007")), path, "pr_activity", ["007"])
    assert stored(spark, path, "pr_activity", "repo") == [("007",)]


def test_reports_read_back_with_parsed_times(spark, rows, tmp_path):
    report = rows("pr_report", {"repo": "r", "pr_id": 1, "created": "2024-01-02", "updated": "junk"})
    path = str(tmp_path / "rep")
    store.write_replace(spark, report, path, "pr_report", ["r"])
    r = read_pr_report(spark, path).first()
    assert (r.created_date, r.updated_date, r.environment_name) == (dt.date(2024, 1, 2), dt.date(1, 1, 1), "")
    runs = rows("pipeline_report", {"repo": "r", "pipeline_uuid": "{a}", "created_on": "2024-01-01T02:00:00+02:00"})
    path = str(tmp_path / "runs")
    store.write_replace(spark, runs, path, "pipeline_report", ["r"])
    r = read_pipeline_report(spark, path).select(F.unix_seconds("created_ts"), F.year("completed_ts")).first()
    assert tuple(r) == (1704067200, 1)


def test_columns_added_later_read_as_zero(spark, rows, tmp_path):
    old = rows("pr_report", {"repo": "r", "pr_id": 1}).drop("pipeline_uuid", "deployment_status")
    path = str(tmp_path / "old")
    old.write.partitionBy("repo").parquet(path)
    r = read_table(spark, path, "pr_report").first()
    assert (r.pipeline_uuid, r.deployment_status) == ("", "")
    assert evolve(old, SCHEMAS["pr_report"]).first().pipeline_uuid == ""
    assert [f.name for f in SCHEMAS["pr_report"]] == evolve(old, SCHEMAS["pr_report"]).columns


def test_csv_export_round_trip(spark, rows, tmp_path):
    texts = ['line one\nline "two"', "comma, too", "plain", "NA"]
    report = rows(
        "pr_report",
        *({"repo": "r", "pr_id": i, "title": t, "updated": "2024-01-02", "author": "A", "total": i} for i, t in enumerate(texts)),
    )
    path = str(tmp_path / "csv")
    export_csv(report, path, rows_per_file=2)
    got = {r.ID: r for r in read_activity_csv(spark, path).collect()}
    assert [got[i].Title for i in range(4)] == [*texts[:3], None]
    assert got[1].Updated == dt.datetime(2024, 1, 2) and got[3].Total == 3
    assert got[0].User is None and got[0].Created is None


# --- pages and projections -------------------------------------------------------------------


def page(values, **kw):
    return json.dumps({"values": values, "next": "", **kw})


def test_pages_flatten_and_copy_the_parent_id(spark, tmp_path):
    d = tmp_path / "pages" / "repo=r"
    d.mkdir(parents=True)
    lines = [page([{"lines_added": 1}, {"lines_added": 2}], pull_request_id=5), page([]), page([{"lines_added": 3}], pull_request_id=6)]
    (d / "p.json").write_text("\n".join(lines))
    got = read_pages(spark, str(tmp_path / "pages"), RECORDS["diffstat"]).collect()
    assert sorted((r.repo, r.pull_request_id, r.lines_added) for r in got) == [("r", 5, 1), ("r", 5, 2), ("r", 6, 3)]
    texts = spark.createDataFrame([("s", lines[0])], "place string, value string")
    got = decode_pages(texts, RECORDS["diffstat"]).collect()
    assert [(r.place, r.pull_request_id, r.lines_added) for r in got] == [("s", 5, 1), ("s", 5, 2)]


def test_malformed_json_stops_the_job(spark, tmp_path):
    (tmp_path / "p.json").write_text(page([{"id": 1}]) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_pages(spark, str(tmp_path), RECORDS["comment"]).collect()
    texts = spark.createDataFrame([("r", 1, '{"id": "x"')], "repo string, pr_id long, raw_json string")
    with pytest.raises(Exception, match="(?i)malformed"):
        decode_raw(texts, RECORDS["comment"]).collect()


def decoded(spark, kind, *records, **kw):
    texts = [("r", kw.get("pr_id", 1), json.dumps(r)) for r in records]
    df = spark.createDataFrame(texts, "repo string, pr_id long, raw_json string")
    return decode_raw(df, RECORDS[kind]).withColumnRenamed("pr_id", "pull_request_id")


def test_missing_fields_become_zero_values(spark):
    (r,) = P.pull_requests(decoded(spark, "pull_request", {"id": 7})).collect()
    assert (r.pr_id, r.title, r.comment_count, r.author_uuid) == (7, "", 0, "")
    assert (r.created_on, r.updated_on) == ("0001-01-01", "0001-01-01")
    assert (r.reviewers, json.loads(r.raw_json)) == ("null", {"id": 7})
    (r,) = P.pr_commits(P.stamp_parent(decoded(spark, "commit", {"hash": "h"}))).collect()
    assert (r.pr_id, r.hash, r.date) == (1, "h", "")
    (r,) = P.pr_comments(P.stamp_parent(decoded(spark, "comment", {"id": 3}))).collect()
    assert (r.deleted, r.parent_id, r.created_on) == (False, 0, "0001-01-01T00:00:00Z")


def test_activity_kinds_and_parent_id(spark):
    person = {"display_name": "Bob", "uuid": "{b}"}
    records = [
        {"comment": {"id": 4, "type": "pullrequest_comment", "content": {"raw": "x"}, "user": person,
                     "created_on": "2024-01-01T00:00:00.5+00:00"},
         "approval": {"user": person}, "pull_request": {"id": 9}},
        {"approval": {"date": "2024-02-01T00:00:00Z", "user": person}},
        {"update": {"author": person}, "pull_request": {"id": 0}},
        {"comment": {"user": {"display_name": ""}}},
    ]
    flat = P.pr_activity(P.stamp_activity_parent(decoded(spark, "activity", *records)))
    got = sorted((r.activity_type, r.pr_id, r.user_display_name, r.comment_id, r.comment_content_raw, r.comment_created_on, r.approval_date) for r in flat.collect())
    assert got == [
        ("approval", 1, "Bob", 0, "", "", "2024-02-01T00:00:00Z"),
        ("pullrequest_comment", 9, "Bob", 4, "x", "2024-01-01T00:00:00Z", ""),
        ("update", 1, "", 0, "", "", ""),
        ("update", 1, "Bob", 0, "", "", ""),
    ]


def test_pipeline_and_deployment_records(spark):
    run = {
        "uuid": "{run-nightly}", "build_number": 41, "run_number": 2, "creator": {"display_name": "Nadia"},
        "target": {"ref_type": "tag", "ref_name": "nightly/41"}, "trigger": {"type": "pipeline_trigger_schedule"},
        "state": {"name": "COMPLETED", "result": {"name": "STOPPED"}},
        "created_on": "2022-11-30T23:59:59.987+00:00", "completed_on": None, "build_seconds_used": 61,
    }
    (r,) = P.pipelines(decoded(spark, "pipeline", run)).collect()
    assert (r.pipeline_uuid, r.build_number, r.trigger_name, r.result_name) == ("{run-nightly}", 41, "SCHEDULE", "STOPPED")
    assert (r.created_on, r.completed_on, r.target_ref_name) == ("2022-11-30T23:59:59Z", "", "nightly/41")
    dep = {
        "uuid": "{to-test}", "state": {"name": "UNDEPLOYED", "status": {"name": "FAILED"}, "completed_on": "2022-12-01T00:10:20.5Z"},
        "pipeline": {"uuid": "{run-nightly}"}, "environment": {"uuid": "{env}", "name": "Test bench"},
        "release": {"name": ""}, "created_on": "2022-12-01T00:00:01Z",
    }
    (r,) = P.deployments(decoded(spark, "deployment", dep)).collect()
    assert (r.status_name, r.environment_name, r.release_name) == ("FAILED", "Test bench", "")
    assert (r.created_on, r.completed_on) == ("2022-12-01T00:00:01Z", "2022-12-01T00:10:20Z")


# --- streaming -------------------------------------------------------------------------------


def land(root, repo, name, *records, mtime=None, **kw):
    d = root / f"repo={repo}"
    d.mkdir(parents=True, exist_ok=True)
    f = d / name
    f.write_text(page(list(records), **kw))
    if mtime:
        import os

        os.utime(f, (mtime, mtime))


def test_stream_upserts_across_batches(spark, tmp_path):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    run = lambda: start_ingest(spark, str(src), "pull_request", out, chk).awaitTermination()
    land(src, "r", "a.json", {"id": 1, "title": "old"}, {"id": 2, "title": "keep"}, mtime=1_700_000_000)
    land(src, "r", "b.json", {"id": 1, "title": "newer"}, mtime=1_700_000_100)
    run()
    assert stored(spark, out, "pull_requests", "pr_id", "title") == [(1, "newer"), (2, "keep")]
    land(src, "s", "c.json", {"id": 1, "title": "other"})
    land(src, "r", "d.json", {"id": 2, "title": "changed"})
    run()
    run()
    assert stored(spark, out, "pull_requests", "repo", "pr_id", "title") == [
        ("r", 1, "newer"), ("r", 2, "changed"), ("s", 1, "other")
    ]


def test_stream_replaces_children(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    run = lambda: start_ingest(spark, str(src), "comment", out).awaitTermination()
    land(src, "r", "a.json", {"id": 1}, {"id": 2}, pull_request_id=5)
    land(src, "s", "a.json", {"id": 3}, pull_request_id=6)
    run()
    assert stored(spark, out, "pr_comments", "repo", "pr_id", "comment_id") == [("r", 5, 1), ("r", 5, 2), ("s", 6, 3)]
    land(src, "r", "b.json", {"id": 9}, pull_request_id=7)
    run()
    assert stored(spark, out, "pr_comments", "repo", "pr_id", "comment_id") == [("r", 7, 9), ("s", 6, 3)]


def test_stream_runs_over_three_batches(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", str(tmp_path / "out")
    from reviewlake.streaming import ingest

    seen = []
    real = ingest.write_run
    monkeypatch.setattr(ingest, "write_run", lambda *a: (seen.append(a[4]), real(*a))[1])
    run = lambda: start_ingest(spark, str(src), "comment", out, files_per_batch=1, runs=True).awaitTermination()
    at = 1_700_000_000
    for n, repo in enumerate(("r", "r", "s")):
        land(src, repo, f"a{n}.json", {"id": n}, pull_request_id=5, run="2024-01-01", mtime=at + n)
    for n, repo in enumerate("rs"):
        land(src, repo, f"end{n}.json", run="2024-01-01", run_end=True, mtime=at + 10 + n)
    run()
    assert len(seen) == 5
    assert stored(spark, out, "pr_comments", "repo", "pr_id", "comment_id") == [("r", 5, 0), ("r", 5, 1), ("s", 5, 2)]
    land(src, "r", "b0.json", {"id": 7}, {"id": 8}, pull_request_id=6, run="2024-01-02", mtime=at + 20)
    land(src, "s", "b1.json", run="2024-01-02", run_end=True, mtime=at + 21)
    run()
    assert stored(spark, out, "pr_comments", "repo", "comment_id") == [("r", 0), ("r", 1)]  # r goes on, s ended empty
    land(src, "r", "b2.json", {"id": 9}, pull_request_id=6, run="2024-01-02", run_end=True, mtime=at + 22)
    run()
    assert stored(spark, out, "pr_comments", "repo", "comment_id") == [("r", 7), ("r", 8), ("r", 9)]


def test_stream_sets_bad_records_aside(spark, tmp_path):
    src, out, bad = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "bad")
    run = lambda: start_ingest(spark, str(src), "pull_request", out, rejected=bad).awaitTermination()
    land(src, "r", "a.json", {"id": 1, "title": "good"}, {"id": "none", "title": "odd"}, mtime=1_700_000_000)
    (src / "repo=r" / "b.json").write_text('{"values": [{"id"')
    run()
    assert stored(spark, out, "pull_requests", "repo", "pr_id", "title") == [("r", 1, "good")]
    rows = spark.read.parquet(bad).select("repo", "reject_reason", "reject_text").collect()
    assert sorted((r.repo, r.reject_reason) for r in rows) == [("r", "page"), ("r", "record")]
    land(src, "r", "c.json", {"id": 1, "title": "later"})
    run()
    assert stored(spark, out, "pull_requests", "repo", "pr_id", "title") == [("r", 1, "later")]
    with pytest.raises(ValueError):
        start_ingest(spark, str(src), "comment", out, runs=True, rejected=bad)


@pytest.mark.parametrize("record, key", [("pipeline", "pipeline_uuid"), ("deployment", "deployment_uuid")])
def test_stream_upserts_runs_over_stored_rows(spark, tmp_path, record, key):
    from reviewlake.operators.projections import TABLE_OF

    src, out = tmp_path / "in", str(tmp_path / "out")
    run = lambda: start_ingest(spark, str(src), record, out).awaitTermination()
    land(src, "r", "a.json", *({"uuid": f"{{{i}}}", "state": {"name": "OPEN"}} for i in range(30)), mtime=1_700_000_000)
    run()
    land(src, "r", "b.json", {"uuid": "{3}", "state": {"name": "DONE"}}, {"uuid": "{x}", "state": {"name": "NEW"}}, mtime=1_700_000_100)
    run()
    got = stored(spark, out, TABLE_OF[record], key, "state_name")
    assert got == sorted([(f"{{{i}}}", "DONE" if i == 3 else "OPEN") for i in range(30)] + [("{x}", "NEW")])


@pytest.mark.parametrize("table", ["pull_requests", "pr_report", "pipeline_report", "deployments"])
def test_schemas_have_no_duplicate_columns(table):
    names = SCHEMAS[table].names
    assert len(names) == len(set(names))


def test_runs_move_pages_once_and_not_their_rows(spark, tmp_path, monkeypatch):
    """Staged rows come from one exchange, before the records are parsed, and lie in one file a small repository."""
    from reviewlake.sources import versions
    from reviewlake.streaming import ingest

    src, out, moved = tmp_path / "in", str(tmp_path / "out"), []
    for n in range(12):
        records = [{"id": n * 10 + i, "content": {"raw": "note " * 40}} for i in range(10)]
        land(src, "rs"[n % 2], f"a{n}.json", *records, *records[:1], pull_request_id=12 - n, run="1")
    land(src, "r", "z.json", run="1", run_end=True)
    real = versions.add_files

    def added(df, *rest, spread=True, **kw):
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved.append((spread, plan.count("Exchange "), plan.index("Exchange ") > plan.index("Generate explode")))
        return real(df, *rest, spread=spread, **kw)

    monkeypatch.setattr(versions, "add_files", added)
    ingest.start_ingest(spark, str(src), "comment", out, runs=True).awaitTermination()
    assert moved == [(False, 1, True)]  # plans name what runs first last
    got = stored(spark, out, "pr_comments", "repo", "pr_id", "comment_id")
    assert got == sorted(("r", 12 - n, i) for n in range(0, 12, 2) for i in [*range(n * 10, n * 10 + 10), n * 10])
    files = store.version(spark, out, "pr_comments").files
    assert sorted((f.repo, f.live, f.rows) for f in files) == [("r", True, 66), ("s", False, 66)]  # the run of s goes on
