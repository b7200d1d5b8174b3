"""Landed texts stay whole; CSV texts and layouts; durations and pivots without limits."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewlake import fixtures
from reviewlake.functions.times import duration_seconds
from reviewlake.operators.pivots import activity_pivot
from reviewlake.streaming.ingest import flatten
from reviewlake.schemas import RECORDS
from reviewlake.sources.csvs import EXPORT_COLUMNS, export_csv, read_activity_csv
from reviewlake.sources.pages import read_pages, sorted_out, split_rejected
from reviewlake.sources.raw import decode_raw


def test_unknown_fields_of_a_landed_record_are_kept(spark, tmp_path):
    record = {"id": 71, "title": "Tidy ", "reason": "late", "links": {"self": {"href": "h"}}, "source": {"commit": {"hash": "f00"}}}
    page = {"repo": "north", "values": [record], "next": ""}
    (tmp_path / "p.json").write_text(json.dumps(page) + "\n")
    rows = read_pages(spark, str(tmp_path), RECORDS["pull_request"])
    stored = flatten(rows, "pull_request")
    assert json.loads(stored.first().raw_json) == record
    parsed = decode_raw(stored, RECORDS["pull_request"]).withColumn("pr_id", F.col("id"))
    again = flatten(parsed, "pull_request")
    assert json.loads(again.first().raw_json) == record and again.first().title == "Tidy "


@pytest.mark.parametrize("end,expected", [("2024-01-01T00:00:00Z", 2335219200), ("1949-01-01T00:00:00Z", 5)])
def test_long_durations(spark, end, expected):
    df = spark.createDataFrame([("1950-01-01T00:00:00Z", end, 5)], "a string, b string, c int")
    assert df.select(duration_seconds("a", "b", "c")).first()[0] == expected


ROW = {c: "" for c in EXPORT_COLUMNS.values()} | {"pr_id": 3, "file_changed": 1, "added": 2, "removed": 3, "total": 5}


def _report(spark, *changes):
    rows = [{**ROW, "repo": "north", **c} for c in changes]
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


def test_exported_texts_come_back_unchanged(spark, tmp_path):
    titles = ["  padded title ", 'a "quoted", one', "two\nlines", "tab\tin it "]
    export_csv(_report(spark, *({"title": t, "pr_id": i} for i, t in enumerate(titles))), str(tmp_path / "csv"))
    got = read_activity_csv(spark, str(tmp_path / "csv")).orderBy("ID").collect()
    assert [r.Title for r in got] == titles


def _one_file(folder, header, cells):
    (folder / "repo=north").mkdir()
    lines = [",".join(header), ",".join(cells.get(c, "x") for c in header)]
    (folder / "repo=north" / "a.csv").write_text("\n".join(lines) + "\n")


CELLS = {"State": "OPEN", "Author": "Ann", "ID": "4", "FileChanged": "1", "Added": "1", "Removed": "0", "Total": "1"}


def test_csv_layouts_go_by_name(spark, tmp_path):
    header = ["State", "Author"] + [c for c in EXPORT_COLUMNS if c not in ("State", "Author")]
    _one_file(tmp_path, header, CELLS)
    row = read_activity_csv(spark, str(tmp_path), header).first()
    assert (row.State, row.Author, row.ID) == ("OPEN", "Ann", 4)
    with pytest.raises(Exception, match="(?i)header"):
        read_activity_csv(spark, str(tmp_path)).collect()


def test_csv_cells_that_are_no_numbers_stop_the_job(spark, tmp_path):
    _one_file(tmp_path, list(EXPORT_COLUMNS), {**CELLS, "Added": "x1"})
    with pytest.raises(Exception, match="(?i)malformed"):
        read_activity_csv(spark, str(tmp_path)).collect()


def test_pivots_take_every_type(spark):
    rows = spark.createDataFrame(
        [("north", "approval", "Ann", "Bo", 1), ("north", "update", "Ann", "Ann", 1), ("south", "change_request", "Bo", "Ann", 1)],
        "SrcRepo string, Type string, User string, Author string, Total long",
    )
    assert set(activity_pivot(rows, "SrcRepo").columns) == {"SrcRepo", "approval", "update", "change_request"}
    assert set(activity_pivot(rows, "User", drop_self=True).columns) == {"User", "approval", "change_request"}
    with pytest.raises(Exception, match="no pivot column"):
        activity_pivot(rows, "SrcRepo", ["approval"]).collect()


def test_rejected_pages_and_records_come_beside_the_good_ones(spark):
    good, odd = {"id": 4, "hidden": 1}, {"id": "four"}
    texts = [
        json.dumps({"values": [good, odd, {}], "pull_request_id": 8}),
        '{"values": [{"id": 5}',
        json.dumps({"values": [], "next": "x"}),
        json.dumps({"values": {"id": 6}}),
        json.dumps({"values": [7, None, {"id": 9}]}),
        "",
        None,
    ]
    pages = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "repo string, value string")
    rows, bad = split_rejected(sorted_out(pages, RECORDS["comment"]))
    got = {(r.repo, r.pull_request_id, r.id) for r in rows.collect()}
    assert got == {("r0", 8, 4), ("r0", 8, None), ("r4", None, 9)}
    assert {json.dumps(json.loads(r.record_json), sort_keys=True) for r in rows.where("id = 4").collect()} == {json.dumps(good, sort_keys=True)}
    found = {(r.repo, r.reject_reason, r.reject_text) for r in bad.collect()}
    assert ("r0", "record", json.dumps(odd, separators=(",", ":"))) in found
    assert {x[:2] for x in found} >= {("r0", "record"), ("r1", "page"), ("r3", "page"), ("r4", "record"), ("r5", "page"), ("r6", "page")}
    assert {x[2] for x in found if x[0] == "r1"} == {texts[1]}


def _lines(spark, folder, lines):
    """A ``lineitem`` table of (order, part) pairs."""
    shape = fixtures.SOURCES["lineitem"]
    day = dt.datetime(1995, 3, 4)
    rows = [(order, part, part and part % 7, n % 7, 3.0, "ANR"[n % 3], "OF"[n % 2], day) for n, (order, part) in enumerate(lines)]
    spark.createDataFrame(rows, shape).write.parquet(str(folder / "lineitem.parquet"))


def _landed_bytes(path):
    return sum(p.stat().st_size for p in Path(path).rglob("part-*"))


@pytest.mark.parametrize("kind", ["comment", "activity", "commit", "status", "diffstat"])
def test_child_pages_are_moved_once_and_land_compressed(spark, tmp_path, kind):
    """Repeated lines, a pull request of many lines and rows without keys: one page a pull request, every record on it."""
    lines = [(n % 700, n) for n in range(4_000)] + [(7, 5)] * 900 + [(None, 3), (None, 3), (8, None)]
    _lines(spark, tmp_path, lines)
    path = fixtures.land_pages(spark, str(tmp_path), kind)
    assert spark.conf.get(fixtures.HASHED_LISTS) == "true"  # as before
    pages = spark.read.schema("value string, repo string").text(path)
    values = F.from_json("value", "values array<string>, pull_request_id long")
    got = pages.select("repo", values.alias("p")).select("repo", "p.pull_request_id", F.col("p.values").alias("texts")).collect()
    sent = fixtures.record(spark, str(tmp_path), kind).select("repo", "pr_id", F.to_json("item").alias("text")).collect()
    assert len(got) == len({(r.repo, r.pr_id) for r in sent})
    key = lambda row: tuple(str(v) for v in row)
    on_pages = [(r.repo, r.pull_request_id, t) for r in got for t in r.texts]
    assert sorted(on_pages, key=key) == sorted((tuple(r) for r in sent), key=key)
    assert _landed_bytes(path) < sum(len(t) for _, _, t in on_pages) / 3
    plan = fixtures.paged_texts(fixtures.record(spark, str(tmp_path), kind, paged=True), F.to_json("item"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
