import datetime as dt

import pytest

from reviewlake.operators import pivots as V
from reviewlake.operators.dedup import distinct_prs
from reviewlake.operators.filters import notebook_filter
from reviewlake.sources.csvs import PR_COLUMNS

SHAPE = (
    "ID long, SrcRepo string, SrcBranch string, DestRepo string, DestBranch string, Title string, "
    "Description string, State string, Author string, Created timestamp, Updated timestamp, "
    "FileChanged long, Added long, Removed long, Total long, Type string, User string"
)


def row(i, repo, author, updated, total, kind="approval", user="U"):
    when = dt.datetime.fromisoformat(updated)
    return (i, repo, "b", repo, "main", "t", "d", "OPEN", author, when, when, 1, total, 0, total, kind, user)


@pytest.fixture
def activity(spark):
    data = [
        row(1, "ws/a", "Ann", "2024-01-05", 10, "approval", "Bob"),
        row(1, "ws/a", "Ann", "2024-01-05", 10, "comment", "Ann"),
        row(2, "ws/b", "Bob", "2024-02-05", 30, "approval", "Ann"),
        row(3, "ws/b", None, "2024-02-06", None, "approval", None),
        row(4, "nows", "Ann", "2024-02-07", 60, "comment", "Bob"),
    ]
    return spark.createDataFrame(data, SHAPE)


@pytest.fixture
def prs(activity):
    return V.with_report_columns(distinct_prs(activity))


def table(df, key):
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.collect()}


def test_distinct_prs(activity):
    got = distinct_prs(activity)
    assert got.columns == PR_COLUMNS and got.count() == 4


def test_filter_is_inclusive(activity):
    got = notebook_filter(activity, ["ws/b"], dt.date(2024, 2, 5), dt.date(2024, 2, 5))
    assert [r.ID for r in got.collect()] == [2]


def test_sums_and_counts_drop_missing_keys(prs):
    assert table(V.total_by(prs, ["SrcRepo"]), "SrcRepo") == {"a": {"total": 10}, "b": {"total": 30}}
    assert table(V.total_by(prs, ["Author"]), "Author") == {"Ann": {"total": 70}, "Bob": {"total": 30}}
    assert table(V.count_by(prs, ["SrcRepo"]), "SrcRepo") == {"a": {"n": 1}, "b": {"n": 1}}
    assert V.mean_total(prs).first()[0] == pytest.approx(100 / 3)


def test_month_pivot_keeps_missing_cells_empty(prs):
    want = {"2024-01": {"a": 10, "b": None}, "2024-02": {"a": None, "b": 30}}
    assert table(V.total_pivot(prs), "DateGroup") == want
    assert table(V.total_pivot(prs, ["a", "b"]), "DateGroup") == want


def test_activity_pivots(activity):
    rep = V.with_report_columns(activity)
    by_repo = table(V.activity_pivot(rep, "SrcRepo", ["approval", "comment"]), "SrcRepo")
    assert by_repo == {"a": {"approval": 1, "comment": 1}, "b": {"approval": 1, "comment": None}}
    by_user = table(V.activity_pivot(rep, "User"), "User")
    assert by_user == {"Ann": {"approval": 1, "comment": 1}, "Bob": {"approval": 1, "comment": 1}}
    cross = table(V.activity_pivot(rep, "SrcRepo", ["approval", "comment"], drop_self=True), "SrcRepo")
    assert cross["a"] == {"approval": 1, "comment": None}


def test_present_cells_without_values_count_zero(activity):
    only = V.with_report_columns(activity.where("ID = 3"))
    assert table(V.activity_pivot(only, "SrcRepo", ["approval"]), "SrcRepo") == {"b": {"approval": 0}}


def test_share_of_total(prs):
    got = table(V.share_of_total(V.total_by(prs, ["Author"]), "total"), "Author")
    assert got == {"Ann": {"total": 70, "pct": 70.0, "absolute": 70}, "Bob": {"total": 30, "pct": 30.0, "absolute": 30}}


def test_concat_matches_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    c = spark.createDataFrame([(3,)], "a int")
    got = V.concat_frames(a, b, c).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, "x"), (2, "y"), (3, None)]
