import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import text, times
from reviewlake.functions.diffs import diff_line_counts


def evaluate(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_short_repo(spark):
    got = evaluate(spark, ["team/search", "alone", "", "one/two/three", "team/"], text.short_repo)
    assert got == ["search", "alone", "", "two/three", ""]


def test_second_part(spark):
    got = evaluate(spark, ["team/search", "alone", "one/two/three", None], text.second_part)
    assert got == ["search", None, "two", None]


def test_trigger_name(spark):
    values = ["pipeline_trigger_manual", "pipeline_trigger_pullrequest", "", "x_pipeline_trigger_y"]
    got = evaluate(spark, values, text.trigger_name)
    assert got == ["MANUAL", "PULLREQUEST", "", "X_PIPELINE_TRIGGER_Y"]


def test_pipeline_uuid_from_url(spark):
    values = [
        "https://h/w/r/pipelines/results/{u}?a=1",
        "https://h/w/r/pipelines/results/{u}#s?x",
        "https://h/pipelines/results/{a}/pipelines/results/ {b}\t\n",
        "https://h/none",
        "",
        "https://h/pipelines/results/",
        "https://h/pipelines/results/%7Bu%7D",
    ]
    got = evaluate(spark, values, text.pipeline_uuid_from_url)
    assert got == ["{u}", "{u}", "{b}", "", "", "", "%7Bu%7D"]


def test_day_and_month_keep_the_own_offset(spark):
    values = ["2024-01-31T23:30:00-08:00", "2024-02-01T00:10:00+09:00", None]
    assert evaluate(spark, values, times.day_text) == ["2024-01-31", "2024-02-01", "0001-01-01"]
    assert evaluate(spark, values[:2], times.month_text) == ["2024-01", "2024-02"]


def test_seconds_text(spark):
    values = [
        "2024-03-01T10:00:00.000Z",
        "2024-03-01T10:00:00.123456+00:00",
        "2024-03-01T10:00:00-03:30",
        None,
    ]
    assert evaluate(spark, values, times.seconds_text) == [
        "2024-03-01T10:00:00Z",
        "2024-03-01T10:00:00Z",
        "2024-03-01T10:00:00-03:30",
        "0001-01-01T00:00:00Z",
    ]
    assert evaluate(spark, [None], lambda c: times.seconds_text(c, missing="")) == [""]


def test_day_or_zero(spark):
    values = ["2024-02-29", "2023-02-29", "junk", "", "2024-1-5", None]
    got = evaluate(spark, values, times.day_or_zero)
    assert got == ["2024-02-29"] + ["0001-01-01"] * 5


def test_run_month_skips_zero_and_unreadable(spark):
    values = ["2024-05-31T23:00:00-05:00", "0001-01-01T00:00:00Z", "", "2024-05-01"]
    assert evaluate(spark, values, times.run_month) == ["2024-05", None, None, None]


@pytest.mark.parametrize(
    "created, completed, build, expected",
    [
        ("2023-02-28T23:59:30Z", "2023-03-01T00:00:30Z", 4, 60),
        ("2024-06-01T08:00:00+05:30", "2024-06-01T02:30:00Z", 15, 15),
        ("2024-06-01T08:00:00Z", None, 0, 0),
        ("2024-13-01T00:00:00Z", "2025-06-01T00:00:00Z", 77, 77),
        ("2024-12-31T23:59:59-12:00", "2025-01-01T12:00:00Z", 3, 1),
        ("2024-01-01T10:00:00+02:00", "2024-01-01T09:00:00Z", 7, 3600),
        ("2024-01-01T10:00:00.9Z", "2024-01-01T10:00:01.1Z", 9, 9),
        ("1900-01-01T00:00:00Z", "2024-01-01T10:00:00Z", 5, 3913092000),
    ],
)
def test_duration(spark, created, completed, build, expected):
    df = spark.createDataFrame([(created, completed, build)], "a string, b string, c int")
    assert df.select(times.duration_seconds("a", "b", "c")).first()[0] == expected


def test_time_or_null_accepts_only_time_texts(spark):
    df = spark.createDataFrame(
        [
            (1, '{"t": "2024-01-01T00:00:00Z", "k": 1}'),
            (2, '{"t": false, "k": 2}'),
            (3, '{"t": 123, "k": 3}'),
            (4, '{"k": 4}'),
        ],
        "i int, j string",
    )
    r = df.select("i", F.from_json("j", "t string, k int").alias("r"))
    got = r.orderBy("i").select(times.time_or_null("r.t"), "r.k").collect()
    assert [tuple(x) for x in got] == [
        ("2024-01-01T00:00:00Z", 1), (None, 2), (None, 3), (None, 4)
    ]


def _count(diff, sign):
    return sum(
        1 for line in diff.split("\n") if line.startswith(sign) and not line.startswith(sign * 3)
    )


def test_diff_line_counts(spark):
    diffs = [
        "--- a/x.go\n+++ b/x.go\n@@ -1 +1,2 @@\n-old\n+new\n+extra\n",
        "",
        "Binary files a/x and b/x differ",
        "--- a\n+++ b\n+1\n-1\n--- c\n+++ d\n+2\n",
        "+first\r\n++two\n+\n-\n--x\n----\n++++\n é+\n+é",
        "\n\n+\n\n-",
    ]
    df = spark.createDataFrame([("r", i, d) for i, d in enumerate(diffs)], "repo string, pr_id long, diff string")
    got = diff_line_counts(df).orderBy("pr_id").collect()
    assert [(r.lines_added, r.lines_removed) for r in got] == [
        (_count(d, "+"), _count(d, "-")) for d in diffs
    ]
    assert (got[0].lines_added, got[0].lines_removed) == (2, 1)


def test_display_texts(spark):
    assert evaluate(spark, [0, 45, 60, 185, None], text.duration_text, "int") == [
        "—", "45s", "1m 0s", "3m 5s", "—"
    ]
    assert evaluate(spark, ["a" * 50, "a" * 51], text.cut_title) == ["a" * 50, "a" * 50 + "…"]
    assert evaluate(spark, ["", "x", None], text.dash_if_empty) == ["—", "x", "—"]
    assert evaluate(spark, [1234567], lambda c: text.signed_count("+", c), "long") == ["+1,234,567"]
    df = spark.createDataFrame([(0, 7), (3, 7)], "run int, build int")
    assert [r[0] for r in df.select(text.run_label("run", "build")).collect()] == ["#7", "#3"]


def test_parameters():
    from reviewlake.params import (
        PipelineParams,
        PRParams,
        clean_list,
        lookback_start,
        parse_day,
        parse_range,
    )

    assert clean_list(None) == [] and clean_list(["", "  ", "a", "a"]) == ["a"]
    assert parse_day("2024-01-31") == dt.date(2024, 1, 31)
    assert parse_day("2024-13-01") is None and parse_day("") is None and parse_day("x") is None
    low, high = parse_range("2024-01-01", "2024-01-31")
    assert low == dt.datetime(2024, 1, 1)
    assert high == dt.datetime(2024, 1, 31, 23, 59, 59, 999999)
    assert parse_range("bad", None) == (None, None)
    params = PRParams.from_dict({"dateFrom": "2024-01-01", "dateTo": "?", "repos": ["", "a"]})
    assert params == PRParams(date_from=dt.date(2024, 1, 1), repos=("a",))
    today = dt.date(2024, 3, 1)
    assert lookback_start("daily", today) == dt.date(2024, 2, 29)
    assert lookback_start("monthly", today) == today and lookback_start("all", today) is None
    preset = PipelineParams(targets=("dev",), production_refs=("main",)).production_deployments()
    assert preset.targets == ("dev", "main") and preset.result_names == ("SUCCESSFUL",)
