"""What the optimizer makes of the jobs: pushdown, pruning, partial steps, no row-wise Python."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from reviewlake.catalog import QUERIES
from reviewlake.operators.filters import pipeline_filter, pr_filter
from reviewlake.oracles import ORACLES
from reviewlake.params import PipelineParams, PRParams
from reviewlake.plans.charts import pipeline_charts, pr_charts
from reviewlake.plans.tables import pr_table
from reviewlake.schemas import KEYS
from reviewlake.sources import store
from reviewlake.sources.raw import read_table
from reviewlake.sources.reports import read_pipeline_report, read_pr_report


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Both reports stored for two repositories."""
    from reviewlake.schemas import SCHEMAS, evolve

    root = tmp_path_factory.mktemp("lake")
    pr = spark.range(40).selectExpr(
        "id as pr_id", "concat('r', id % 2) as repo", "concat('ws/r', id % 2) as src_repo",
        "concat('a', id % 3) as author", "'approval' as activity_type", "'u' as activity_user",
        "cast(date_add(date'2024-01-01', int(id)) as string) as updated",
    )
    run = spark.range(40).selectExpr(
        "concat('{', id, '}') as pipeline_uuid", "concat('r', id % 2) as repo", "'c' as creator",
        "concat(date_add(date'2024-01-01', int(id)), 'T00:00:00Z') as created_on",
    )
    for name, df in (("pr_report", pr), ("pipeline_report", run)):
        rows = evolve(df, SCHEMAS[name])
        store.write_replace(spark, rows, str(root / name), name, ["r0", "r1"])
    return root


def test_upper_bounds_reach_the_scan(spark, lake):
    days = {"date_from": dt.date(2024, 1, 10), "date_to": dt.date(2024, 1, 20)}
    prs = pr_filter(read_pr_report(spark, str(lake / "pr_report")), PRParams(**days))
    assert "LessThanOrEqual(updated,2024-01-20)" in plan(prs) and prs.count() == 11
    runs = pipeline_filter(read_pipeline_report(spark, str(lake / "pipeline_report")), PipelineParams(**days))
    assert "LessThan(created_on,2024-01-22)" in plan(runs) and runs.count() == 11
    # a text that is no day is the zero day: kept while nothing bounds it from below
    odd = read_pr_report(spark, str(lake / "pr_report")).limit(1).withColumn("updated", F.lit("today"))
    assert pr_filter(odd, PRParams(date_to=dt.date(2024, 1, 20))).count() == 1
    assert pr_filter(odd, PRParams(date_from=dt.date.min, date_to=dt.date(2024, 1, 20))).count() == 1
    assert pr_filter(odd, PRParams(**days)).count() == 0


def test_date_bounds_reach_the_scan(spark, lake):
    params = PRParams(date_from=dt.date(2024, 1, 10), exclude_users=("a1",))
    text = plan(pr_charts(read_pr_report(spark, str(lake / "pr_report")), params)["summary"])
    assert "GreaterThanOrEqual(updated,2024-01-10)" in text
    assert "Not(EqualTo(author,a1))" in text
    assert "description" not in text and "title" not in text
    params = PipelineParams(date_from=dt.date(2024, 1, 10), repos=("r1",))
    runs = read_pipeline_report(spark, str(lake / "pipeline_report"))
    text = plan(pipeline_charts(runs, params)["summary"])
    assert "GreaterThanOrEqual(created_on,2024-01-09)" in text and "= r1)" in text


def test_short_repository_names_reach_the_scan(spark, lake):
    report = read_pr_report(spark, str(lake / "pr_report"))
    found = pr_filter(report, PRParams(repos=("r1", "other")))
    assert "StringEndsWith(src_repo,/r1)" in plan(found) and found.count() == 20
    names = ["r1", "ws/r1", "ws/x/r1", "x/r1/", "ar1", "", None, "r1/other", "other/r1/y"]
    odd = spark.createDataFrame([(n,) for n in names], "src_repo string").withColumn("updated", F.lit("2024-01-01"))
    kept = {r.src_repo for r in pr_filter(odd, PRParams(repos=("r1", "other"))).collect()}
    assert kept == {"r1", "ws/r1", "r1/other"}  # the name is what follows the first slash


def test_repositories_prune_partitions(spark, lake):
    df = read_table(spark, str(lake / "pr_report"), "pr_report", ["r1"])
    assert "PartitionFilters: [isnotnull(repo" in plan(df) and df.inputFiles()
    assert {r.repo for r in df.select("repo").distinct().collect()} == {"r1"}


def test_keep_first_is_limited_before_the_shuffle(spark, lake):
    report = read_pr_report(spark, str(lake / "pr_report"))
    page = plan(pr_table(report).rows)
    assert page.count("WindowGroupLimit") >= 2 and "TakeOrderedAndProject" in page
    assert "Partial" in page


def test_upsert_does_not_shuffle_the_stored_table(spark, rows):
    stored = spark.range(1000).selectExpr("'r' as repo", "id as pr_id", "'old' as title")
    batch = stored.limit(3).withColumn("seq", F.lit(1))
    text = plan(store.upsert(stored, batch, KEYS["pull_requests"], "seq"))
    assert "BroadcastHashJoin LeftAnti BuildRight" in text


def test_stored_files_are_sorted_by_their_filter_column(spark, lake):
    (file,) = [f.file for f in store.version(spark, str(lake / "pr_report"), "pr_report").live() if f.repo == "r0"]
    days = [r.updated for r in spark.read.parquet(str(lake / "pr_report" / file)).collect()]
    assert days == sorted(days) and len(days) == 20


def test_new_keys_do_not_shuffle_the_stored_table(spark):
    from reviewlake.operators.joins import new_keys

    stored = spark.range(1000).selectExpr("'r' as repo", "id as pipeline_uuid")
    batch = spark.range(3).selectExpr("'r' as repo", "if(id = 0, 5, 5000L) as pipeline_uuid")
    found = new_keys(batch, stored, ["repo", "pipeline_uuid"])
    assert "BroadcastHashJoin LeftSemi BuildRight" in plan(found)
    assert [tuple(r) for r in found.collect()] == [("r", 5000)]


SF = "/root/testdata/sf0.001"
CHEAP = [n for n in QUERIES if not n.startswith(("s1_", "s7_", "k"))]


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", [n for n in CHEAP if n[0] in "rajnou"])
def test_plans_stay_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert step not in text, step
