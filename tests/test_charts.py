import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import aggregates as A
from reviewlake.operators import ordering as O
from reviewlake.operators.dedup import dedup_pipelines, dedup_prs, pr_rows
from reviewlake.operators.filters import (
    created_between,
    env_matches,
    pipeline_filter,
    pr_filter,
    production_predicate,
)
from reviewlake.operators.paging import clamp_page, page_count, paged
from reviewlake.params import PipelineParams, PRParams
from reviewlake.plans.charts import (
    pipeline_chart_rows,
    pipeline_charts,
    pr_chart_rows,
    pr_charts,
)
from reviewlake.plans.tables import deployments_table, pipeline_table, pr_table


def pr(pr_id, src, author, kind, user, updated, added=10, removed=2, repo="r"):
    return {"pr_id": pr_id, "repo": repo, "src_repo": src, "author": author, "activity_type": kind,
            "activity_user": user, "updated": updated, "created": updated, "added": added,
            "removed": removed, "total": added + removed}


ROWS = (
    pr(11, "team/search", "Nadia", "approval", "Oskar", "2023-03-05"),
    pr(12, "team/search", "Oskar", "pullrequest_comment", "", "2023-03-05"),
    pr(13, "team/billing", "Nadia", "pullrequest_comment", "Pia", "2023-07-31"),
    pr(14, "ops/search", "", "approval", "Pia", "2023-11-01"),
)
day = dt.date


@pytest.mark.parametrize(
    "params, bots, ids",
    [
        (PRParams(), (), [11, 12, 13, 14]),
        (PRParams(date_from=day(2023, 3, 5)), (), [11, 12, 13, 14]),
        (PRParams(date_from=day(2023, 3, 6)), (), [13, 14]),
        (PRParams(date_to=day(2023, 7, 30)), (), [11, 12]),
        (PRParams(date_to=day(2023, 7, 31)), (), [11, 12, 13]),
        (PRParams(date_from=day(2023, 3, 6), date_to=day(2023, 10, 31)), (), [13]),
        (PRParams(date_from=day(2023, 12, 1), date_to=day(2023, 1, 1)), (), []),
        (PRParams(repos=("search",)), (), [11, 12, 14]),
        (PRParams(repos=("billing", "search")), (), [11, 12, 13, 14]),
        (PRParams(authors=("Oskar",)), (), [11, 12]),
        (PRParams(authors=("Pia", "Zoe")), (), [13, 14]),
        (PRParams(exclude_users=("Pia",)), (), [11, 12]),
        (PRParams(exclude_users=("Oskar",)), (), [13, 14]),
        (PRParams(repos=("search",), authors=("Nadia",)), (), [11]),
        (PRParams(), ("Nadia",), [12, 14]),
        (PRParams(), ("Nadia", "Pia"), [12]),
    ],
)
def test_pr_filter(rows, params, bots, ids):
    got = pr_filter(rows("pr_report", *ROWS), params, bots)
    assert sorted(r.pr_id for r in got.collect()) == ids


def test_zero_days_fail_the_lower_bound_and_pass_the_upper(rows):
    df = rows("pr_report", *(pr(i, "w/r", "A", "approval", "B", d) for i, d in enumerate(("0001-01-01", "junk", "2024-01-01"))))
    low, high = PRParams(date_from=day(2023, 1, 1)), PRParams(date_to=day(2023, 1, 1))
    assert [r.pr_id for r in pr_filter(df, low).collect()] == [2]
    assert sorted(r.pr_id for r in pr_filter(df, high).collect()) == [0, 1]


def test_dedup_prs(rows):
    df = rows(
        "pr_report",
        pr(1, "ws/r", "A", "approval", "B", "2024-01-01"),
        pr(1, "ws/r", "A", "approval", "C", "2024-01-01"),
        pr(2, "ws/r", "A", "approval", "B", "2024-01-01", repo="b"),
        pr(2, "ws/r", "A", "approval", "B", "2024-01-01", added=77, repo="a"),
        pr(5, "ws/r", "A", "approval", "B", "2024-01-01", added=999),
        pr(5, "ws/r", "A", "approval", "B", "2024-01-01", added=100),
    )
    got = {r.pr_id: r for r in dedup_prs(df).collect()}
    assert sorted(got) == [1, 2, 5] and got[5].added == 100
    assert (got[2].repo, got[2].added) == ("a", 77)
    assert dedup_prs(df, ("repo", "pr_id")).count() == 4
    assert {r.src_repo for r in pr_rows(dedup_prs(df)).collect()} == {"r"}


CHART = (
    pr(1, "ws/a", "Alice", "approval", "Bob", "2024-01-10", 100, 20),
    pr(1, "ws/a", "Alice", "pullrequest_comment", "Bob", "2024-01-10", 100, 20),
    pr(2, "ws/b", "Bob", "pullrequest_comment", "Carol", "2024-02-10", 50, 10),
    pr(3, "ws/b", "Alice", "approval", "", "0001-01-01", 1, 1),
)


def test_pr_charts(rows):
    c = {k: v.collect() for k, v in pr_charts(rows("pr_report", *CHART)).items()}
    assert tuple(c["summary"][0]) == (3, 151, 31, 182, 2, 2)
    assert [tuple(r) for r in c["pr_count_by_author"]] == [("Alice", 2), ("Bob", 1)]
    assert [tuple(r) for r in c["code_changes_by_author"]] == [("Alice", 101, 21, 122), ("Bob", 50, 10, 60)]
    assert [tuple(r) for r in c["activity_by_user"]] == [("Bob", 1, 1), ("Carol", 0, 1)]
    assert [tuple(r) for r in c["pr_count_by_month"]] == [("0001-01", 1), ("2024-01", 1), ("2024-02", 1)]
    assert [tuple(r) for r in c["code_changes_by_repo"]] == [("a", 100, 20, 120), ("b", 51, 11, 62)]


def test_names_match_author_in_pr_charts_and_user_in_the_review_chart(rows):
    params = PRParams(authors=("Bob",))
    c = pr_charts(rows("pr_report", *CHART), params)
    assert [tuple(r) for r in c["pr_count_by_author"].collect()] == [("Bob", 1)]
    assert [tuple(r) for r in c["activity_by_user"].collect()] == [("Bob", 1, 1)]
    c = pr_charts(rows("pr_report", *CHART), PRParams(exclude_users=("Bob",)))
    assert [r.label for r in c["pr_count_by_author"].collect()] == ["Alice"]
    assert [r.label for r in c["activity_by_user"].collect()] == ["Carol"]


def long_form(charts, labels):
    out = set()
    for name, frame in charts.items():
        for r in frame.collect():
            d = r.asDict()
            label = " ".join(d.pop(k) for k in labels(name))
            out |= {(name, label, k, v) for k, v in d.items()}
    return out


def test_bundle_frame_equals_the_single_charts(rows):
    df = rows("pr_report", *CHART)
    want = long_form(pr_charts(df), lambda n: [] if n == "summary" else ["label"])
    assert {tuple(r) for r in pr_chart_rows(df).collect()} == want


def test_empty_report(rows):
    df = rows("pr_report", *CHART).where("false")
    charts = pr_charts(df)
    assert tuple(charts["summary"].first()) == (0, 0, 0, 0, 0, 0)
    assert charts["pr_count_by_author"].count() == 0
    assert pr_table(df).rows.count() == 0 and pr_table(df).total.first().total == 0


def test_pr_meta(rows):
    days = ("2024-03-15", "2024-01-01", "2024-12-31", "0001-01-01")
    df = rows("pr_report", *(pr(i, f"ws/r{i}", "Ann", "approval", "Bot", d) for i, d in enumerate(days)))
    got = {tuple(r) for r in A.pr_meta(df, ["Bot"]).collect()}
    assert got == {("repo", f"r{i}") for i in range(4)} | {
        ("author", "Ann"), ("date_min", "2024-01-01"), ("date_max", "2024-12-31"),
        ("excluded", "Bot"),
    }
    empty = {tuple(r) for r in A.pr_meta(df.where("updated = '0001-01-01'")).collect()}
    assert {("date_min", ""), ("date_max", "")} <= empty
    people = A.author_user_options(A.pr_meta(df))
    assert [r.name for r in people.collect()] == ["Ann", "Bot"]


# --- pipelines -------------------------------------------------------------------------------


def run(uuid, repo, creator, result, env, ref, created, seconds=300):
    return {"pipeline_uuid": uuid, "repo": repo, "creator": creator, "state_name": "COMPLETED",
            "result_name": result, "environment_name": env, "target_ref_name": ref,
            "created_on": created + "T00:00:00Z" if len(created) == 10 else created,
            "duration_seconds": seconds}


RUNS = (
    run("{r1}", "search", "Nadia", "SUCCESSFUL", "live", "trunk", "2023-03-05"),
    run("{r2}", "search", "", "FAILED", "", "trunk", "2023-03-05"),
    run("{r3}", "billing", "Oskar", "STOPPED", "test", "feature/x", "2023-08-20"),
    run("{r4}", "billing", "Robot", "SUCCESSFUL", "live", "trunk", "2023-09-09"),
    run("{r5}", "", "Nadia", "ERROR", "stage", "hotfix", "2023-12-31"),
)
P = PipelineParams


@pytest.mark.parametrize(
    "params, ids",
    [
        (P(), ["{r1}", "{r2}", "{r3}", "{r5}"]),
        (P(repos=("search",)), ["{r1}", "{r2}"]),
        (P(repos=("search", "billing")), ["{r1}", "{r2}", "{r3}"]),
        (P(creators=("Nadia",)), ["{r1}", "{r5}"]),
        (P(exclude_users=("Oskar", "Nadia")), ["{r2}"]),
        (P(date_from=day(2023, 3, 6), date_to=day(2023, 9, 30)), ["{r3}"]),
        (P(environments=("live", "stage")), ["{r1}", "{r5}"]),
        (P(targets=("feature/x", "hotfix")), ["{r3}", "{r5}"]),
        (P(result_names=("STOPPED",)), ["{r3}"]),
        (P(repos=("billing",), creators=("Robot",)), []),
    ],
)
def test_pipeline_filter(rows, params, ids):
    got = pipeline_filter(rows("pipeline_report", *RUNS), params, ["Robot"])
    assert sorted(r.pipeline_uuid for r in got.collect()) == ids


def test_last_day_counts_up_to_midnight_only(rows):
    df = rows(
        "pipeline_report",
        run("p1", "r", "A", "FAILED", "", "m", "2024-01-31T00:00:00Z"),
        run("p2", "r", "A", "FAILED", "", "m", "2024-01-31T00:00:01Z"),
        run("p3", "r", "A", "FAILED", "", "m", "2024-02-01T01:30:00+02:00"),
        run("p4", "r", "A", "FAILED", "", "m", "junk"),
    )
    ids = lambda p: sorted(r.pipeline_uuid for r in pipeline_filter(df, p).collect())
    assert ids(P(date_to=day(2024, 1, 31))) == ["p1", "p4"]
    assert ids(P(date_to=day(2024, 1, 31), date_to_end_of_day=True)) == ["p1", "p2", "p3", "p4"]
    assert ids(P(date_from=day(2024, 1, 31))) == ["p1", "p2", "p3"]
    assert ids(P(date_from=day(2024, 2, 1))) == []


def test_dedup_pipelines_keeps_first_environment(rows):
    df = rows(
        "pipeline_report",
        run("p1", "r", "A", "FAILED", "Staging", "m", "2024-01-31"),
        run("p1", "r", "A", "FAILED", "Production", "m", "2024-01-31"),
        run("p2", "r", "A", "FAILED", "", "m", "2024-01-31"),
    )
    got = {r.pipeline_uuid: r.environment_name for r in dedup_pipelines(df).collect()}
    assert got == {"p1": "Production", "p2": ""}


CHART_RUNS = (
    run("p1", "repo-a", "Alice", "SUCCESSFUL", "Production", "master", "2024-01-15", 100),
    run("p1", "repo-a", "Alice", "SUCCESSFUL", "Staging", "master", "2024-01-15", 100),
    run("p2", "repo-b", "Bob", "FAILED", "", "develop", "2024-02-10", 33),
    run("p3", "repo-b", "", "SUCCESSFUL", "", "master", "2024-02-20", 34),
    run("p4", "repo-c", "Bob", "", "", "develop", "junk", 0),
)
REFS = P(production_refs=("master", "unused"))


def test_pipeline_charts(rows):
    c = {k: [tuple(r) for r in v.collect()] for k, v in pipeline_charts(rows("pipeline_report", *CHART_RUNS), REFS).items()}
    assert c["summary"] == [(4, 2, 1, 0, 0, 55, 2, 3)]
    assert c["deployment_frequency"] == [("2024-01", "master", 1), ("2024-02", "master", 1)]
    assert c["results_by_repo"] == [("repo-b", 1, 1, 0, 0), ("repo-a", 1, 0, 0, 0), ("repo-c", 0, 0, 0, 0)]
    assert c["pipelines_by_creator"] == [("Bob", 2), ("Alice", 1)]
    assert c["avg_duration_by_repo"] == [("repo-a", 100), ("repo-b", 33)]
    assert c["pipelines_by_month"] == [("2024-01", 1), ("2024-02", 2)]


def test_no_production_refs_no_frequency(rows):
    df = rows("pipeline_report", *CHART_RUNS)
    assert pipeline_charts(df)["deployment_frequency"].count() == 0
    assert df.where(production_predicate([])).count() == 0
    assert df.where(production_predicate(["master"])).count() == 3


def test_pipeline_bundle_frame_equals_the_single_charts(rows):
    df = rows("pipeline_report", *CHART_RUNS)
    labels = lambda n: {"summary": [], "deployment_frequency": ["month", "environment"]}.get(n, ["label"])
    want = long_form(pipeline_charts(df, REFS), labels)
    assert {tuple(r) for r in pipeline_chart_rows(df, REFS).collect()} == want


def test_summary_without_timed_runs(rows):
    df = rows("pipeline_report", run("p", "r", "A", "ERROR", "", "m", "2024-01-01", 0))
    assert pipeline_charts(df)["summary"].first().avg_duration_seconds == 0


def test_dense_frequency(spark):
    freq = spark.createDataFrame(
        [("2024-01", "main", 3), ("2024-03", "master", 1)], "month string, environment string, count long"
    )
    got = {tuple(r) for r in A.dense_frequency(freq, ["main", "master", "unused"]).collect()}
    assert got == {("2024-01", "main", 3), ("2024-01", "master", 0), ("2024-03", "main", 0), ("2024-03", "master", 1)}
    assert A.dense_frequency(freq, []).count() == 0


def test_pipeline_meta_bounds_follow_the_instant(rows):
    df = rows(
        "pipeline_report",
        run("p1", "r", "A", "FAILED", "", "m", "2024-01-01T23:00:00-10:00"),
        run("p2", "r", "B", "FAILED", "E", "", "2024-01-02T05:00:00Z"),
        run("p3", "r", "", "FAILED", "", "m", "junk"),
    )
    got = {tuple(r) for r in A.pipeline_meta(df, ["A"], ["main"]).collect()}
    assert got == {
        ("repo", "r"), ("creator", "B"), ("environment", "E"), ("target", "m"),
        ("date_min", "2024-01-02"), ("date_max", "2024-01-01"),
        ("excluded", "A"), ("production_ref", "main"),
    }


# --- orders and pages ------------------------------------------------------------------------


def test_orders_break_ties_by_label(spark):
    value = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "label string, value long")
    assert [r.label for r in O.order_by_value(value).collect()] == ["c", "a", "b"]
    assert [r.label for r in O.order_by_label(value).collect()] == ["a", "b", "c"]
    assert [r.label for r in O.top(O.order_by_value(value), 2).collect()] == ["c", "a"]
    total = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "label string, total long")
    assert [r.label for r in O.order_by_total(total).collect()] == ["c", "a", "b"]
    acts = spark.createDataFrame([("b", 1, 1), ("a", 2, 0), ("c", 0, 9)], "label string, approval long, comment long")
    assert [r.label for r in O.order_by_activity(acts).collect()] == ["c", "a", "b"]
    results = spark.createDataFrame(
        [("small", 1, 0, 0, 0), ("big", 2, 2, 2, 2), ("mid", 0, 3, 0, 0)],
        "label string, successful long, failed long, error long, stopped long",
    )
    assert [r.label for r in O.order_by_results(results).collect()] == ["big", "mid", "small"]
    freq = spark.createDataFrame([("2024-02", "a"), ("2024-01", "b"), ("2024-01", "a")], "month string, environment string")
    got = [tuple(r) for r in O.order_by_month_and_environment(freq).collect()]
    assert got == [("2024-01", "a"), ("2024-01", "b"), ("2024-02", "a")]


@pytest.mark.parametrize("page, size, ids", [(None, None, [1, 2, 3, 4, 5]), (1, 2, [1, 2]), (2, 2, [3, 4]), (3, 2, [5]), (99, 2, [])])
def test_pr_table_pages(rows, page, size, ids):
    df = rows("pr_report", *(pr(i, "ws/r", "A", "approval", "B", f"2024-01-0{i}") for i in range(1, 6)))
    got = pr_table(df, page=page, size=size)
    assert [r.id for r in got.rows.collect()] == ids and got.total.first().total == 5


@pytest.mark.parametrize("page", [1, 2, 4, 9])
def test_deep_pages_equal_plain_ones(spark, page):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    df = spark.range(0, 1700, 1, 6).selectExpr("id * 7919 % 1700 as id", "cast(id as string) as v")
    plain = paged(df, [F.col("id").desc()], page, 190)
    deep = paged(df, [F.col("id").desc()], page, 190, deep=True)
    assert [tuple(r) for r in deep.rows.collect()] == [tuple(r) for r in plain.rows.collect()]
    assert deep.rows.count() == (180 if page == 9 else 190)
    assert paged(df, ["id"], 99, 190, deep=True).rows.count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_page_clamps(spark):
    assert clamp_page(0, 0) == (1, 20) and clamp_page(-3, 201) == (1, 20)
    assert clamp_page(2, 200) == (2, 200)
    df = spark.createDataFrame([(0,), (20,), (21,)], "t long")
    assert [r[0] for r in df.orderBy("t").select(page_count("t", 20)).collect()] == [1, 1, 2]


def test_pipeline_tables(rows):
    df = rows("pipeline_report", *CHART_RUNS)
    assert [r.pipeline_uuid for r in pipeline_table(df).rows.collect()] == ["p4", "p3", "p2", "p1"]
    got = deployments_table(df, REFS)
    assert [r.pipeline_uuid for r in got.rows.collect()] == ["p3", "p1"] and got.total.first().total == 2


def test_created_between_brackets_the_extra_condition(rows):
    df = rows("pull_requests", *({"pr_id": i, "created_on": f"2026-0{i}-01", "state": s} for i, s in ((1, "OPEN"), (3, "MERGED"), (4, "OPEN"))))
    got = df.where(created_between("created_on", day(2026, 1, 1), day(2026, 3, 31), "state = 'MERGED' OR state = 'OPEN'"))
    assert sorted(r.pr_id for r in got.collect()) == [1, 3]


def test_env_matches(spark):
    df = spark.createDataFrame([("Production",), ("staging",), ("",)], "e string")
    assert [r.e for r in df.where(env_matches("e", ["PRODUCTION"])).collect()] == ["Production"]
    assert df.where(env_matches("e", [])).count() == 3
