"""Chart aggregates.

They take *measure* frames: rows with labels and additive counts. A deduplicated frame gives
one measure row per pull request or run; its roll-up by all labels gives the same answers from
far fewer rows. Every group-by adds up before it shuffles, so the size of a group does not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.text import short_repo
from reviewlake.functions.times import day_or_zero, month_text, parse_time, run_month
from reviewlake.operators.filters import among
from reviewlake.operators.projections import KIND_APPROVAL
from reviewlake.params import (
    RESULT_ERROR,
    RESULT_FAILED,
    RESULT_STOPPED,
    RESULT_SUCCESS,
    clean_list,
)
from reviewlake.schemas import ZERO_DAY

PR_LABELS = ("author", "src_repo", "month")
PR_COUNTS = ("prs", "added", "removed", "total")
RUN_LABELS = ("creator", "repo", "month", "production_ref")
RUN_COUNTS = ("runs", "successful", "failed", "error", "stopped", "timed", "seconds")


def total_of(name: str, alias: str | None = None) -> Column:
    return F.expr(f"coalesce(sum({name}), 0L) as {alias or name}")


def _roll(measures: DataFrame, labels: Sequence[str], counts: Sequence[str]) -> DataFrame:
    return measures.groupBy(*labels).agg(*(total_of(c) for c in counts))


# --- pull requests ---------------------------------------------------------------------------


def pr_measures(prs: DataFrame) -> DataFrame:
    """Deduplicated pull requests with short repository, month and a count of one."""
    return prs.select(
        "author",
        short_repo("src_repo").alias("src_repo"),
        month_text(day_or_zero("updated")).alias("month"),
        F.lit(1).alias("prs"),
        "added",
        "removed",
        "total",
    )


def roll_prs(measures: DataFrame) -> DataFrame:
    return _roll(measures, PR_LABELS, PR_COUNTS)


def pr_summary(measures: DataFrame) -> DataFrame:
    """One row of totals; distinct authors and repositories include the empty name. Give it the
    roll-up: distinct counts then run over label combinations, not over pull requests."""
    return measures.agg(
        total_of("prs", "total_prs"),
        total_of("added", "total_added"),
        total_of("removed", "total_removed"),
        total_of("total", "total_changed"),
        F.countDistinct("author").alias("unique_authors"),
        F.countDistinct("src_repo").alias("unique_repos"),
    )


def prs_by_author(measures: DataFrame) -> DataFrame:
    return measures.groupBy(F.col("author").alias("label")).agg(total_of("prs", "value"))


def prs_by_month(measures: DataFrame) -> DataFrame:
    return measures.groupBy(F.col("month").alias("label")).agg(total_of("prs", "value"))


def _changes(measures: DataFrame, label: str) -> DataFrame:
    return measures.groupBy(F.col(label).alias("label")).agg(
        total_of("added"), total_of("removed"), total_of("total")
    )


def changes_by_author(measures: DataFrame) -> DataFrame:
    return _changes(measures, "author")


def changes_by_repo(measures: DataFrame) -> DataFrame:
    return _changes(measures, "src_repo")


def activity_by_user(rows: DataFrame) -> DataFrame:
    """Approvals and everything else per acting user, over report rows as they are."""
    is_approval = F.col("activity_type") == KIND_APPROVAL
    return rows.groupBy(F.col("activity_user").alias("label")).agg(
        F.count_if(is_approval).alias("approval"),
        F.count_if(~is_approval).alias("comment"),
    )


# --- pipelines -------------------------------------------------------------------------------


def run_measures(runs: DataFrame, production_refs: Iterable[str] = ()) -> DataFrame:
    """Deduplicated runs with month, production ref (or ``''``) and additive counts."""
    on_production = among("target_ref_name", production_refs)
    ref = (
        F.lit("")
        if on_production is None
        else F.when(on_production, F.col("target_ref_name")).otherwise("")
    )
    timed = F.col("duration_seconds") > 0

    def is_result(name: str) -> Column:
        return (F.col("result_name") == name).cast("int")

    return runs.select(
        "creator",
        "repo",
        run_month("created_on").alias("month"),
        ref.alias("production_ref"),
        F.lit(1).alias("runs"),
        is_result(RESULT_SUCCESS).alias("successful"),
        is_result(RESULT_FAILED).alias("failed"),
        is_result(RESULT_ERROR).alias("error"),
        is_result(RESULT_STOPPED).alias("stopped"),
        timed.cast("int").alias("timed"),
        F.when(timed, F.col("duration_seconds")).otherwise(0).alias("seconds"),
    )


def roll_runs(measures: DataFrame) -> DataFrame:
    return _roll(measures, RUN_LABELS, RUN_COUNTS)


def pipeline_summary(measures: DataFrame) -> DataFrame:
    """One row of totals, best from the roll-up. The mean duration is over timed runs and
    truncated, 0 without any."""
    mean = F.coalesce(F.expr("sum(seconds) div nullif(sum(timed), 0)"), F.lit(0))
    return measures.agg(
        total_of("runs", "total_pipelines"),
        total_of("successful", "success_count"),
        total_of("failed", "failed_count"),
        total_of("error", "error_count"),
        total_of("stopped", "stopped_count"),
        mean.alias("avg_duration_seconds"),
        F.countDistinct(F.nullif("creator", F.lit(""))).alias("unique_creators"),
        F.countDistinct("repo").alias("unique_repos"),
    )


def runs_by_creator(measures: DataFrame) -> DataFrame:
    named = measures.where(F.col("creator") != "")
    return named.groupBy(F.col("creator").alias("label")).agg(total_of("runs", "value"))


def runs_by_month(measures: DataFrame) -> DataFrame:
    dated = measures.where(F.col("month").isNotNull())
    return dated.groupBy(F.col("month").alias("label")).agg(total_of("runs", "value"))


def results_by_repo(measures: DataFrame) -> DataFrame:
    """Four result counts; a repository with only other results stays, with zeros."""
    return measures.groupBy(F.col("repo").alias("label")).agg(
        total_of("successful"), total_of("failed"), total_of("error"), total_of("stopped")
    )


def mean_duration_by_repo(measures: DataFrame) -> DataFrame:
    """Truncated mean over timed runs; repositories without one are left out."""
    timed = measures.where(F.col("timed") > 0)
    mean = F.expr("sum(seconds) div sum(timed)")
    return timed.groupBy(F.col("repo").alias("label")).agg(mean.alias("value"))


def deployment_frequency(measures: DataFrame) -> DataFrame:
    """Successful runs per month and production ref."""
    hits = measures.where(
        (F.col("production_ref") != "") & F.col("month").isNotNull() & (F.col("successful") > 0)
    )
    return hits.groupBy("month", F.col("production_ref").alias("environment")).agg(
        total_of("successful", "count")
    )


def dense_frequency(frequency: DataFrame, refs: Iterable[str]) -> DataFrame:
    """Every present month with every present ref, 0 where nothing was deployed.

    ``refs`` are the configured production refs: each month is one row of conditional sums that
    is then unfolded, and refs that occur in no month are dropped.
    """
    names = clean_list(refs)
    if not names:
        return frequency.where(F.lit(False))

    def cell(ref: str) -> Column:
        return F.sum(F.when(F.col("environment") == ref, F.col("count")).otherwise(0))

    cells = F.array(
        *(F.struct(F.lit(r).alias("environment"), cell(r).alias("count")) for r in names)
    )
    grid = frequency.groupBy("month").agg(cells.alias("cells")).selectExpr("month", "inline(cells)")
    # A window over one ref holds one row per month.
    peak = F.max("count").over(Window.partitionBy("environment"))
    return grid.withColumn("_peak", peak).where("_peak > 0").drop("_peak")


# --- filter metadata -------------------------------------------------------------------------


def _options(
    rows: DataFrame, kinds: dict[str, Column], day: Column, instant: Column
) -> DataFrame:
    """Distinct options per kind plus the day bounds, in one pass and one shuffle.

    Options are rows, not arrays: branch and people names grow with the data, and one row of
    arrays would have to hold them all. Bounds are the days of the earliest and latest instant.
    """
    pairs = [
        F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds.items()
    ]
    pairs.append(F.struct(F.lit("date").alias("kind"), F.lit("").alias("value")))
    unfolded = rows.select(
        day.alias("day"), instant.alias("instant"), F.explode(F.array(*pairs)).alias("o")
    )
    known = unfolded.select("o.*", "day", "instant").where(F.col("value").isNotNull())
    grouped = known.groupBy("kind", "value").agg(
        F.min_by("day", "instant").alias("first"), F.max_by("day", "instant").alias("last")
    )
    bound = lambda kind, c: F.struct(
        F.lit(kind).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")
    )
    own = F.array(F.struct("kind", "value"))
    dates = F.array(bound("date_min", "first"), bound("date_max", "last"))
    rows_out = F.explode(F.when(F.col("kind") == "date", dates).otherwise(own)).alias("o")
    return grouped.select(rows_out).select("o.kind", "o.value")


def _named(col: str, bots: Iterable[str] = ()) -> Column:
    """The name where it is not empty and no bot, else NULL."""
    bots = clean_list(bots)
    keep = F.col(col) != ""
    return F.when(keep & ~F.col(col).isin(bots) if bots else keep, F.col(col))


def _configured(options: DataFrame, kind: str, values: Iterable[str]) -> DataFrame:
    """Add configured names, which come with the request and not from the data."""
    rows = [(kind, v) for v in clean_list(values)]
    if not rows:
        return options
    names = options.sparkSession.createDataFrame(rows, "kind string, value string")
    return options.unionByName(names)


def pr_meta(report: DataFrame, bots: Iterable[str] = ()) -> DataFrame:
    """``kind, value`` rows: repo, author, user, date_min, date_max and the configured excluded.

    Repositories are not reduced by bots. Zero days do not count for the bounds.
    """
    day = F.nullif(day_or_zero("updated"), F.lit(ZERO_DAY)).cast("date")
    kinds = {
        "repo": short_repo("src_repo"),
        "author": _named("author", bots),
        "user": _named("activity_user", bots),
    }
    return _configured(_options(report, kinds, day, day), "excluded", bots)


def pipeline_meta(
    report: DataFrame, bots: Iterable[str] = (), production_refs: Iterable[str] = ()
) -> DataFrame:
    """``kind, value`` rows: repo, creator, environment, target, date_min, date_max and the
    configured excluded and production_ref."""
    dated = run_month("created_on").isNotNull()
    day = F.when(dated, F.substring("created_on", 1, 10)).cast("date")
    instant = F.when(dated, parse_time("created_on"))
    kinds = {
        "repo": F.col("repo"),
        "creator": _named("creator", bots),
        "environment": _named("environment_name"),
        "target": _named("target_ref_name"),
    }
    options = _configured(_options(report, kinds, day, instant), "excluded", bots)
    return _configured(options, "production_ref", production_refs)


def author_user_options(meta: DataFrame) -> DataFrame:
    """Distinct union of authors and users, for the include list."""
    people = meta.where(F.col("kind").isin("author", "user")).select(F.col("value").alias("name"))
    return people.distinct().orderBy("name")
