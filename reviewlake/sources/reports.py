"""Scans of the two report tables with their text times parsed next to the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions.times import day_or_zero, parse_time
from reviewlake.schemas import ZERO_SECOND
from reviewlake.sources.raw import read_table


def with_days(report: DataFrame) -> DataFrame:
    """Parsed ``created_date`` / ``updated_date``; an unreadable day is the zero day."""
    return report.withColumns(
        {
            "created_date": day_or_zero("created").cast("date"),
            "updated_date": day_or_zero("updated").cast("date"),
        }
    )


def with_instants(report: DataFrame) -> DataFrame:
    """Parsed ``created_ts`` / ``completed_ts``; an unreadable time is the zero time."""
    zero = F.lit(ZERO_SECOND).cast("timestamp")
    return report.withColumns(
        {
            "created_ts": F.coalesce(parse_time("created_on"), zero),
            "completed_ts": F.coalesce(parse_time("completed_on"), zero),
        }
    )


def read_pr_report(
    spark: SparkSession, path: str, repos: Sequence[str] | None = None
) -> DataFrame:
    return with_days(read_table(spark, path, "pr_report", repos))


def read_pipeline_report(
    spark: SparkSession, path: str, repos: Sequence[str] | None = None
) -> DataFrame:
    return with_instants(read_table(spark, path, "pipeline_report", repos))
