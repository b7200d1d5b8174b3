"""Result orders. Ties go by label, so every order is total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_by_value(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("value").desc(), "label")


def order_by_label(df: DataFrame) -> DataFrame:
    return df.orderBy("label")


def order_by_total(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("total").desc(), "label")


def order_by_activity(df: DataFrame) -> DataFrame:
    return df.orderBy((F.col("approval") + F.col("comment")).desc(), "label")


def order_by_results(df: DataFrame) -> DataFrame:
    four = F.col("successful") + F.col("failed") + F.col("error") + F.col("stopped")
    return df.orderBy(four.desc(), "label")


def order_by_month_and_environment(df: DataFrame) -> DataFrame:
    return df.orderBy("month", "environment")


def top(df: DataFrame, n: int) -> DataFrame:
    """First rows of an ordered result (top 15 creators, top 12 repositories)."""
    return df.limit(n)


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows of a frame in a stated order."""
    return df.orderBy(*order).limit(n)


TOP_CREATORS = 15
TOP_DURATIONS = 12
