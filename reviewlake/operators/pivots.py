"""Group-bys and pivots of the CSV reports. Rows with a missing key drop out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import second_part
from reviewlake.session import kept


def with_report_columns(df: DataFrame) -> DataFrame:
    """Month of ``Updated`` and repository names without their workspace."""
    return df.withColumns(
        {
            "DateGroup": F.date_format("Updated", "yyyy-MM"),
            "SrcRepo": second_part("SrcRepo"),
            "DestRepo": second_part("DestRepo"),
        }
    )


def concat_frames(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Frames stacked by column name, absent columns as NULL."""
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def _keyed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(cols))


def total_by(prs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum of changed lines per group, 0 where no row has a value."""
    total = F.coalesce(F.sum("Total"), F.lit(0)).alias("total")
    return _keyed(prs, cols).groupBy(*cols).agg(total)


def count_by(prs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a total per group."""
    return _keyed(prs, cols).groupBy(*cols).agg(F.count("Total").alias("n"))


def _spread(cells: DataFrame, index: str, column: str, value: str, columns) -> DataFrame:
    """Grouped cells to one row per ``index``; cells without rows stay NULL.

    The cells are already one row per pair, so the pivot moves groups and not source rows.
    Without ``columns`` the cells are written, which runs the input once; the distinct names and the table are
    both read from them. Spark refuses to build more than ``spark.sql.pivotMaxValues`` columns; the grouped
    cells are the way beyond that. A name that is not among given ``columns`` stops the job: its rows must not vanish.
    """
    if not columns:
        cells = kept(cells, "pivot-cells")
        return cells.groupBy(index).pivot(column).agg(F.first(value))
    known = F.col(column).isin(list(columns))
    unknown = F.raise_error(F.concat(F.lit("no pivot column for "), F.col(column)))
    checked = cells.withColumn(column, F.when(known, F.col(column)).otherwise(unknown))
    pivot = checked.groupBy(index).pivot(column, list(columns))
    return pivot.agg(F.first(value))


def total_pivot(
    prs: DataFrame, columns: Sequence[str] | None = None, index: str = "DateGroup",
    column: str = "SrcRepo",
) -> DataFrame:
    """Month by repository table of summed changes."""
    return _spread(total_by(prs, [index, column]), index, column, "total", columns)


def activity_pivot(
    activity: DataFrame,
    index: str,
    columns: Sequence[str] | None = None,
    drop_self: bool = False,
) -> DataFrame:
    """Activity counts by type for each repository (``SrcRepo``) or user (``User``).

    ``drop_self`` leaves out what authors did on their own pull requests.
    """
    if drop_self:
        activity = activity.where(~F.col("User").eqNullSafe(F.col("Author")))
    return _spread(count_by(activity, [index, "Type"]), index, "Type", "n", columns)


def mean_total(prs: DataFrame) -> DataFrame:
    return prs.agg(F.avg("Total").alias("mean_total"))


def share_of_total(df: DataFrame, col: str) -> DataFrame:
    """Add the group's percentage of the overall sum (one decimal) and its absolute value.

    The overall sum is one number, looked up as a scalar: no window over all groups.
    """
    overall = df.agg(F.sum(col).alias("s")).scalar()
    percent = F.round(F.col(col) * F.lit(100.0) / overall, 1).alias("pct")
    return df.select("*", percent, F.col(col).alias("absolute"))
