"""Line counts of unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines_starting(text: Column | str, prefix: str) -> Column:
    """Number of lines that start with ``prefix``.

    Each hit is a newline followed by the prefix, so removing the hits shortens the text by a
    known number of bytes. Whole texts of any length are handled without building line arrays.
    """
    text = F.col(text) if isinstance(text, str) else text
    mark = "\n" + prefix
    lined = F.concat(F.lit("\n"), text)
    shorter = F.octet_length(F.replace(lined, F.lit(mark), F.lit("")))
    return ((F.octet_length(lined) - shorter) / len(mark)).cast("int")


def changed_lines(text: Column | str, sign: str) -> Column:
    """Lines with one ``sign``, file headers (three of them) left out."""
    return lines_starting(text, sign) - lines_starting(text, sign * 3)


def diff_line_counts(diffs: DataFrame) -> DataFrame:
    """``repo, pr_id, diff`` -> one added/removed row per pull request."""
    text = F.coalesce("diff", F.lit(""))
    return diffs.select(
        "repo",
        "pr_id",
        changed_lines(text, "+").alias("lines_added"),
        changed_lines(text, "-").alias("lines_removed"),
    )
