"""Numbered pages over a total order.

A page near the front is a top-k: each task keeps its first ``page * size`` rows. A page millions
of rows in would make that one large group, so a caller asks for it with ``deep``: the sorted frame is written
once to the shared folder, rows are counted per file, and only the files that hold the page are read. Tables
page narrow keys and look up the rows of the page afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.session import shared_dir

DEFAULT_PAGE = 1
DEFAULT_SIZE = 20
MAX_SIZE = 200


@dataclass(frozen=True)
class Page:
    """One page: the lazy rows, the lazy one-row total, and the page actually used."""

    rows: DataFrame
    total: DataFrame
    page: int
    size: int


def clamp_page(page: int | None = None, size: int | None = None) -> tuple[int, int]:
    """Page below 1 becomes 1; a size outside 1..200 becomes 20."""
    page = DEFAULT_PAGE if page is None or page < 1 else page
    size = DEFAULT_SIZE if size is None or size < 1 or size > MAX_SIZE else size
    return page, size


def paged(
    df: DataFrame,
    order: Sequence[Column | str],
    page: int | None = None,
    size: int | None = None,
    counted: DataFrame | None = None,
    deep: bool = False,
) -> Page:
    """``order`` must be unique. A page past the end is empty. ``counted`` has as many rows as
    ``df`` and is cheaper to count. With ``deep`` the page is read from a written sort, which runs a
    job right away; else all is lazy. The rows are the same.
    """
    page, size = clamp_page(page, size)
    first = (page - 1) * size
    if deep:
        rows = _from_sorted_files(df, order, first, size)
    else:
        rows = df.orderBy(*order).offset(first).limit(size)
    total = (df if counted is None else counted).agg(F.count(F.lit(1)).alias("total"))
    return Page(rows, total, page, size)


def _from_sorted_files(
    df: DataFrame, order: Sequence[Column | str], first: int, size: int
) -> DataFrame:
    """Rows ``first .. first + size`` of the global order."""
    spark = df.sparkSession
    path = shared_dir(spark, "sorted")
    df.orderBy(*order).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    # Files follow the order of the range partitions that wrote them: part-<n>-...-c<m>.
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("int")
    files = stored.groupBy(
        number(r"^part-(\d+)").alias("n"), number(r"-c(\d+)\.").alias("m"), name.alias("file")
    ).count()
    before, skipped, wanted = 0, 0, []
    for f in files.orderBy("n", "m").collect():
        if before + f["count"] <= first:
            skipped = before + f["count"]
        elif before < first + size:
            wanted.append(f["file"])
        before += f["count"]
    held = stored.where(name.isin(wanted)) if wanted else stored.limit(0)
    return held.orderBy(*order).offset(first - skipped).limit(size)


def page_count(total: Column | str, size: int = DEFAULT_SIZE) -> Column:
    """Number of pages, at least one."""
    total = F.col(total) if isinstance(total, str) else total
    return F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(size)))
