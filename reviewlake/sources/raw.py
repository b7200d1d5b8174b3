"""Raw-table scans: repository pruning and decoding of the lossless JSON column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.schemas import ADDED_LATER, JSON_OPTIONS, RECORD_TEXT, SCHEMAS
from reviewlake.sources.versions import newest, read_files


def of_repos(df: DataFrame, repos: Sequence[str] | None) -> DataFrame:
    """Rows of the requested repositories; on stored tables this prunes partitions."""
    return df if repos is None else df.where(F.col("repo").isin(list(repos)))


def read_table(
    spark: SparkSession, path: str, table: str, repos: Sequence[str] | None = None
) -> DataFrame:
    """A stored table in its declared schema; columns added later read as zero values.

    Only the live files of the repositories asked for are opened. A folder without versions is read as
    plain parquet, partitioned by ``repo``. Only columns added later are filled: an expression around a column would keep
    filters on it out of the scan, and all others are written without NULL. Declaring the read schema keeps a
    numeric-looking repository name text and saves the job that would infer it.
    """
    last = newest(spark, path, table)
    if last.number:
        rows = read_files(spark, path, table, last.live(None if repos is None else set(repos)))
    else:
        rows = spark.read.schema(SCHEMAS[table]).parquet(path)
    return of_repos(rows, repos).fillna("", subset=list(ADDED_LATER.get(table, ())))


def decode_raw(
    df: DataFrame, record: T.StructType, repos: Sequence[str] | None = None
) -> DataFrame:
    """``repo`` and the record parsed from ``raw_json``; ``pr_id`` comes from its own column. The text
    comes along, so what is projected from it again stays whole."""
    keep = [c for c in ("repo", "pr_id") if c in df.columns]
    text = F.col("raw_json").alias(RECORD_TEXT)
    parsed = F.from_json("raw_json", record, JSON_OPTIONS).alias("r")
    return of_repos(df, repos).select(*keep, text, parsed).select(*keep, RECORD_TEXT, "r.*")


def pr_links(df: DataFrame, repos: Sequence[str] | None = None) -> DataFrame:
    """Distinct pull request to pipeline links in long form."""
    return of_repos(df, repos).select("repo", "pr_id", "pipeline_uuid").distinct()


def pr_link_lists(
    df: DataFrame, repos: Sequence[str] | None = None, parts: int = 1
) -> DataFrame:
    """Sorted pipeline ids per pull request.

    With ``parts`` above 1 every list is dealt over that many rows by a hash of the pipeline, so no
    row takes a very long one whole; ``part`` numbers them. What ``parts`` is, the caller decides, not the data.
    """
    part = F.pmod(F.xxhash64("pipeline_uuid"), F.lit(parts)).cast("int").alias("part")
    ids = F.array_sort(F.collect_list("pipeline_uuid")).alias("pipeline_uuids")
    return pr_links(df, repos).groupBy("repo", "pr_id", part).agg(ids)

