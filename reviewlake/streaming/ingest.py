"""Incremental ingest: landed page files as a stream, each micro-batch written rerun-safe.

A micro-batch may be delivered again after a failure; upsert and replacement give the same
table then, so no further bookkeeping is needed. Tables that are replaced per repository are fed by runs: pages carry
their run's id, the last one ``run_end``; batches are staged in the table's files and become the repository's rows when the
run has ended, however many batches it took.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlake.operators.projections import (
    PROJECTIONS,
    TABLE_OF,
    stamp_activity_parent,
    stamp_parent,
)
from reviewlake.schemas import JSON_OPTIONS, RECORDS, page_schema
from reviewlake.sources.pages import explode_pages, sorted_out, split_rejected
from reviewlake.sources.store import (
    spread_by_repo,
    touched_repos,
    write_absent,
    write_replace,
    write_run,
    write_upsert,
)
from reviewlake.sources.versions import NO_RUN

UPSERTED = ("pull_requests", "pipelines", "deployments")


def flatten(rows: DataFrame, record: str) -> DataFrame:
    """Landed records (with ``repo``) to their raw table's rows."""
    if record == "activity":
        rows = stamp_activity_parent(rows)
    elif TABLE_OF[record] not in UPSERTED:
        rows = stamp_parent(rows)
    return PROJECTIONS[record](rows)


def stream_pages(spark: SparkSession, path: str, as_text: bool = False, **options) -> DataFrame:
    """New page files under ``path`` as a stream, parsed or as text. ``seq`` is the landing time of the
    page's file: of two pages that hold the same record, the later file wins."""
    reader = spark.readStream.options(**options)
    landed = F.col("_metadata.file_modification_time").cast("double").alias("seq")
    if as_text:
        return reader.schema("value string, repo string").text(path).select("*", landed)
    return reader.schema(page_schema()).options(**JSON_OPTIONS).json(path).select("*", landed)


def write_batch(
    record: str, path: str, runs: bool = False, rejected: str | None = None
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of a record kind over its pages; as texts if ``rejected`` is given."""
    table = TABLE_OF[record]

    def records(pages: DataFrame, batch_id: int) -> DataFrame:
        if rejected is None:
            return explode_pages(pages.drop("run"), RECORDS[record])
        good, bad = split_rejected(sorted_out(pages, RECORDS[record]))
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")  # again if delivered again
        return good

    def keyed(pages: DataFrame, batch_id: int) -> None:
        """Batches are cut by their number of files, so one is kept while it is read twice."""
        spark = pages.sparkSession
        batch = flatten(records(pages, batch_id), record).persist()
        try:
            if table in UPSERTED:
                write_upsert(spark, batch, path, table, "seq")
            else:
                write_absent(spark, batch, path, table)
        finally:
            batch.unpersist()

    def replaced(pages: DataFrame, batch_id: int) -> None:
        spark = pages.sparkSession
        if not runs:
            rows = flatten(records(pages, batch_id), record)
            write_replace(spark, rows, path, table, touched_repos(pages))
            return
        pages = pages.withColumn("run", F.coalesce("run", F.lit(NO_RUN)))
        # pages are moved instead of their rows, which hold every record twice: as text and as columns
        rows = flatten(explode_pages(spread_by_repo(pages.drop("seq"), "run"), RECORDS[record]), record)
        ends = pages.where("run_end").select("repo", "run").distinct().collect()  # a row a repository
        write_run(spark, rows, path, table, batch_id, [tuple(r) for r in ends], True)

    return keyed if table in UPSERTED or table == "pr_pipelines" else replaced


def start_ingest(
    spark: SparkSession,
    source: str,
    record: str,
    path: str,
    checkpoint: str | None = None,
    files_per_batch: int = 10_000,
    runs: bool = False,
    rejected: str | None = None,
) -> StreamingQuery:
    """Ingest everything landed so far and stop; call again for what lands next. What was read
    is remembered in ``checkpoint``, by default a folder next to the table.

    Upserted tables take any number of files per batch, and so do replaced ones with ``runs``: their pages
    carry a run id, and the page that lands last ``run_end``. Without, a replaced table needs all pages of a
    repository's run in one batch, so its batches are not cut: start it when a run has landed.

    Malformed pages and records stop the stream, unless ``rejected`` names a folder: then they are set aside there,
    with reason and text, and the others go on. Pages must lie in ``repo=`` folders and be one a line for that.
    """
    if runs and rejected:
        raise ValueError("a run with rejected pages must not replace its repository")
    table = TABLE_OF[record]
    options = {"maxFilesPerTrigger": files_per_batch} if table in UPSERTED or runs else {}
    return (
        stream_pages(spark, source, rejected is not None, **options)
        .writeStream.foreachBatch(write_batch(record, path, runs, rejected))
        .option("checkpointLocation", checkpoint or f"{path.rstrip('/')}.checkpoint")
        .trigger(availableNow=True)
        .start()
    )
