"""CSV export of the pull-request report and the scan the pivot reports start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.sources.store import spread_by_repo

#: Header of the export -> report column.
EXPORT_COLUMNS = {
    "ID": "pr_id",
    "SrcRepo": "src_repo",
    "SrcBranch": "src_branch",
    "DestRepo": "dest_repo",
    "DestBranch": "dest_branch",
    "Title": "title",
    "Description": "description",
    "State": "state",
    "Author": "author",
    "Created": "created",
    "Updated": "updated",
    "FileChanged": "file_changed",
    "Added": "added",
    "Removed": "removed",
    "Total": "total",
    "Type": "activity_type",
    "User": "activity_user",
}
PR_COLUMNS = list(EXPORT_COLUMNS)[:15]
_INTS = ("ID", "FileChanged", "Added", "Removed", "Total")

CSV_SCHEMA = T.StructType(
    [
        T.StructField(c, T.LongType() if c in _INTS else T.StringType())
        for c in [*EXPORT_COLUMNS, "repo"]
    ]
)

# Cell texts the pivot reports read as missing (the usual data-frame defaults).
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def export_frame(report: DataFrame) -> DataFrame:
    """Report rows under the export's header, plus ``repo``."""
    return report.select(
        *(F.col(c).alias(name) for name, c in EXPORT_COLUMNS.items()), "repo"
    )


def export_csv(report: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """One folder per repository. Quoted line breaks keep a file in one task when it is read
    back, so files are kept small and a large repository gets many of them."""
    (
        spread_by_repo(export_frame(report))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def _present(name: str) -> Column:
    return F.when(~F.col(name).isin(*MISSING), F.col(name)).alias(name)


def parse_csv(rows: DataFrame) -> DataFrame:
    """Missing cells to NULL, ``Created`` and ``Updated`` to timestamps."""
    text = [
        f.name
        for f in CSV_SCHEMA
        if isinstance(f.dataType, T.StringType) and f.name not in ("Created", "Updated", "repo")
    ]
    return rows.select(
        *(
            _present(c)
            if c in text
            else F.col(c).try_cast("timestamp").alias(c)
            if c in ("Created", "Updated")
            else F.col(c)
            for c in EXPORT_COLUMNS
        )
    )


def read_activity_csv(
    spark: SparkSession, path: str, header: Sequence[str] | None = None
) -> DataFrame:
    """All CSV files under ``path`` as one frame.

    Files have the export's header, or ``header`` in its order; files of several layouts are read
    one layout at a time. A file with another header and a cell that is no number where one belongs
    stop the job: neither may become missing values unnoticed.
    """
    names = [*(EXPORT_COLUMNS if header is None else header), "repo"]
    rows = (
        spark.read.schema(T.StructType([CSV_SCHEMA[n] for n in names]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return parse_csv(rows)
