"""Table versions: data files that never change, and a small manifest that names the live ones.

A write adds files below ``data/version=<new>/run=/repo=/bucket=`` and then commits a manifest, itself a parquet
file of one row a data file. Spark's commit moves that single file into place, so readers see the old or the
new version, never a mixture, and a write that stops anywhere changes nothing. Rows lie in buckets by a hash of their
key; a batch opens and rewrites the buckets of its keys only.

One writer at a time and table. Files of old versions stay until ``vacuum``.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.schemas import BUCKETS, KEYS, SCHEMAS, SORTED_BY

NO_RUN = "-"
LAYOUT = ("run", "repo", "bucket")
MANIFEST = "file string, repo string, bucket int, rows long, run string, batch long, live boolean"


@dataclass(frozen=True)
class DataFile:
    """A file of one repository and bucket. Files of a run that has not ended are not live."""

    file: str
    repo: str | None
    bucket: int
    rows: int
    run: str = NO_RUN
    batch: int = -1
    live: bool = True


@dataclass
class Version:
    """A committed state of a table; number 0 is a table that does not exist yet."""

    number: int
    buckets: int
    files: list[DataFile] = field(default_factory=list)

    def live(self, repos: Collection[str] | None = None) -> list[DataFile]:
        return [f for f in self.files if f.live and (repos is None or f.repo in repos)]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row; the repository is a folder of its own already."""
    own = [k for k in keys if k != "repo"]
    return F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int") if buckets > 1 else F.lit(0)


def with_bucket(df: DataFrame, table: str, version: Version) -> DataFrame:
    return df.withColumn("bucket", bucket_of(KEYS.get(table, ("repo",)), version.buckets))


def newest(spark: SparkSession, path: str, table: str) -> Version:
    """The last committed version."""
    try:
        manifests = spark.read.schema(f"{MANIFEST}, v long").parquet(f"{path}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return Version(0, BUCKETS.get(table, 1))
    number = manifests.agg(F.max("v")).first()[0]
    if number is None:
        return Version(0, BUCKETS.get(table, 1))
    rows = manifests.where(F.col("v") == number).drop("v").collect()
    (head,) = (r for r in rows if r.file is None)  # its bucket is their number
    return Version(number, head.bucket, [DataFile(*r) for r in rows if r.file is not None])


def commit(spark: SparkSession, path: str, last: Version, files: Iterable[DataFile]) -> None:
    """Make ``files`` the next version. What a stopped commit left under its number is overwritten."""
    rows = [(None, None, last.buckets, 0, None, None, None)]
    rows += [(f.file, f.repo, f.bucket, f.rows, f.run, f.batch, f.live) for f in files]
    table = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    table.write.mode("overwrite").parquet(f"{path}/manifest/v={last.number + 1}")


def read_files(spark: SparkSession, path: str, table: str, files: Iterable[DataFile]) -> DataFrame:
    """Rows of the given files in the table's declared schema."""
    names = [f"{path}/{f.file}" for f in files]
    schema = SCHEMAS[table]
    if not names:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    return reader.parquet(*names).select(*schema.names)


def add_files(
    df: DataFrame, path: str, table: str, batch: int = -1, live: bool = True, spread: bool = True
) -> list[DataFile]:
    """Write ``df`` (with ``bucket``, and ``run`` if it is part of one) as new files; returns them.

    A large bucket is cut over many tasks and small ones are packed, unless ``spread`` is false because they lie so
    already; rows are sorted by the column that readers filter on. What was written is read from the files: nothing is kept or computed twice.
    """
    spark, folder = df.sparkSession, f"data/version={uuid.uuid4().hex}"
    rows = df if "run" in df.columns else df.withColumn("run", F.lit(NO_RUN))
    placed = rows.hint("rebalance", *LAYOUT) if spread else rows
    ordered = placed.sortWithinPartitions(*LAYOUT, *SORTED_BY[table])
    ordered.write.partitionBy(*LAYOUT).parquet(f"{path}/{folder}")
    layout = T.StructType.fromDDL("run string, repo string, bucket int")
    written = spark.read.schema(layout).option("basePath", f"{path}/data").parquet(f"{path}/{folder}")
    found = written.groupBy(*LAYOUT, F.col("_metadata.file_path").alias("file")).count().collect()
    return [
        DataFile(folder + unquote(r.file).split(folder, 1)[1], r.repo, r.bucket, r["count"], r.run, batch, live)
        for r in found
    ]


def vacuum(spark: SparkSession, path: str, table: str, keep: int = 2) -> int:
    """Remove data files and manifests that none of the last ``keep`` versions needs; the number of
    files removed. Readers of older versions must have ended."""
    manifests = spark.read.schema(f"{MANIFEST}, v long").parquet(f"{path}/manifest")
    last = newest(spark, path, table).number
    old = F.col("v") <= last - keep
    needed = manifests.where(~old).select("file").distinct()
    dead = manifests.where(old & F.col("file").isNotNull()).select("file").distinct()
    names = [r.file for r in dead.join(needed, "file", "left_anti").collect()]
    numbers = [r.v for r in manifests.where(old).select("v").distinct().collect()]
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in [*names, *(f"manifest/v={n}" for n in numbers)]:
        place = paths(f"{path}/{name}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(names)
