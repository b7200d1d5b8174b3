"""Rerun-safe writes: keyed upsert, insert-if-absent and replacement per repository.

Tables are versions of parquet files (``versions``): a write reads and rewrites the key buckets it touches, or only
adds files, and becomes visible by one commit. A lost executor costs the tasks it ran; a lost driver leaves
the last version as it was. A rerun of the same batch gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.schemas import KEYS, conform
from reviewlake.sources import versions
from reviewlake.sources.raw import of_repos
from reviewlake.sources.versions import Version, with_bucket


def latest_per_key(new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last write per key within a batch. The top row is picked per input task before the
    shuffle, so repeated writes of one key do not pile up in one task."""
    rest = [F.col(c).desc() for c in new.columns if c not in keys and c != seq]
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc(), *rest)
    ranked = new.withColumn("_rank", F.row_number().over(order))
    return ranked.where("_rank = 1").drop("_rank")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """``existing`` with the rows of ``new`` replacing those of the same key.

    The anti join needs only the distinct keys of the batch: while those are small, the stored table
    is neither shuffled nor sorted, and many writes of one key are one row of each task.
    """
    kept = existing.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*existing.columns)
    return kept.unionByName(latest_per_key(new, keys, seq).select(*existing.columns))


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key.

    The stored side is first reduced to the keys of the batch, so its size does not decide how
    much is shuffled.
    """
    keys = list(keys)
    batch = new.dropDuplicates(keys)
    known = existing.join(batch.select(*keys), keys, "left_semi").select(*keys)
    return batch.join(known, keys, "left_anti").select(*new.columns)


def replace_partition(existing: DataFrame, new: DataFrame, repos: Sequence[str]) -> DataFrame:
    """All rows of ``repos`` replaced by ``new``; a repository without new rows ends empty."""
    kept = existing.where(~F.col("repo").isin(list(repos)))
    return kept.unionByName(of_repos(new, repos).select(*existing.columns))


# --- writers ---------------------------------------------------------------------------------


def spread_by_repo(df: DataFrame, *within: str) -> DataFrame:
    """Rows of a repository (and of equal ``within``) together, a large one cut over many tasks and small ones packed:
    adaptive execution sizes the pieces from what the shuffle actually holds."""
    return df.hint("rebalance", *within, "repo")


def touched_repos(df: DataFrame) -> list[str]:
    """Repositories a batch writes to: one name each, bounded by the ingest's repository list."""
    return [r.repo for r in df.select("repo").distinct().collect()]


def _touched(df: DataFrame) -> set[tuple[str, int]]:
    """(repo, bucket) of a batch: bounded by the number of buckets of its repositories."""
    return {(r.repo, r.bucket) for r in df.select("repo", "bucket").distinct().collect()}


def write_upsert(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    table: str,
    seq: str = "seq",
    buckets: int | None = None,
) -> None:
    """Merge a batch into a stored table; only buckets that hold keys of the batch are rewritten.

    ``buckets`` is the number of key buckets of a repository in a table that does not exist yet: the more,
    the less a small batch rewrites of a large repository, and the more files small ones have.
    """
    last = versions.newest(spark, path, table)
    if buckets and not last.number:
        last = Version(0, buckets)
    touched = _touched(with_bucket(new, table, last))
    if not touched and last.number:
        return
    old = {f for f in last.live() if (f.repo, f.bucket) in touched}
    rows = upsert(versions.read_files(spark, path, table, old), new, KEYS[table], seq)
    added = versions.add_files(with_bucket(rows, table, last), path, table)
    versions.commit(spark, path, last, [*(f for f in last.files if f not in old), *added])


def write_absent(spark: SparkSession, new: DataFrame, path: str, table: str) -> None:
    """Add the rows whose key is not stored; only buckets of the batch's keys are read, none rewritten."""
    last = versions.newest(spark, path, table)
    rows = with_bucket(conform(new, table), table, last)
    touched = _touched(rows)
    known = versions.read_files(spark, path, table, (f for f in last.live() if (f.repo, f.bucket) in touched))
    added = versions.add_files(insert_absent(known, rows, KEYS[table]), path, table)
    if added or not last.number:
        versions.commit(spark, path, last, [*last.files, *added])


def write_replace(
    spark: SparkSession, new: DataFrame, path: str, table: str, repos: Sequence[str]
) -> None:
    """Replace ``repos`` in a stored table. A repository that gets no rows ends empty."""
    last = versions.newest(spark, path, table)
    rows = with_bucket(conform(of_repos(new, repos), table), table, last)
    added = versions.add_files(rows, path, table)
    kept = [f for f in last.files if not f.live or f.repo not in set(repos)]
    versions.commit(spark, path, last, [*kept, *added])


def write_run(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    table: str,
    batch: int,
    ended: Sequence[tuple[str, str]],
    together: bool = False,
) -> None:
    """One micro-batch of runs that replace their repositories: rows (with ``run``) are staged, and those of
    every ended (repo, run) become the repository's only rows, in the same commit.

    A batch that is delivered again replaces what it staged before. Runs of a repository end in the order of their
    ids; what an older run staged and never ended goes then. An ended run without rows empties its repository.

    ``together`` says that rows of a run and repository lie in few tasks already; they are not moved then, unless
    the repository has buckets.
    """
    last = versions.newest(spark, path, table)
    rows = with_bucket(conform(new, table, keep=["run"]), table, last)
    added = versions.add_files(rows, path, table, batch, live=False, spread=not together or last.buckets > 1)
    runs = {f.run for f in added} | {run for _, run in ended}
    files = [f for f in last.files if not (f.batch == batch and f.run in runs)] + added
    for repo, run in sorted(ended, key=lambda e: e[1]):
        others = [f for f in files if f.repo != repo or not f.live and f.run > run]
        files = others + [replace(f, live=True) for f in files if f.repo == repo and f.run == run]
    versions.commit(spark, path, last, files)


def compact(spark: SparkSession, path: str, table: str, files: int = 32) -> None:
    """Rewrite buckets of more than ``files`` live files, as many small batches leave them."""
    last = versions.newest(spark, path, table)
    places: dict[tuple, list] = {}
    for f in last.live():
        places.setdefault((f.repo, f.bucket), []).append(f)
    old = {f for some in places.values() if len(some) > files for f in some}
    if old:
        rows = with_bucket(versions.read_files(spark, path, table, old), table, last)
        added = versions.add_files(rows, path, table)
        versions.commit(spark, path, last, [*(f for f in last.files if f not in old), *added])


def version(spark: SparkSession, path: str, table: str) -> Version:
    """The stored version; its number is 0 while there is none."""
    return versions.newest(spark, path, table)
