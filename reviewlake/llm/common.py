"""Helpers of the operators: inputs, shared tables, Arrow slices, hashing, small models."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import shared_dir


#: Places that a hash of an id may take when a share of the ids is chosen.
HASH_PLACES = 1 << 40

_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context; tasks import it."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if context.applicationId in _SHIPPED or not package.is_dir():  # no folder: it was shipped itself
        return
    folder = tempfile.TemporaryDirectory()  # of the driver; executors fetch the file from it
    archive = Path(folder.name, f"reviewlake-{context.applicationId}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED[context.applicationId] = folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at files all executors see."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Row slices of the batches whose ``column`` holds at most ``max_bytes`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        lengths = pc.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression without intercept, by Newton steps; deterministic. ``counts``: equal rows of each."""
    n = np.ones(len(y)) if counts is None else counts
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (p - y)) + l2 * weights
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def known_labels(marks: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the training rows; repeated labels of a document count once, the greatest."""
    known = marks.filter(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return known.filter(~held_out(F.col("doc_id")))


def labelled_sample(docs: DataFrame, marks: DataFrame, column: str, rows: int) -> DataFrame:
    """(text, label) of about ``rows`` training documents of each label, all of a label that has fewer.

    A document is in the sample if a hash of its id lies below the share of ``rows`` among its label, so no label
    is sorted and none meets in one task. Rows held out are never in it. An id counts once, with
    the text least by a hash.
    """
    known = known_labels(marks, column)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(HASH_PLACES))
    below = F.coalesce(*(F.when(F.col("label") == label, rows * HASH_PLACES // n) for label, n in sizes.items()), F.lit(0))
    chosen = known.filter(place < below)
    # about 2 * rows ids: bounded
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    least = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    return cut(least.select("text", "label"), f"sample-{column}")
