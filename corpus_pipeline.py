"""The corpus pipeline: toxicity, quality rules, near-duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet in the
shared folder and read again as the next stage's docs, so every stage starts from files that all
executors see. All stages but the last return the columns of ``docs``.

Null or empty text passes toxicity and falls to the quality rules. Nulls in other columns are carried along, as are
extra columns of any name. Repeated rows are near-duplicates, so one stays; rows without an id come last among those of a
group, rows of one id with different texts all stay. Texts are read whole at any length. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import op01_packing, op03_suffixes, op05_toxicity, op09_simhash, op10_repetition
from reviewlake.llm.common import cut, documents, labels, ship


#: Rows of an Arrow batch: five stages share the Python workers of an executor, and texts may be long.
BATCH_ROWS = 500
#: What the last stage encodes at once and remembers: its workers still hold what earlier stages left.
PACKING_SLICE = 1 << 20
PACKING_WORDS = 40_000


def ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not toxic, by a model learned from the labelled training rows among them."""
    ready(spark)
    return op05_toxicity.keep_clean(docs, op05_toxicity.train(docs, labels(spark, sf_dir)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the repetition rules keep."""
    ready(spark)
    return op10_repetition.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near-duplicates, by the operator's shingles and bit distance: the one with the least doc_id."""
    ready(spark)
    return op09_simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without repeated passages; characters cut in part go, n_chars follows."""
    ready(spark)
    return op03_suffixes.cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in packed sequences."""
    ready(spark)
    return op01_packing.pack_documents(docs, slice_bytes=PACKING_SLICE, remembered=PACKING_WORDS)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: The learned, tokenized and byte-level stages have no form in the check's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
