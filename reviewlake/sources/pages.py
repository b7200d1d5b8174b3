"""Landed API pages: ``{values: [record], next}`` documents, one row per record out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.schemas import JSON_OPTIONS, PR_PARENT, RECORD_TEXT, page_schema

#: Why a page or record was set aside, and its own text; NULL on good records.
REASON, REJECTED = "reject_reason", "reject_text"


def explode_pages(pages: DataFrame, item: T.StructType) -> DataFrame:
    """One row per record, with the repository and the parent id of its page.

    ``values`` holds the records as JSON text; it comes along whole as ``record_json``, fields outside the
    declared record included.
    """
    page = [c for c in pages.columns if c not in ("values", "next", "run_end")]
    rows = pages.select(*page, F.explode("values").alias(RECORD_TEXT))
    parsed = rows.withColumn("v", F.from_json(RECORD_TEXT, item, JSON_OPTIONS))
    return parsed.select(*page, RECORD_TEXT, *(F.col("v")[n].alias(n) for n in item.names))


def decode_pages(
    texts: DataFrame, item: T.StructType, column: str = "value", parent: str = PR_PARENT
) -> DataFrame:
    """Pages held as JSON text in ``column``; other columns are kept on every record."""
    keep = [c for c in texts.columns if c != column]
    page = F.from_json(F.col(column), page_schema(parent), JSON_OPTIONS).alias("p")
    inner = [f"p.{c}" for c in page_schema(parent).names if c not in (*keep, "run")]
    return explode_pages(texts.select(*keep, page).select(*keep, *inner), item)


def read_pages(
    spark: SparkSession,
    path: str,
    item: T.StructType,
    parent: str = PR_PARENT,
    multi_line: bool = False,
) -> DataFrame:
    """Records of all page files under ``path``.

    One page per line keeps the files splittable; ``multi_line`` reads one document per file.
    """
    reader = spark.read.schema(page_schema(parent)).options(**JSON_OPTIONS)
    return explode_pages(reader.option("multiLine", multi_line).json(path).drop("run"), item)


def sorted_out(
    texts: DataFrame, item: T.StructType, column: str = "value", parent: str = PR_PARENT
) -> DataFrame:
    """Like ``decode_pages``, but nothing stops the job: a page that is no page document, and a record whose
    fields have other types than declared, come as rows with ``reject_reason`` (page or record) and ``reject_text``,
    the other columns kept. Good records have neither.
    """
    keep = [c for c in texts.columns if c != column]
    lenient = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    shape = T.StructType([*page_schema(parent).fields, T.StructField("_bad", T.StringType())])
    pages = texts.withColumn("p", F.from_json(column, shape, lenient))
    broken = F.col("p").isNull() | F.col("p._bad").isNotNull() | F.col("p.values").isNull()
    reason = F.when(broken, F.lit("page"))
    inner = [f"p.{c}" for c in page_schema(parent).names if c not in (*keep, "values", "next", "run", "run_end")]
    # a page without records, or a broken one, is a row without a text
    rows = pages.select(*keep, *inner, F.col(column).alias("_page"), reason.alias(REASON), F.explode_outer("p.values").alias(RECORD_TEXT))
    rows = rows.where(F.col(RECORD_TEXT).isNotNull() | F.col(REASON).isNotNull())
    shape = T.StructType([*item.fields, T.StructField("_bad", T.StringType())])
    parsed = rows.withColumn("v", F.from_json(RECORD_TEXT, shape, lenient))
    bad = F.col(REASON).isNull() & (F.col("v").isNull() | F.col("v._bad").isNotNull())
    reason = F.when(bad, F.lit("record")).otherwise(F.col(REASON))
    text = F.when(bad, F.col(RECORD_TEXT)).when(F.col(REASON).isNotNull(), F.col("_page"))
    names = [c.split(".")[1] for c in inner]
    own = [F.when(reason.isNull(), F.col("v")[n]).alias(n) for n in item.names]
    return parsed.select(*keep, *names, RECORD_TEXT, *own, reason.alias(REASON), text.alias(REJECTED))


def split_rejected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and what was set aside as (repo, reject_reason, reject_text)."""
    good = rows.where(F.col(REASON).isNull()).drop(REASON, REJECTED)
    return good, rows.where(F.col(REASON).isNotNull()).select("repo", REASON, REJECTED)
