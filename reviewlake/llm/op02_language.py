"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of sampled training texts. A text is
reduced to its words in lower case and compressed with each, and the language with the fewest bytes wins. Long texts are compressed in
blocks of ``BLOCK_BYTES``, all of them, so that the dictionary counts everywhere. The score is the margin:
the share of bytes saved against the second best, scaled to 1 at ``FULL_MARGIN``. Below ``LEAST_MARGIN`` the
prediction is marked ``rejected``.

Sample: of each language the ``SAMPLE_ROWS`` different training texts first in the order of a hash of the text, so copies
count once. Of a text longer than ``SAMPLE_BLOCKS`` blocks of ``BLOCK_CHARS`` characters that many blocks are taken, by a hash
of their numbers, from anywhere in it.

Null text or text without a letter: ``und`` with score 0, rejected; so is everything if no row has a language.
Ties go to the language with more training rows, then to the name. Repeated rows and ids get equal results,
a null doc_id is kept, other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import documents, held_out

SAMPLE_ROWS = 64
SAMPLE_BLOCKS = 4
BLOCK_CHARS = 500
BLOCK_BYTES = 4_096
LEVEL = 3
LEAST_MARGIN = 0.01
FULL_MARGIN = 0.2
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> str:
    """The words of a text in lower case, without marks and digits; a word repeated at once counts once."""
    return " ".join(word for word, _ in groupby(WORD.findall((text or "").lower())))


def blocks(text: str) -> Column:
    """Some blocks of a text's characters in their order, all of a short text's, joined by spaces."""
    last = f"(greatest(length({text}), 1) - 1) div {BLOCK_CHARS}"
    picked = f"slice(array_sort(transform(sequence(0L, {last}), i -> struct(xxhash64(hash, i) as h, i as i))), 1, {SAMPLE_BLOCKS})"
    in_order = f"array_sort(transform({picked}, p -> p.i))"
    return F.expr(f"array_join(transform({in_order}, i -> substring({text}, cast(i * {BLOCK_CHARS} + 1 as int), {BLOCK_CHARS})), ' ')")


def learn(training: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary) from ``training`` (text, lang), most frequent language first."""
    rows = training.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("hash"))
    counts = rows.groupBy("lang").count()
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = rows.select("lang", "hash").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_ROWS)
    # SAMPLE_ROWS texts a language: bounded; copies of one add up before the shuffle
    found = rows.join(F.broadcast(chosen), ["lang", "hash"]).withColumn("text", blocks("text"))
    sample = found.groupBy("lang", "n").agg(F.min("text").alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.collect():
        texts.setdefault(row["lang"], []).append((row["n"], plain(row["text"])))
    ranked = sorted(counts.collect(), key=lambda r: (-r["count"], r["lang"]))
    return [(r["lang"], " ".join(t for _, t in sorted(texts.get(r["lang"], []))).encode()) for r in ranked]


def classify(text: Column, dictionaries: list[tuple[str, bytes]]) -> Column:
    """A struct of lang_pred, score and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        languages = [
            (lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
            for lang, data in dictionaries
            if len(data) >= 8
        ]

        def one(text: str | None) -> tuple[str, float, bool]:
            words = plain(text)
            data = words.encode()
            if not languages or not any(map(str.isalpha, words)):
                return UNDETERMINED, 0.0, True
            blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
            sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in languages]
            best = min(sizes)
            at = sizes.index(best)
            second = min(sizes[:at] + sizes[at + 1 :], default=best * 2)
            margin = 1 - best / second
            return languages[at][0], min(1.0, margin / FULL_MARGIN), margin < LEAST_MARGIN

        for batch in batches:
            yield pd.DataFrame([one(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    return predict(text)


def predict_languages(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), classify(F.col("text"), dictionaries).alias("p")).select(
        "doc_id", "held_out", "p.*"
    )


def op2_language_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict_languages(docs, learn(docs.filter(~held_out(F.col("doc_id")))))
