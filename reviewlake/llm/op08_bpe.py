"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before white space that follows other characters: no match of the split pattern
spans such a place, so the ids are those of the whole text. The separators U+001C to U+001F are no white space
to that pattern, so no text is cut there. A very long run of white space, on which the library's regular
expression runs out of stack, is one match but for its last character, and is encoded as that match. Ids are decoded to raw bytes, not to text,
because a token may hold part of a character.

Null or empty text: no ids. Rows are independent, so repeated rows and ids give repeated results;
other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import documents, slices
from reviewlake.llm.tokens import rank_encoding

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


SLICE_BYTES = 1_000_000
#: Texts beyond this are cut before white space behind another character.
LONG_CHARS = 50_000
CUT = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")


#: Runs of white space that are encoded as one match.
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{10000,}")


def chunks(text: str, size: int = LONG_CHARS) -> Iterator[str]:
    """Parts of about ``size`` characters, or longer where no safe place follows."""
    start = 0
    while len(text) - start > size:
        place = CUT.search(text, start + size)
        if not place:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:]


def encode_text(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """Ids of a whole text of any length."""
    ids: list[int] = []
    start = 0
    for run in LONG_SPACE.finditer(text):
        # all of a run is a match at the end of a text, else its last character goes with what follows
        stop = run.end() - (run.end() < len(text))
        ids += [i for part in chunks(text[start : run.start()]) for i in encoding.encode_ordinary(part)]
        ids += encoding._encode_single_piece(text[run.start() : stop])
        start = stop
    return ids + [i for part in chunks(text[start:]) for i in encoding.encode_ordinary(part)]


def encode_texts(docs: DataFrame, ranks: str = RANKS, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with a column ``to``: the ids of ``text``, an array of int."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = rank_encoding(ranks)
        for batch in batches:
            yield pd.Series([np.array(encode_text(t or "", encoding), dtype=np.int32) for t in batch])

    return docs.withColumn(to, encode(F.col(text)))


def decode_ids(tokens: DataFrame, ranks: str = RANKS, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """``tokens`` with a column ``to``: the bytes that ``ids`` stand for. Null ids: no bytes."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = rank_encoding(ranks)
        for batch in batches:
            yield pd.Series([b"" if x is None else encoding.decode_bytes(np.asarray(x).tolist()) for x in batch])

    return tokens.withColumn(to, decode(F.col(ids)))


def round_trip(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id with the number of ids of its text and digests of the ids and of the bytes they decode to.

    One pass; a task holds the ids of one text at a time.
    """

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(ranks)
        for batch in slices(batches, 1, SLICE_BYTES):
            counts, digests, decoded = [], [], []
            for text in batch.column(1):
                ids = encode_text(text.as_py() or "", encoding)
                counts.append(len(ids))
                digests.append(sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded.append(sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return docs.select("doc_id", "text").mapInArrow(there_and_back, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
