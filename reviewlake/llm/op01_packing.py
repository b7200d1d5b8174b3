"""Harmonic packing of token pieces into sequences of fixed capacity.

Class k holds the pieces with capacity // length = k, that is lengths in (C/(k+1), C/k]; a bin of
class k takes exactly k pieces, whichever they are, so every worker can fill bins alone. There are
about 2 sqrt(C) non-empty classes. Documents are cut first: whole sequences, then a remainder in at most
three pieces chosen by a small table so that pieces lie just below C/k. A cut costs ``CUT_COST`` tokens
in that choice and pieces below ``LEAST_PIECE`` tokens are not cut off.

A class is numbered in ``spark.sql.shuffle.partitions`` buckets, so the class of whole sequences, which
holds most tokens, is never one task; the counts of the buckets give each its first number. What is
left of a class, fewer than k pieces, is packed by best fit decreasing: at most the sum of k - 1 over the
classes, under 10,000 pieces for 2,048 tokens whatever the input.

Null or empty text: one piece, the end id. Null doc_id: kept. Repeated rows are packed once for each row.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import cut, documents, slices
from reviewlake.llm.tokens import REMEMBERED, library_encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 1
CUT_COST = 6
LEAST_PIECE = 16
SLICE_BYTES = 4_000_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=4)
def remainder_cuts(capacity: int) -> list[list[int]]:
    """For every length below the capacity the piece lengths, longest first, with the least waste."""
    length = np.arange(capacity + 1)
    share = capacity / (capacity // np.maximum(length, 1)) - length
    share[0] = np.inf
    best = [share]
    first: list[np.ndarray] = []
    piece = share.copy()
    piece[:LEAST_PIECE] = np.inf
    for _ in range(2):
        cost, choice = np.full(capacity + 1, np.inf), np.zeros(capacity + 1, dtype=int)
        for r in range(2 * LEAST_PIECE, capacity + 1):
            rest = best[-1] if len(best) > 1 else piece
            both = piece[LEAST_PIECE : r - LEAST_PIECE + 1] + rest[r - LEAST_PIECE : LEAST_PIECE - 1 : -1] + CUT_COST
            choice[r] = LEAST_PIECE + int(both.argmin())
            cost[r] = both[choice[r] - LEAST_PIECE]
        best.append(cost)
        first.append(choice)

    def cuts(r: int) -> list[int]:
        n = int(np.argmin([b[r] for b in best]))
        out = []
        while n:
            out.append(int(first[n - 1][r]))
            r -= out[-1]
            n -= 1
        return sorted([*out, r], reverse=True)

    return [cuts(r) if r else [] for r in range(capacity)]


def cut_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    with_ids: bool = False,
    slice_bytes: int = SLICE_BYTES,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Pieces of every document of ``docs`` (doc_id, text); ``with_ids`` adds them as an array of int. A Python worker encodes
    ``slice_bytes`` of text at once and keeps ids of at most twice ``remembered`` words; neither changes the rows."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = library_encoder(vocabulary, remembered), remainder_cuts(capacity)
        end = np.array([end_id], dtype="<u4")
        for batch in slices(batches, 1, slice_bytes):
            rows: list[tuple] = []
            tokens, bounds = encoder.encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                ids = np.concatenate([tokens[a:b], end])
                n = len(ids)
                at = 0
                for length in [capacity] * (n // capacity) + table[n % capacity]:
                    own = ids[at : at + length]
                    rows.append((doc_id, at, length, zlib.crc32(own.tobytes()), n, own if with_ids else None))
                    at += length
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pieces, PIECE + ", ids array<int>" * with_ids)


def best_fit(pieces: pd.DataFrame, capacity: int, first_sequence: int) -> pd.DataFrame:
    """Sequence and offset of pieces by best fit decreasing."""
    pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
    room: list[tuple[int, int]] = []
    sequences, offsets = [], []
    opened = 0
    for length in pieces["length"]:
        i = bisect_left(room, (length, -1))
        left, sequence = room.pop(i) if i < len(room) else (capacity, opened)
        opened += sequence == opened
        sequences.append(first_sequence + sequence)
        offsets.append(capacity - left)
        if left > length:
            insort(room, (left - length, sequence))
    return pieces.assign(sequence_id=sequences, offset=offsets)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (written, since read twice) with sequence_id and offset; sequences are numbered from 0."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = F.floor(F.lit(capacity) / F.col("length")).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")
    classed = pieces.withColumns({"_class": kind, "_bucket": bucket})
    counts = classed.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    in_order = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_class", "_bucket", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("_class")).alias("_all"), "_n"
    )
    counts = cut(counts, "pack-counts")  # at most 2 sqrt(capacity) classes times the buckets
    classes = [(r["_class"], r["n"] // r["_class"]) for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).orderBy("_class").collect()]
    bases, total = {}, 0
    for k, bins in classes:
        bases[k] = total
        total += bins
    base = F.create_map(*[F.lit(x) for pair in bases.items() for x in pair])[F.col("_class")] if bases else F.lit(0)
    own = Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "length", "ids_crc32")
    ranked = (
        classed.withColumn("_rank", F.row_number().over(own) - 1)
        .join(F.broadcast(counts.drop("_n")), ["_class", "_bucket"])
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
        .withColumn("_bin", F.floor(F.col("_rank") / F.col("_class")))
    )
    whole = F.col("_bin") < F.floor(F.col("_all") / F.col("_class"))
    in_bin = Window.partitionBy("_class", "_bin").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = pieces.columns
    full = ranked.filter(whole).select(
        *columns, (base + F.col("_bin")).cast("long").alias("sequence_id"), F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset")
    )
    schema = T.StructType(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")
    rest = ranked.filter(~whole).select(*columns, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(lambda rows: best_fit(rows[columns], capacity, total), schema)
    return full.unionByName(rest)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **cutting) -> DataFrame:
    """Packed pieces of ``docs``: where each piece lies in its document and in its sequence. ``cutting``: see ``cut_pieces``."""
    return pack(cut(cut_pieces(docs, capacity, **cutting), "pieces"), capacity)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
