"""Fingerprints by locally consistent parsing.

The text's code points are parsed into phrases, phrases into longer phrases, and so on. At each level
equal neighbours are joined to one symbol (value and length); then deterministic coin tossing labels each
symbol with the place of the lowest bit in which it differs from its left neighbour and that bit's value.
Four rounds leave labels below eight, again different from their neighbours'; a phrase starts where a label is
larger than both. A phrase is named by a hash of its symbols. Where it starts depends on a few symbols
to either side only, so equal substrings get equal phrases inside, whatever their offset.

A fingerprint holds, for the phrases of ``LEVELS``, one byte for each of ``BINS`` bins: of the names in
a bin the least, reduced to 1..255; 0 for an empty bin. Likeness is the share of equal bins among those that
are not empty in both, which estimates the share of phrases in common.

Every text is compared with its edited text and with the next document in descending doc_id order. One range
shuffle brings neighbours together; the last document of a range and the first of the next meet in a join of two rows
a range.

Null text: empty; the empty text's fingerprint is all zeros and two empty texts have likeness 1. Null doc_id: last in
descending order. Repeated ids follow each other in the order of their texts, so repeated rows get their
own row each; other columns are not read. A table of one document is its own next one; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, documents, slices

LEVELS = (2, 3)
BINS = 128
SLICE_BYTES = 1 << 20
FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coin_toss(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below eight, different from the left neighbour's; ``starts`` are the first symbols of texts."""
    labels = symbols
    for _ in range(4):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[starts] = ~labels[starts]
        differ = labels ^ left
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        labels = 2 * place + ((labels >> place) & np.uint64(1))
    return labels.astype(np.int8)


def parse_level(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names of concatenated texts, and how many each text has."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    first = np.zeros(len(symbols), dtype=bool)
    first[starts] = True
    # runs of equal symbols
    run = first.copy()
    run[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(run)
    length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    runs = np.where(length > 1, mix(symbols[at] + length * np.uint64(0xD6E8FEB86659FD93)), symbols[at])
    first = first[at]
    # a run's new name may equal a neighbour by chance only; coin tossing wants neighbours to differ
    same = np.flatnonzero((runs[1:] == runs[:-1]) & ~first[1:]) + 1
    runs[same] = mix(runs[same] + np.uint64(1))
    labels = coin_toss(runs, np.flatnonzero(first))
    cutting = first.copy()
    if len(labels) > 2:
        cutting[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    # no phrase of one symbol at the front of a text
    cutting[1:] &= ~(first[:-1] & ~first[1:])
    begin = np.flatnonzero(cutting)
    place = np.arange(len(runs)) - np.repeat(begin, np.diff(np.append(begin, len(runs))))
    names = mix(np.add.reduceat(mix(runs + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin))
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(np.flatnonzero(first[begin]), len(begin))))
    counts = np.zeros_like(sizes)
    counts[sizes > 0] = np.bincount(owner, minlength=len(starts))
    return names, counts


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of BINS bytes for each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    least = np.full(len(texts) * BINS, 2**64 - 1, dtype=np.uint64)
    symbols = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64))
    for level in range(1, max(LEVELS) + 1):
        if not len(symbols):
            break
        symbols, sizes = parse_level(symbols, sizes)
        if level in LEVELS:
            owner = np.repeat(np.arange(len(texts)), sizes)
            spread = mix(symbols + np.uint64(level))
            slot = owner * BINS + (spread >> np.uint64(40)).astype(np.int64) % BINS
            order = np.argsort(slot, kind="stable")
            begin = np.flatnonzero(np.diff(slot[order], prepend=-1))
            where = slot[order][begin]
            least[where] = np.minimum(least[where], np.minimum.reduceat(spread[order], begin))
    out = (mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    out[least == 2**64 - 1] = 0
    return out.reshape(len(texts), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of fingerprints."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def edit(text: str, following: str) -> str:
    """``text`` whose last third is replaced by as many first code points of ``following``, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare(ids: list, texts: list[str], followers: list[str]) -> pa.RecordBatch:
    edited = [edit(t, f) for t, f in zip(texts, followers, strict=True)]
    place = {t: i for i, t in enumerate(dict.fromkeys([*texts, *followers, *edited]))}  # a text is parsed once
    prints = fingerprints(list(place))
    own, changed, other = (prints[[place[t] for t in some]] for some in (texts, edited, followers))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        [x.tobytes().hex() for x in own],
        [x.tobytes().hex() for x in changed],
        likeness(own, changed),
        likeness(own, other),
    ]
    return pa.RecordBatch.from_pydict(dict(zip(FIELDS, columns, strict=True)))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of every row of ``docs`` (doc_id, text)."""
    sides = ["part long", "side int", "id long", "text string"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int64()), ("side", pa.int32()), ("id", pa.int64()), ("text", pa.string())])
        kinds = dict(zip(FIELDS, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True))
        last: tuple | None = None

        def edge(side: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            arrays = [pa.array([x], t) for x, t in zip((part, side, doc_id, text), schema.types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays + [pa.nulls(1, t) for t in kinds.values()], schema.names + FIELDS)

        for batch in slices(batches, 1, SLICE_BYTES):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if last is None:
                yield edge(0, ids[0], texts[0])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            if len(ids) > 1:
                done = compare(ids[:-1], texts[:-1], texts[1:])
                empty = [pa.nulls(done.num_rows, t) for t in schema.types]
                yield pa.RecordBatch.from_arrays(empty + done.columns, schema.names + FIELDS)
            last = ids[-1], texts[-1]
        if last is not None:
            yield edge(1, *last)

    key = F.coalesce(F.col("text"), F.lit("")).alias("text")
    ordered = docs.select("doc_id", key).repartitionByRange(F.desc_nulls_last("doc_id"))
    ordered = ordered.sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")
    parsed = cut(ordered.mapInArrow(parse, ", ".join([*sides, RESULT])), "parsed")

    # two rows a range: its first document (side 0) and its last (side 1)
    heads, tails = (parsed.filter(F.col("side") == s).select("part", "id", "text") for s in (0, 1))
    order = Window.orderBy("part")
    following = heads.select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next")
    )
    met = tails.join(following, "part").join(heads.select(F.col("part").alias("next"), F.col("text").alias("other")), "next")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield compare(*(c.to_pylist() for c in batch.columns))

    return parsed.filter("side is null").select(*FIELDS).unionByName(met.select("id", "text", "other").mapInArrow(meet, RESULT))


def op7_locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
