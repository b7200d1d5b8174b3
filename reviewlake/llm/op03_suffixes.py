"""Suffix-array deduplication of repeated byte strings, block by block with a difference cover.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of a smaller
doc_id, or in the same one further left. Only the suffixes' first ``LENGTH`` bytes matter, called windows here.

1. Buckets. A window's bucket is the least hash of the ``GRAM``-byte strings at its first ``SPAN`` positions, so
   equal windows share a bucket wherever they stand. Windows that follow each other in one bucket form a run,
   about one for 30 bytes; a run's text is the windows' union. A bucket of one run is done: nothing in it
   repeats. A run whose whole text an earlier run has is a repeat as a whole.
2. What is left are the first runs of different texts that share a bucket. Buckets are sorted one after another,
   in blocks of ``BLOCK_BYTES``: windows by their first ``PERIOD`` + 1 bytes; ties by ranks of the block's
   cover samples, the suffixes at positions in a difference cover of ``PERIOD``. For two windows there is an offset
   below the period at which both are samples, so one comparison of two ranks decides, however long the
   common prefix. Neighbours in suffix order that share ``LENGTH`` bytes are equal windows.
3. Removed bytes are the union of repeated windows, cut from each document in one join.

Memory: a task holds one slice of texts, or one block of buckets. Runs that a slice has already seen are marked
there and not gathered, so a passage that a third of all documents share arrives once from each slice. A
bucket of more than ``LARGE_BUCKET`` runs is dealt out by window, again once from each slice.

Null text: empty. Rows with equal doc_id and equal text are one document, and each gets its result; rows with equal
doc_id and different text are ordered by a hash of the text. A null doc_id is before all others. Other columns
are not read by the query. Texts under ``LENGTH`` bytes and empty tables lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import cut, documents, slices

LENGTH = 100
SPAN = 64
GRAM = LENGTH - SPAN + 1
SLICE_BYTES = 1_000_000
BLOCK_BYTES = 1_000_000
LARGE_BUCKET = 20_000
CHUNK_ROWS = 20_000
#: A perfect difference set: every difference modulo 31 occurs.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
ODD = 0x9E3779B97F4A7C15
RUN = "bucket long, whole long, doc_id long, part int, start int, size int, kind int"
PLAIN, INNER, KNOWN = 0, 1, 2  # kinds of runs: plain, with a possible repeat inside, repeat of its slice
BYTE_KEYS = np.random.default_rng(20260).integers(0, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial of the bytes, and the inverse powers that move a piece to the front."""
    size = 1 << max(20, int(len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_KEYS[data] * _powers(ODD, size)[: len(data)], out=sums[1:])
    return sums, _powers(pow(ODD, -1, 2**64), size)


def find_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts ``data[bounds[i]:bounds[i + 1]]``: start, size, bucket, hash of the whole, and
    whether equal windows may lie inside one run."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    sums, inverse = _prefix(data)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    least, often, step = grams, np.ones(len(grams), dtype=np.uint8), 1
    while step < SPAN:
        a, b = least[:-step], least[step:]
        often = np.where(a < b, often[:-step], np.where(b < a, often[step:], often[:-step] + often[step:]))
        least = np.minimum(a, b)
        step *= 2
    n = len(least)
    valid = np.zeros(n + 1, dtype=np.int8)
    full = np.flatnonzero(np.diff(bounds) >= LENGTH)
    valid[bounds[full]] += 1
    valid[bounds[full + 1] - LENGTH + 1] -= 1
    valid = valid[:n].cumsum() > 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])
    begin[bounds[full]] = True
    start = np.flatnonzero(begin)
    if not len(start):
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    inside = np.cumsum(valid)
    size = np.append(inside[start[1:] - 1], inside[-1]) - inside[start] + 1
    inner = np.maximum.reduceat(np.where(valid, often, 0), start) > 1
    whole = mix((sums[start + size + LENGTH - 1] - sums[start]) * inverse[start])
    return start, size, least[start], whole, inner


def _concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def gather_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (doc_id, part, text) rows; a run that the slice has before is marked and gets a bucket of its own."""
    for batch in slices(batches, 2, SLICE_BYTES):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        parts = batch.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((parts, ids))
        texts = batch.column(2).to_pylist()
        data, bounds = _concatenated([texts[i] for i in order])
        start, size, bucket, whole, inner = find_runs(data, bounds)
        owner = np.searchsorted(bounds, start, "right") - 1
        kind = np.where(inner, INNER, PLAIN).astype(np.int32)
        _, first, which = np.unique(mix(bucket) ^ whole, return_index=True, return_inverse=True)
        first = first[which]  # documents are in order, so the first is the earliest
        where = start - bounds[owner]
        row = order[owner]
        same = (ids[row] == ids[row[first]]) & (parts[row] == parts[row[first]]) & (where == where[first])
        known = ~same
        kind[known] = KNOWN
        bucket = np.where(known, mix(bucket + start.astype(np.uint64)), bucket)
        arrays = [bucket.view(np.int64), whole.view(np.int64), ids[row], parts[row].astype(np.int32), where.astype(np.int32), size.astype(np.int32), kind]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [f.split()[0] for f in RUN.split(", ")])


def mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by bucket, whole and place: repeats as a whole (kind KNOWN) and first runs of buckets
    with several texts or repeats inside (kind PLAIN). Holds one row of the last bucket between batches."""
    held: list[np.ndarray] | None = None
    several = out_already = False
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        known = columns[6] == KNOWN
        if known.any():
            yield _rows([c[known] for c in columns], KNOWN)
            columns = [c[~known] for c in columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        bucket, whole, doc, part, start, _, kind = columns
        new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        new_text = new_bucket | np.concatenate([[True], whole[1:] != whole[:-1]])
        group = np.cumsum(new_bucket) - 1
        texts = np.bincount(group, weights=new_text)
        different = texts > 1
        different[0] |= several and held is not None
        firsts = np.flatnonzero(new_text)
        first = firsts[np.cumsum(new_text) - 1]
        candidate = new_text & (different[group] | (kind == INNER))
        emit = candidate.copy()
        if held is not None and out_already:
            emit[0] = False
        repeat = ~new_text & ~((doc == doc[first]) & (part == part[first]) & (start == start[first]))
        yield _rows([c[repeat] for c in columns], KNOWN)
        yield _rows([c[emit] for c in columns], PLAIN)
        last = firsts[-1]
        out_already = bool(candidate[last])
        several = bool(different[group[-1]])
        held = [c[last : last + 1] for c in columns]


def _rows(columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
    columns = [*columns[:6], np.full(len(columns[0]), kind, dtype=np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in RUN.split(", ")])


# --- sorting one block of buckets ---------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(data)].astype(np.uint64)
    return out


def _dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of sorted rows; equal keys have equal ranks."""
    change = np.zeros(len(order), dtype=bool)
    for key in keys:
        ordered = key[order]
        change[1:] |= ordered[1:] != ordered[:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(change)
    return ranks


@lru_cache(maxsize=1)
def cover_offsets() -> np.ndarray:
    """For residues i, j: the least d with i + d and j + d both in the cover."""
    cover = set(COVER)
    table = [[next(d for d in range(PERIOD) if (i + d) % PERIOD in cover and (j + d) % PERIOD in cover) for j in range(PERIOD)] for i in range(PERIOD)]
    return np.array(table)


def sort_windows(data: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows (positions in ``data``) in suffix order, and whether each equals the one before it in LENGTH bytes."""
    reach = LENGTH + PERIOD + 8
    size = len(data)
    padded = np.concatenate([data, np.zeros(reach, np.uint8)])
    words = _words(padded)
    # ranks of the cover samples by their first LENGTH bytes
    residue = np.zeros(PERIOD, dtype=bool)
    residue[list(COVER)] = True
    samples = np.flatnonzero(residue[np.arange(size + PERIOD) % PERIOD])
    eights = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    keys = [words[np.minimum(samples + k, len(words) - 1)] for k in eights]
    rank = np.full(size + PERIOD, -1, dtype=np.int64)
    rank[samples] = _dense(np.lexsort(keys[::-1]), keys)
    # windows by their first PERIOD + 1 bytes
    prefix = [words[windows + k] for k in range(0, PERIOD + 1, 8)]
    order = np.lexsort(prefix[::-1])
    group = _dense(order, prefix)[order]
    order = windows[order]
    offsets = cover_offsets()
    open_ = np.ones(len(order), dtype=bool)
    while True:
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        length = np.diff(np.append(begin, len(group)))
        middle = np.repeat(begin + length // 2, length)
        active = np.flatnonzero(open_ & (np.repeat(length, length) > 1))
        if not len(active):
            break
        here, pivot = order[active], order[middle[active]]
        d = offsets[here % PERIOD, pivot % PERIOD]
        side = np.sign(rank[here + d] - rank[pivot + d])
        key = group * 3 + 1
        key[active] += side
        open_[active[side == 0]] = False
        again = np.argsort(key, kind="stable")
        order, open_, key = order[again], open_[again], key[again]
        group = np.cumsum(np.diff(key, prepend=key[0]) != 0)
    equal = np.zeros(len(order), dtype=bool)
    equal[1:] = True
    for k in eights:
        ordered = words[order + k]
        equal[1:] &= ordered[1:] == ordered[:-1]
    return order, equal


def repeats_in_block(texts: list[bytes], doc: np.ndarray, part: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first window, count) of windows in these runs that another run, or the same, has earlier."""
    data, bounds = _concatenated(texts)
    counts = np.diff(bounds) - LENGTH + 1
    row = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order, equal = sort_windows(data, bounds[row] + offset)
    at = np.searchsorted(bounds, order, "right") - 1
    places = np.lexsort((start, part, doc))
    place = _dense(places, [doc, part, start])[at] * (1 << 40) + (order - bounds[at])
    # runs of one document are apart, or the same run of a repeated row
    begin = np.flatnonzero(~equal)
    first = np.repeat(np.minimum.reduceat(place, begin), np.diff(np.append(begin, len(order))))
    later = place > first
    hit = np.sort(order[later])
    if not len(hit):
        return []
    owner = np.searchsorted(bounds, hit, "right") - 1
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(new)
    return list(zip(owner[begin].tolist(), (hit[begin] - bounds[owner[begin]]).tolist(), np.diff(np.append(begin, len(hit))).tolist(), strict=True))


CHUNK = "bucket long, doc_id long, part int, start int, text binary, size int"
COUNTS = ["n_bytes", "n_removed", "n_spans"]
SPOT = "doc_id long, part int, start int, size int"


def _spots(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "part", "start", "size"])


def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of runs sorted by bucket; whole buckets are sorted together, as many as fill a block."""
    rows: list[tuple] = []
    held = 0

    def solve(block: list[tuple]) -> pa.RecordBatch:
        _, doc, part, start, texts = zip(*block, strict=True)
        keys = [np.array(doc), np.array(part), np.array(start)]
        return _spots([(doc[i], part[i], start[i] + at, n) for i, at, n in repeats_in_block(list(texts), *keys)])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for bucket, doc_id, part, start, text, size in zip(*columns, strict=True):
            if size:  # already known to be repeated
                yield _spots([(doc_id, part, start, size)])
                continue
            if held >= BLOCK_BYTES and rows and rows[-1][0] != bucket:
                yield solve(rows)
                rows, held = [], 0
            rows.append((bucket, doc_id, part, start, text))
            held += len(text)
    if rows:
        yield solve(rows)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of runs: (doc_id, part, text, runs) to chunks; runs of large buckets become single windows, each
    sent once from a slice with the others marked as known repeats."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]

    def chunks(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in CHUNK.split(", ")])

    for batch in slices(batches, 2, SLICE_BYTES // 2):
        out: list[tuple] = []
        seen: dict[bytes, tuple] = {}
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for doc_id, part, text, runs in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            for run in sorted(runs, key=lambda r: r["start"]):
                start, size = run["start"], run["size"]
                if not run["large"]:
                    out.append((run["bucket"], doc_id, part, start, text[start : start + size + LENGTH - 1], 0))
                    continue
                for at in range(start, start + size):
                    window = text[at : at + LENGTH]
                    place = seen.setdefault(window, (doc_id, part, at))
                    key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                    if place == (doc_id, part, at):
                        out.append((key, doc_id, part, at, window, 0))
                    else:
                        out.append((key ^ hash(place + (doc_id, at)) & 0x7FFFFFFF, doc_id, part, at, b"", 1))
                if len(out) >= CHUNK_ROWS:
                    yield chunks(out)
                    out = []
        yield chunks(out)


# --- the whole --------------------------------------------------------------------------------


NO_ID = -(2**63)  # stands for a null doc_id, with a negative part: before all others


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, part, data): part tells apart different texts of one doc_id; it is 0 where ids are unique, negative without one."""
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"), *[c for c in docs.columns if c == CARRIED])
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("data"))
    repeated = rows.groupBy("doc_id").count().filter("count > 1").limit(1)
    part = F.lit(0) if repeated.isEmpty() else (F.dense_rank().over(order) - 1).cast("int")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), part - F.lit(2**31).cast("long")).otherwise(part).cast("int"))
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "part", "data", *rows.columns[2:-1])


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc_id, part, start, size): every window of ``texts`` that starts earlier too, in runs of starts."""
    runs = texts.mapInArrow(gather_runs, RUN)
    placed = runs.repartition("bucket").sortWithinPartitions("bucket", "whole", "doc_id", "part", "start")
    marked = cut(placed.mapInArrow(mark_runs, RUN), "runs")
    whole = marked.filter(F.col("kind") == KNOWN).select("doc_id", "part", "start", "size")
    rest = marked.filter(F.col("kind") == PLAIN)
    large = rest.groupBy("bucket").count().filter(F.col("count") > LARGE_BUCKET).select("bucket", F.lit(True).alias("large"))
    wanted = rest.join(large, "bucket", "left").select("doc_id", "part", F.struct("bucket", "start", "size", F.coalesce("large", F.lit(False)).alias("large")).alias("run"))
    by_document = wanted.groupBy("doc_id", "part").agg(F.collect_list("run").alias("runs"))
    chunks = texts.join(by_document, ["doc_id", "part"]).select("doc_id", "part", "data", "runs").mapInArrow(cut_out, CHUNK)
    spots = chunks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort_buckets, SPOT)
    return whole.unionByName(spots)


CARRIED = "_carried"  # beside it stand own names only


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row of ``docs``."""
    return _removed(docs.select("doc_id", "text"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with texts without their repeats; characters cut in part go, and ``n_chars`` follows. Null becomes empty text."""
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(CARRIED)
    found = _removed(docs.select("doc_id", "text", carried), as_text=True)
    own = {c: F.col(CARRIED).getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in own:
        own["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[own[c].alias(c) for c in docs.columns])


def _removed(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """Counts and kept bytes (or text) of (doc_id, text, CARRIED if it is there)."""
    texts = numbered(docs)
    found = repeated_windows(texts.select("doc_id", "part", "data"))
    spots = found.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "size")).alias("spots"))
    joined = texts.join(spots, ["doc_id", "part"], "left").select("part", "doc_id", "data", "spots", *texts.columns[3:])
    kind = T.StringType() if as_text else T.BinaryType()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in COUNTS), T.StructField("kept", kind), *joined.schema.fields[4:]])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE_BYTES):
            ids = [None if p < 0 else x for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            texts = batch.column(2).to_pylist()
            removed, count, kept = [0] * len(ids), [0] * len(ids), list(texts)
            lists = batch.column(3)
            found = lists.flatten()
            begin, size = (found.field(i).to_numpy() for i in (0, 1))
            lengths = [0 if x is None else x for x in pc.list_value_length(lists).to_pylist()]
            at = 0
            for i, n in enumerate(lengths):
                if n:
                    change = np.zeros(len(texts[i]) + 1, dtype=np.int64)
                    np.add.at(change, begin[at : at + n], 1)
                    np.add.at(change, begin[at : at + n] + size[at : at + n] + LENGTH - 1, -1)
                    gone = change[:-1].cumsum() > 0
                    removed[i] = int(gone.sum())
                    count[i] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept[i] = np.frombuffer(texts[i], dtype=np.uint8)[~gone].tobytes()
                at += n
            counts = [pa.array(c, pa.int64()) for c in (ids, [len(t) for t in texts], removed, count)]
            last = pa.array([b.decode(errors="ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*counts, last, *batch.columns[4:]], schema.names)

    return joined.mapInArrow(remove, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
