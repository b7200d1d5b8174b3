"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: words are runs without ASCII white space, A-Z in lower case; shingles of four words
(repeats count); XXH64 with seed 42 of each; a bit is set if it is set in over half the shingles.

Search: radius r gives 2^(r+1) - 1 tables. Every bit position has a non-zero code of r + 1 bits; mask v
keeps the positions whose code has odd overlap with v. For any r positions some v overlaps all their codes
evenly, since r equations leave a non-zero solution in r + 1 dimensions: two fingerprints that differ in
at most r bits agree in full under that mask. No pair within the radius can be missed.

Only distinct fingerprints are searched, so thousands of copies are one entry. A bucket gives a spanning
forest of its links, never its pairs: a walk compares each reached fingerprint with those not reached.
Components come from rounds of hooking every node to its least neighbour and contracting, on tables in the
shared folder; about log(nodes) rounds, since nodes are ordered by a mixed value.

Null or empty text and text without words: fingerprint zero, linked like any other. Null doc_id: the row is
kept and takes part in linking; it counts as no id. Repeated rows get equal results. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import cut, documents

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
PART_SHINGLES = 100_000


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode().lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    count = max(1, len(words) - shingle_words + 1)
    totals = np.zeros(64, dtype=np.int64)
    for start in range(0, count, PART_SHINGLES):
        stop = min(count, start + PART_SHINGLES)
        shifted = [words[start + i : stop + i] for i in range(min(shingle_words, len(words)))]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*shifted, strict=False)], dtype="<u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > count, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def simhash_of(text: pd.Series) -> pd.Series:
    """The fingerprint as a signed long of the same bits."""
    return pd.Series(np.array([simhash(t) for t in text], dtype=np.uint64).view(np.int64))


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed longs."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed longs; numpy counts those of the absolute value unless they are unsigned."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect whatever the radius connects among distinct values."""
    links = []
    rest = values
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = differing(rest, at) <= radius
            links += [(int(at), int(x)) for x in rest[near]]
            reached += list(rest[near])
            rest = rest[~near]
    return links


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among distinct values of ``fp`` that span each component; a < b, no link twice."""
    tables = F.posexplode(F.array(*[F.lit(m) for m in covering_masks(radius)])).alias("table", "mask")
    keyed = fingerprints.select("fp", tables).select(F.xxhash64("table", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), "fp")
    sides = ["bucket", "fp"]

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def found(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
            ends = np.append(starts[1:], len(bucket))
            two = starts[ends - starts == 2]
            near = two[differing(fp[two], fp[two + 1]) <= radius]
            pairs = [np.stack([fp[near], fp[near + 1]], axis=1)]
            for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                if more := forest(fp[a:b], radius):
                    pairs.append(np.array(more, dtype=np.int64))
            pairs = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            yield found(held[0][:done], held[1][:done])
            held = [h[done:] for h in held]
        yield found(*held)

    return keyed.repartition("bucket").sortWithinPartitions(*sides).mapInArrow(span, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); equal roots for connected nodes."""
    edges = cut(edges.union(edges.select("b", "a")), "edges")
    roots = None
    while not edges.isEmpty():
        # the neighbour (or the node itself) with the least mixed value
        best = F.min(F.struct(F.xxhash64("b").alias("m"), F.col("b").alias("id")))
        own = F.struct(F.xxhash64("a").alias("m"), F.col("a").alias("id"))
        hooks = cut(edges.groupBy("a").agg(best.alias("best")).select(F.col("a").alias("node"), F.least("best", own)["id"].alias("up")), "hooks")
        if roots is None:
            roots = hooks.select("node", F.col("up").alias("root"))
        else:
            step = hooks.withColumnRenamed("node", "root")
            roots = cut(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        one = edges.join(hooks.select(F.col("node").alias("a"), F.col("up").alias("a2")), "a")
        both = one.join(hooks.select(F.col("node").alias("b"), F.col("up").alias("b2")), "b")
        edges = cut(both.filter("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), root (one fp of the component) and component_id, the least doc_id that links reach, for every row of ``docs``."""
    rows = cut(docs.select("doc_id", simhash_of("text").alias("fp")), "simhash")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id, of equal ids the least fingerprint.

    Rows without an id count as last, one of each component of such rows stays. Rows with one id and texts that
    are not near each other all stay. Of rows equal in id and fingerprint any one stays.
    """
    least = near_duplicates(docs, radius).filter("doc_id <=> component_id")
    kept = least.groupBy("root").agg(F.first("doc_id").alias("kept_id"), F.min("fp").alias("kept_fp")).drop("root")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), simhash_of("text").alias("fp"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp"))
    return rows.join(kept, same).dropDuplicates(["id", "fp"]).select("row.*")


def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
