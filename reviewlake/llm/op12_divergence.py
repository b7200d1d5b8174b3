"""Source divergence audit over a term index built by single-pass in-memory indexing.

Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z in lower case. A language keeps the terms of at
least MIN_DOCS of its documents. Every source of a language is held against its other sources (all kept
terms) and against the language (the terms it uses more).

Index: a task reads documents once and counts postings (language, term, source) in memory. When they reach
MAX_POSTINGS it spills a run: its postings in term order, cut into blocks by hash shard, and starts anew. Spark's
shuffle brings a shard's blocks together, ordered by their first term; a heap merges their terms and opens a block
only when the merge reaches its first term, so a task holds one open block of a run at a time. What leaves a
shard are whole frequencies: all sources of a term, or nothing where too few documents have it.

Pairs: were no term in either source, each would add |a0 - b0|, the difference of the smoothed zero counts. Terms of one
source correct this by its histogram of probabilities, joined with the language's sources. Terms that both have
are streamed: a task adds up one correction for each pair of sources and gives partial sums when MAX_PAIRS
are held. So no term is compared in sources that lack it, and no pair is a row for a single term.

Probabilities are whole billionths by integer division of 38-digit decimals; sums are 64-bit.

Null text, language or source: empty text. Empty texts, and texts without terms, still make their group occur. Very
long texts are read in slices whose terms count as one document. Repeated rows are documents each. Ties go by the
item's UTF-8 bytes. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, documents, give_back

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
UNIT = 1_000_000_000
MAX_POSTINGS = 600_000
BLOCK = 512
SLICE = 4 << 20
MAX_PAIRS = 500_000

#: Bytes of terms map to themselves or lower case, all others to a space.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: A block: terms of one shard with their document counts; the postings of term i are starts[i] to starts[i + 1].
BLOCKS = "shard int, low binary, keys array<binary>, docs array<long>, starts array<int>, names array<string>, sources array<int>, counts array<long>"
BLOCK_LISTS = {"keys": pa.binary(), "docs": pa.int64(), "starts": pa.int32(), "names": pa.string(), "sources": pa.int32(), "counts": pa.int64()}
BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("low", pa.binary())] + [(n, pa.list_(t)) for n, t in BLOCK_LISTS.items()])
FREQUENCIES = "lang string, term string, source string, count long, lang_count long, first boolean"
FREQUENCY_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("lang_count", pa.int64()), ("first", pa.bool_())])


def words(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in slices that no term crosses."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + SLICE)
        while stop < len(text) and LETTERS[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(LETTERS).split(b" ")
        start = stop


def key_of(lang: str, term: bytes) -> bytes:
    """Language and term as one sort key, told apart by a length in front."""
    name = lang.encode()
    return len(name).to_bytes(4, "big") + name + term


def parts_of(key: bytes) -> tuple[str, str]:
    at = 4 + int.from_bytes(key[:4], "big")
    return key[4:at].decode(), key[at:].decode()


class Postings:
    """Counts of terms and of documents with them, by language and source."""

    def __init__(self):
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, found = self.counts[lang][source], set()
        self.size -= len(counts)
        for some in words(text):
            counts.update(some)
            found.update(some)
        self.size += len(counts)
        self.docs[lang].update(found)

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """Blocks of the postings, each of one shard and in the order of its keys."""
        for lang, by_source in self.counts.items():
            docs = self.docs[lang]
            docs.pop(b"", None)  # what split() leaves between separators
            terms = sorted(docs)
            number = {t: i for i, t in enumerate(terms)}
            of_term, of_source, counts = [], [], []
            for i, found in enumerate(by_source.values()):
                found.pop(b"", None)
                of_term.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
                of_source.append(np.full(len(found), i, np.int32))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
            of_term, of_source, counts = map(np.concatenate, (of_term, of_source, counts))
            order = np.argsort(of_term, kind="stable")
            of_source, counts = of_source[order], counts[order]
            bounds = np.searchsorted(of_term[order], np.arange(len(terms) + 1))
            shard = np.fromiter((zlib.crc32(t) % shards for t in terms), np.int64, len(terms))
            names, rows = list(by_source), []
            for own in np.split(by_shard := np.argsort(shard, kind="stable"), np.flatnonzero(np.diff(shard[by_shard])) + 1):
                for start in range(0, len(own), BLOCK):
                    chosen = own[start : start + BLOCK]
                    lengths = bounds[chosen + 1] - bounds[chosen]
                    starts = np.concatenate([[0], np.cumsum(lengths)])
                    at = np.arange(starts[-1]) + np.repeat(bounds[chosen] - starts[:-1], lengths)
                    keys = [key_of(lang, terms[i]) for i in chosen.tolist()]
                    own_docs = np.fromiter((docs[terms[i]] for i in chosen.tolist()), np.int64, len(chosen))
                    rows.append((int(shard[chosen[0]]), keys[0], keys, own_docs, starts, names, of_source[at], counts[at]))
                    if len(rows) == 64:
                        yield block_batch(rows)
                        rows = []
            if rows:
                yield block_batch(rows)


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    shards, lows, *lists = zip(*rows, strict=True)
    columns = [pa.array(shards, pa.int32()), pa.array(lows, pa.binary())]
    for values, kind in zip(lists, BLOCK_LISTS.values(), strict=True):
        ends = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32())
        flat = np.concatenate(values) if isinstance(values[0], np.ndarray) else [x for v in values for x in v]
        columns.append(pa.ListArray.from_arrays(ends, pa.array(flat, kind)))
    return pa.RecordBatch.from_arrays(columns, schema=BLOCK_SCHEMA)


def indexer(shards: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings()
        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
                held.add(lang.as_py(), source.as_py(), text.as_py())
                if held.size >= MAX_POSTINGS:
                    yield from held.run(shards)
                    held = Postings()
        yield from held.run(shards)
        del held
        give_back()

    return index


class Block:
    """A run's open block and the place the merge has reached in it."""

    def __init__(self, row: dict[str, pa.Scalar], number: dict[str, int]):
        self.keys, self.docs = row["keys"].as_py(), row["docs"].as_py()
        self.starts, self.counts = (row[c].values.to_numpy() for c in ("starts", "counts"))
        names = np.array([number.setdefault(n, len(number)) for n in row["names"].as_py()])
        self.sources = names[row["sources"].values.to_numpy()]
        self.at = 0

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.starts[self.at], self.starts[self.at + 1])
        return self.sources[here], self.counts[here]


def heap_merge(rows: Iterator[dict[str, pa.Scalar]], number: dict[str, int], min_docs: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(key, sources, counts) of the kept terms of one shard, in order; blocks come in the order of their first keys.

    Sources are numbers of ``number``, which the merge extends; a source may come several times.
    """
    heap: list[tuple[bytes, int, Block]] = []
    opened, row = 0, next(rows, None)
    while heap or row is not None:
        while row is not None and (not heap or row["low"].as_py() <= heap[0][0]):
            block = Block(row, number)
            heapq.heappush(heap, (block.keys[0], opened, block))
            opened, row = opened + 1, next(rows, None)
        key, docs, found = heap[0][0], 0, []
        while heap and heap[0][0] == key:
            _, i, block = heap[0]
            docs += block.docs[block.at]
            found.append(block.postings())
            block.at += 1
            if block.at < len(block.keys):
                heapq.heapreplace(heap, (block.keys[block.at], i, block))
            else:
                heapq.heappop(heap)
        if docs >= min_docs:
            yield key, np.concatenate([s for s, _ in found]), np.concatenate([c for _, c in found])


def merger(min_docs: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(BLOCK_SCHEMA.names, row, strict=True)) for batch in batches for row in zip(*batch.columns, strict=True))
        held, size = [], 0

        def table() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip((list(chain(*x)) for x in zip(*held, strict=True)), FREQUENCY_SCHEMA, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=FREQUENCY_SCHEMA)

        for _, blocks in groupby(rows, key=lambda r: r["shard"].as_py()):
            number: dict[str, int] = {}
            names: list[str] = []
            for key, sources, counts in heap_merge(blocks, number, min_docs):
                names += list(number)[len(names) :] if len(number) > len(names) else []
                sums = np.zeros(len(names), np.int64)
                np.add.at(sums, sources, counts)
                some = np.flatnonzero(sums).tolist()
                lang, term = parts_of(key)
                n = len(some)
                held.append(([lang] * n, [term] * n, [names[i] for i in some], sums[some].tolist(), [int(sums.sum())] * n, [True] + [False] * (n - 1)))
                size += n
                if size >= 8192:
                    yield table()
                    held, size = [], 0
        if held:
            yield table()

    return merge


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Counts of every kept term by source and language; ``first`` is set on one row of a term."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    blocks = read.mapInArrow(indexer(shards), BLOCKS).repartition("shard")
    return blocks.sortWithinPartitions("shard", "low").mapInArrow(merger(min_docs), FREQUENCIES)


def probability(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exact; NULL without terms."""
    wide = [F.col(c) if isinstance(c, str) else c for c in (count, F.col(total), F.col(terms))]
    n, total_, terms_ = (c.cast("decimal(20,0)") for c in wide)
    below = total_ + F.lit(SMOOTH).cast("decimal(1,0)") * terms_
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + F.lit(SMOOTH).cast("decimal(1,0)"))
    return F.lit(1) + F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(1,0)")))


PAIR_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums, source before item, of the corrections of terms that both sources have."""
    number: dict[tuple[str, str], int] = {}  # of the (language, source) met since the last partial sums
    keys, values, size = [], [], 0

    def add_up() -> None:
        nonlocal keys, values, size
        if keys:
            unique, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(unique), np.int64)
            np.add.at(sums, at, np.concatenate(values))
            keys, values, size = [unique], [sums], len(unique)

    def give() -> pa.RecordBatch:
        nonlocal keys, values, size
        names = list(number)
        rows = [(*names[k >> 32], names[k & 0xFFFFFFFF][1], v) for k, v in zip(keys[0].tolist(), values[0].tolist(), strict=True)] if keys else []
        keys, values, size = [], [], 0
        number.clear()
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIR_SUMS, strict=True)], schema=PAIR_SUMS)

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for (lang, _), group in groupby(rows, key=lambda r: r[:2]):
        found = list(group)  # a row for each source of the term, in the order of sources
        ids = np.array([number.setdefault((lang, r[2]), len(number)) for r in found])
        p, zero = np.array([r[3] for r in found]), np.array([r[4] for r in found])
        step = max(1, MAX_PAIRS // len(found))
        for start in range(0, len(found) - 1, step):
            i, j = np.nonzero(np.arange(start, min(start + step, len(found) - 1))[:, None] < np.arange(len(found)))
            i += start
            keys.append(ids[i] << 32 | ids[j])
            values.append(np.abs(p[i] - p[j]) - np.abs(p[i] - zero[j]) - np.abs(zero[i] - p[j]) + np.abs(zero[i] - zero[j]))
            size += len(i)
            if size > 2 * MAX_PAIRS:
                add_up()
        if size > MAX_PAIRS and len(keys) == 1:  # so many different pairs
            yield give()
    add_up()
    yield give()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` for every other source, ``term`` for the first ``top`` terms."""
    index = cut(frequencies(docs, min_docs), "frequencies")
    occurring = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_lang = index.filter("first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_count").alias("lang_total"))
    of_source = index.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = occurring.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = cut(groups.withColumn("zero", F.coalesce(probability(F.lit(0), "total", "terms"), F.lit(0))), "groups")

    rated = index.join(groups, ["lang", "source"]).select("lang", "term", "source", "zero", probability("count", "total", "terms").alias("p"), probability("lang_count", "lang_total", "terms").alias("q"))
    above = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    one = groups.select("lang", "source", F.col("zero").alias("zero_a"), "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_b"))
    base = one.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("terms") * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value"))
    histogram = rated.groupBy("lang", "source", "p", F.col("zero").alias("zero_a")).agg(F.count(F.lit(1)).alias("n"))
    moved = F.abs(F.col("p") - F.col("zero_b")) - F.abs(F.col("zero_a") - F.col("zero_b"))
    single = histogram.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("n") * moved).alias("value"))
    streamed = rated.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = streamed.mapInArrow(pair_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    half = single.unionByName(both)
    mirrored = half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(half).unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    every = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return every.unionByName(ranked)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), tok AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT o.lang, o.source, coalesce(any_value(v.v), 0)::HUGEINT AS v, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source)
  GROUP BY o.lang, o.source
), full_ AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p
  FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), lang_ AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM full_ JOIN lang_ USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
