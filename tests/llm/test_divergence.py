"""The divergence audit against its SQL and plain counts, with spills, blocks and partial sums of a few entries."""

import random

import duckdb
import pytest

from reviewlake.llm import op12_divergence as op12
from reviewlake.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value string, rank string, zero long, term string, p string"


def frame(spark, rows, partitions=4):
    ship(spark)
    return spark.createDataFrame([(i, *r, 1, "v", "r", 9, "t", "p") for i, r in enumerate(rows)], SCHEMA).repartition(partitions)


def by_sql(rows, min_docs):
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(db.sql(op12.SQL.replace(">= 30", f">= {min_docs}")).fetchall())


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def table():
    rng = random.Random(8)
    terms = ["the", "The", "THE", "é", "É", "naïve", "x1y", "end.", "", "中文", "a-b", "\x7f", "Kelvin", "ı", "it's", *(f"w{chr(97 + i % 26)}{i}q" for i in range(60))]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s0"] * 5 + ["s1", "s2", "é", None, ""])
        text = rng.choice([" ", "\n", ", "]).join(rng.choice(terms) for _ in range(rng.randrange(30)))
        rows.append((rng.choice([text] * 9 + [None]), lang, source))
    rows += [("Only here", "fr", "s1"), ("", "fr", "s2"), (None, "fr", "s0"), ("123 ... 4", "xx", "alone")]
    return rows + rows[:5]


def test_odd_rows_equal_sql(spark, table):
    found = op12.audit(frame(spark, table), 5)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(found) == by_sql(table, 5)
    rows = [r.asDict() for r in found.filter("lang = 'fr'").collect()]  # no term in five documents
    assert {(r["part"], r["value"]) for r in rows} == {("pair", 0)} and len(rows) == 6


def test_many_runs_and_small_blocks_give_the_same(spark, table, monkeypatch):
    want = got(op12.audit(frame(spark, table), 5))
    for name, value in (("MAX_POSTINGS", 20), ("BLOCK", 3), ("SLICE", 7), ("MAX_PAIRS", 4)):
        monkeypatch.setattr(op12, name, value)
    index = op12.indexer(5)
    batch = frame(spark, table).selectExpr("cast(coalesce(text, '') as binary) text", "coalesce(lang, '') lang", "coalesce(source, '') source").toArrow()
    blocks = [b for some in index(iter(batch.to_batches())) for b in zip(*some.columns, strict=True)]
    blocks = [dict(zip(op12.BLOCK_SCHEMA.names, b, strict=True)) for b in blocks]
    assert len(blocks) > 100 and max(len(b["keys"]) for b in blocks) == 3
    for shard in range(5):  # the heap's order is that of all keys
        own = sorted((b for b in blocks if b["shard"].as_py() == shard), key=lambda b: b["low"].as_py())
        merged = [key for key, _, _ in op12.heap_merge(iter(own), {}, 0)]
        assert merged == sorted({k for b in own for k in b["keys"].as_py()})
    assert got(op12.audit(frame(spark, table), 5)) == want


def test_partial_sums_of_pairs_add_up(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    rows = [("en", f"t{t}", f"s{s:02}", rng.randrange(1, 50), 7) for t in range(40) for s in sorted(rng.sample(range(12), rng.randrange(1, 12)))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "term", "source", "p", "zero"])

    def total():
        sums = {}
        for part in op12.pair_sums(iter([batch.slice(0, 50), batch.slice(50)])):
            for r in part.to_pylist():
                assert r["source"] < r["item"]
                sums[r["source"], r["item"]] = sums.get((r["source"], r["item"]), 0) + r["value"]
        return sums

    want = {}
    for _, t, a, p, _ in rows:
        for _, u, b, q, _ in rows:
            if t == u and a < b:
                want[a, b] = want.get((a, b), 0) + abs(p - q) - abs(p - 7) - abs(7 - q)
    assert total() == want
    monkeypatch.setattr(op12, "MAX_PAIRS", 6)
    assert total() == want


def test_words_in_slices(monkeypatch):
    text = "Straße, x\x00Y z—w ABC".encode() * 50
    whole = [w for some in op12.words(text) for w in some if w]
    monkeypatch.setattr(op12, "SLICE", 5)
    assert [w for some in op12.words(text) for w in some if w] == whole
    assert whole[:4] == ["straße".encode(), b"x", b"y", "z—w".encode()]


def test_counts_beyond_64_bits_of_products(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(9 * 10**15, 10**16, 3), (0, 0, 0), (0, 0, 4)], "count long, total long, terms long")
    values = [r[0] for r in rows.select(op12.probability("count", "total", "terms")).collect()]
    assert values == [1 + 10**9 * (9 * 10**15 + 5) // (10**16 + 15), None, 1 + 10**9 * 5 // 20]
    assert rows.select(op12.probability(F.lit(0), "total", "terms")).collect()[0][0] == 1 + 5 * 10**9 // (10**16 + 15)


def test_empty_table(spark):
    assert op12.audit(frame(spark, [("a", "b", "c")]).filter("false")).count() == 0


def test_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert got(op12.op12_source_divergence(spark, "/root/testdata/sf0.001")) == sorted(db.sql(op12.SQL).fetchall())
