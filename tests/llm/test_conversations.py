"""Conversation repair against a search over all edit scripts, whole and cut into parts."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import op13_conversations as op13
from reviewlake.llm.common import ship

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost string, kind long, digest string"


def cheapest(rows):
    """(cost, audit, lines) by Dijkstra over (rows read, roles made); rows are (role, text, fault)."""
    best = [(0, "", 0, "", ())]
    seen = set()
    while best:
        cost, audit, i, made, lines = heapq.heappop(best)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, lines
        state = (i, made[:1], made[-1:])
        if (state, "done") in seen:
            continue
        seen.add((state, "done"))
        for name in ("user", "assistant"):
            if re.fullmatch("s?(ua)*u?", made + name[0]):
                heapq.heappush(best, (cost + 5, audit + "I", i, made + name[0], (*lines, name + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(best, (cost + 2, audit + "D", i + 1, made, lines))
        if fault in ("blank", "duplicate"):
            continue
        late = 5 if fault else 0
        for name, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
            if name and re.fullmatch("s?(ua)*u?", made + name[0]) and (letter == "K" or name != role):
                heapq.heappush(best, (cost + price + late, audit + letter, i + 1, made + name[0], (*lines, f"{name}:{text}")))
    raise AssertionError


def expected(table, damage=True):
    """The results by plain Python, by conversation."""
    after, convs = defaultdict(list), set()
    for conv, turn, role, text in table:
        convs.add(conv)
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in convs:
        rows, faults, seen = after[conv], [], set()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        for _, role, text in rows:
            rest = text.strip(SPACE)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}
    assert len(found) == df.count()
    return found


@pytest.fixture(scope="module")
def table():
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "überuser", "uncle"]
    texts = ["Fine.", "What?", "cut off", "", " \n", None, "é!", "Two\nlines. \t", "…", "nbsp. "]
    rows = []
    for conv in [*range(60), None, -(2**63)]:
        for turn in range(rng.randrange(1, 9)):
            at = rng.choice([turn, turn, turn, turn + 3, None, -turn])
            rows += [(conv, at, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    return rows


def frame(spark, rows, partitions=3):
    ship(spark)
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA).repartition(partitions)


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_tables_equal_a_search_of_all_scripts(block):
    rng, made = random.Random(block), op13.Tables(block)
    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for _ in range(400):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(9)))
        rows = [("user", "", "blank") if x == 8 else (names[x % 4], "t", "truncated" if x > 3 else "") for x in symbols]
        assert made.repair(symbols) == cheapest(rows)[:2], symbols


def test_equal_vectors_are_few_and_blocks_equal_single_steps():
    one, four = op13.Tables(1), op13.Tables(4)
    assert one.vectors == four.vectors and len(one.vectors) < 200
    symbols = bytes(random.Random(1).randrange(9) for _ in range(20_001))
    assert one.repair(symbols) == four.repair(symbols)


def test_odd_rows_and_ties_equal_brute_force(spark, table):
    want = expected(table)
    assert got(op13.repair(op13.damaged(frame(spark, table)))) == want
    assert None in want and {"D", "K", "R"} == {x for w in want.values() for x in w[6]}  # an insert never pays


def test_conversations_cut_by_ranges_and_parts(spark, table, monkeypatch):
    rng = random.Random(4)
    long = [(7, t, rng.choice(["user", "assistant"]), f"Said {rng.randrange(900)}.") for t in range(1500)]
    rows = [r for r in table if r[0] not in (7, None)] + long
    want = expected(rows)
    assert want[7][2] > 100  # copies of an earlier row far before it
    monkeypatch.setattr(op13, "PART_ROWS", 100)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got(op13.repair(op13.damaged(frame(spark, rows))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == want


def test_one_row_a_third_of_all_and_a_long_text(spark):
    rows = [(1, 0, "user", "Same.")] * 300 + [(2, None, "user", "Same.")] * 300 + [(3, t, "user", "x" * 400_000 + ".") for t in range(4)]
    rows += [(i, t, "user", "Same.") for i in range(4, 9) for t in range(60)]
    assert got(op13.repair(op13.damaged(frame(spark, rows, 2)))) == expected(rows)


def test_empty_table(spark):
    empty = frame(spark, [(1, 1, "user", "x")]).filter("false")
    assert op13.repair(op13.damaged(empty)).count() == 0


def test_query_on_given_rows(spark):
    path = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op13.op13_conversation_repair(spark, path)
    assert got(found) == expected(table)
    assert found.filter(F.col("conv_id").isNull()).count() == 0
