"""Conversation repair by Four-Russians block tables.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user or
assistant 1, Delete 2 (the only edit of a blank or repeated row), Insert an empty user or assistant row 5; a
truncated row that stays costs 5 more. The audit is the edits' initials of a cheapest repair, of those the
least by ASCII.

Method: a row is one of nine symbols. The cost to go from the four states of the pattern, less its least entry,
takes few values, because a state is at most two inserted rows away from any other. ``Tables`` lists these
vectors, and for every vector and every block of BLOCK symbols the vector before the block and what the least
entry grows by. A conversation is read from its end, one lookup for a block. The trace starts at the front: a
block is expanded backward, row by row, from the vector kept at its right border, then its edits are read forward;
an edit's initial fixes the state it leads to, so taking the least initial of a cheapest edit at each step
gives the least audit.

Spark's part: rows meet in the order of conversation, turn, then a digest of role and text, by a range shuffle,
which may cut a conversation anywhere. A task repairs what lies inside its range; conversations that its
range cuts leave in parts and are repaired in a second, sorted pass that holds symbols and audit, never texts. Equal rows
travel as one with their number. Which rows repeat one of a lower turn is found by a group-by of digests beside it.

Rows without a role or text: one space each. Rows without a turn come first; without a conv_id they are one
conversation. Rows of one turn go by the digest. Repeated rows are rows like others, so all but
the first count as duplicates. Long texts are read once and never cut. Extra columns are not read. A conversation without
rows after damage has zeros and empty text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, ship

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Symbols: initial s, u, a or another, then the same four truncated, then rows that must go.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, GONE, SYMBOLS = 3, 8, 9
#: States: nothing yet, after s, after u, after a. Where an initial, or an inserted row, leads.
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
MADE = (2, 2, 3, 2)
NAMES = {2: b"user", 3: b"assistant"}
AT_END = (0, 10, 5, 0)
PART_ROWS = 8192  # rows of a part of a conversation that a task's range cuts
BATCH_ROWS = 2048
LINE_BYTES = 4 << 20

FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long"
RESULT = f"{FACTS}, cost long, audit string, repaired_sha256 string"
PARTS = (
    f"{RESULT}, at int, seq long, symbols binary, lines array<binary>, turn_first long, turn_last long, n_turns long, "
    "initial_first string, initial_last string"
)
SUMMED = ("blank", "duplicate", "truncated", "illegal")


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of what may be done with a row, by initial; a rerole keeps the expected role."""
    yield "D", DELETE, state
    if symbol == GONE:
        return
    late, initial = (TRUNCATED, symbol - 4) if symbol >= 4 else (0, symbol)
    if (state, initial) in KEPT:
        yield "K", KEEP + late, KEPT[state, initial]
    yield "R", REROLE + late, MADE[state]


def before(symbol: int, after: tuple[int, ...]) -> list[int]:
    """Cost to go in front of a row, from that behind it; rows may be inserted first."""
    costs = [min(cost + after[to] for _, cost, to in edits(symbol, state)) for state in range(4)]
    for _ in range(2):  # two inserted rows lead from any state to any other but the first two
        costs = [min(c, INSERT + costs[MADE[state]]) for state, c in enumerate(costs)]
    return costs


class Tables:
    """The vectors, one-symbol and block transitions: next vector and growth, by vector and block number."""

    def __init__(self, block: int = BLOCK):
        self.vectors, number, steps = [AT_END], {AT_END: 0}, []
        for vector in self.vectors:  # grows until closed
            row = []
            for symbol in range(SYMBOLS):
                costs = before(symbol, vector)
                least = min(costs)
                normal = tuple(c - least for c in costs)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append((number[normal], least))
            steps.append(row)
        one = np.array(steps)  # vector, symbol -> (vector, growth)
        self.block, to, grows = block, np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), int)
        for _ in range(block):  # symbols from right to left: the block's last symbol is its lowest digit
            moved = one[to]  # vector, block so far, symbol, (vector, growth)
            grows = (grows[:, :, None] + moved[..., 1]).transpose(0, 2, 1).reshape(len(self.vectors), -1)
            to = moved[..., 0].transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self.steps, self.to, self.grows = [[t for t, _ in row] for row in steps], to.tolist(), grows.tolist()
        self.least = [[g for _, g in row] for row in steps]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Cost and least audit of a conversation's symbols."""
        size, head = self.block, len(symbols) % self.block
        digits = np.frombuffer(symbols, np.uint8)[head:].reshape(-1, size).astype(np.int64)
        blocks = (digits @ (SYMBOLS ** np.arange(size - 1, -1, -1))).tolist()
        vector, total, borders = 0, 0, []
        for block in reversed(blocks):
            borders.append(vector)
            total += self.grows[vector][block]
            vector = self.to[vector][block]
        first = vector
        for symbol in reversed(symbols[:head]):
            total += self.least[vector][symbol]
            vector = self.steps[vector][symbol]
        total += self.vectors[vector][0]
        letters, state = self.expand(symbols[:head], first, 0)
        audit = [letters]
        for i, border in enumerate(reversed(borders)):
            letters, state = self.expand(symbols[head + i * size : head + (i + 1) * size], border, state)
            audit.append(letters)
        audit.append("I" * (AT_END[state] // INSERT))
        return total, "".join(audit)

    @lru_cache(maxsize=1 << 17)  # noqa: B019 - one object lives as long as its process
    def expand(self, symbols: bytes, right: int, state: int) -> tuple[str, int]:
        """Edits of some rows from ``state``, given the vector behind them; and the state after them."""
        behind = [right]
        for symbol in reversed(symbols):
            behind.append(self.steps[behind[-1]][symbol])
        letters = []
        for symbol, vector in zip(symbols, behind[-2::-1], strict=True):
            after, costs = self.vectors[vector], before(symbol, self.vectors[vector])
            while True:
                found = [(x, to) for x, cost, to in edits(symbol, state) if cost + after[to] == costs[state]]
                if costs[state] == INSERT + costs[MADE[state]]:
                    found.append(("I", MADE[state]))
                letter, state = min(found)
                letters.append(letter)
                if letter != "I":
                    break
        return "".join(letters), state


@cache
def tables() -> Tables:
    return Tables()


def repaired(audit: Iterable[str], lines: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(edit, role, text) of the rows that stay, from all rows' (role, text) in order."""
    state, lines = 0, iter(lines)
    for letter in audit:
        role, text = (NAMES[MADE[state]], b"") if letter == "I" else next(lines)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state, INITIALS[role[:1].decode()]]
        else:
            state = MADE[state]
            role = NAMES[state]
        yield letter, role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by a crc32 of conversation and turn; a dropped row has no role."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *spaced)) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 0, None).when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def digest() -> Column:
    """Of role and text, whose lengths keep them apart."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))


def marked_rows(rows: DataFrame) -> DataFrame:
    """Rows with symbol, digest and number of equal rows; a mark with number 0 beside a row that a lower turn has already."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    ends = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    symbol = F.when(trimmed == "", GONE).when(ends, code).otherwise(code + 4)
    read = rows.withColumn("digest", F.when(F.col("role").isNotNull(), digest()).otherwise(F.lit(b"")))
    same = read.groupBy("conv_id", "turn", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("role").alias("role"), F.first("text").alias("text"))
    full = same.select("conv_id", "turn", "digest", "n", F.when(F.col("role").isNotNull(), symbol).alias("symbol"), "role", "text")
    keys = read.filter("role is not null").select("conv_id", "turn", "digest")
    place = F.struct("turn")  # no turn is the lowest
    firsts = keys.groupBy("conv_id", "digest").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("not (low <=> high)")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("low.turn").alias("first"))
    again = keys.distinct().join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & ~F.col("turn").eqNullSafe(F.col("first")))
    marks = again.select("conv_id", "turn", "digest", F.lit(0).alias("n"), *(F.lit(None).cast(t).alias(c) for c, t in (("symbol", "int"), ("role", "string"), ("text", "string"))))
    return full.unionByName(marks)


class Piece:
    """Rows of one conversation, in order, as symbols, texts and what is counted."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.lines = conv_id, bytearray(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.turn_first = self.turn_last = None
        self.initial_first = self.initial_last = None

    def add(self, turn: int | None, symbol: int, again: bool, role: str, text: str, n: int) -> None:
        """``n`` equal rows; ``again``: they are in the conversation already."""
        if symbol == GONE:
            self.blank += n
        else:
            self.duplicate += n - (not again)
            self.truncated += symbol >= 4 and not again
        self.symbols.append(GONE if again else symbol)
        self.symbols += bytes([GONE]) * (n - 1)
        self.lines.append((b"", b"") if again or symbol == GONE else (role.encode(), text.encode()))
        self.lines += [(b"", b"")] * (n - 1)  # of a row that must go the text is not needed
        self.illegal += n - 1 if n > 1 else 0  # equal initials
        self.meet(role[:1], role[:1], turn, turn, 0 if turn is None else 1)

    def meet(self, first: str | None, last: str | None, low: int | None, high: int | None, n_turns: int) -> None:
        """Join what follows: its first and last initial, turns and their number."""
        if first is not None:
            if self.initial_last is None:
                self.initial_first = first
            else:
                self.illegal += self.initial_last + first not in ("su", "ua", "au")
            self.initial_last = last
        if low is not None:
            self.n_turns += n_turns - (low == self.turn_last)
            self.turn_first = low if self.turn_first is None else self.turn_first
            self.turn_last = high

    def facts(self) -> dict:
        gaps = 0 if self.turn_first is None else self.turn_last - self.turn_first + 1 - self.n_turns
        return {"conv_id": self.conv_id, "gaps": gaps} | {k: getattr(self, k) for k in SUMMED}

    def result(self) -> dict:
        cost, audit = tables().repair(bytes(self.symbols))
        return self.facts() | {"cost": cost, "audit": audit, "repaired_sha256": sha(repaired(audit, self.lines))}

    def parts(self, at: int, seq: int) -> Iterator[dict]:
        """One row with the facts and symbols, then rows with texts of bounded size."""
        own = {k: getattr(self, k) for k in ("turn_first", "turn_last", "n_turns", "initial_first", "initial_last")}
        yield self.facts() | own | {"at": at, "seq": 2 * seq, "symbols": bytes(self.symbols)}
        yield {"conv_id": self.conv_id, "at": at, "seq": 2 * seq + 1, "lines": [x for line in self.lines for x in line]}


def sha(rows: Iterable[tuple[str, bytes, bytes]]) -> str:
    """SHA-256 of the rows' ``role:text``, joined by newlines."""
    total = hashlib.sha256()
    for i, (_, role, text) in enumerate(rows):
        total.update(b"\n" * (i > 0) + role + b":")
        total.update(text)
    return total.hexdigest()


def batches_of(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row.get("lines") or ())) + len(row.get("audit") or "")
        if len(held) >= BATCH_ROWS or size > LINE_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in ddl.split(", "))])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations inside a task's range, parts of its first and last one."""

    def pieces() -> Iterator[tuple[bool, Piece, int]]:
        """(whether more of the conversation may lie elsewhere, rows, number of the piece)."""
        piece, seq, size, mark = None, 0, 0, None
        open_ = True  # the range may have cut the first conversation, and the last one
        for batch in batches:
            for conv_id, turn, digest_, n, symbol, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        yield open_, piece, seq
                        open_ = False
                    piece, seq, size, mark = Piece(conv_id), 0, 0, None
                if n == 0:
                    mark = (turn, digest_)
                elif symbol is not None:
                    if len(piece.symbols) >= PART_ROWS or size > LINE_BYTES:
                        open_ = True  # too long for one piece: all its pieces are parts
                        yield True, piece, seq
                        piece, seq, size = Piece(conv_id), seq + 1, 0
                    piece.add(turn, symbol, (turn, digest_) == mark, role, text, n)
                    size += len(text)
        if piece is not None:
            yield True, piece, seq

    def rows() -> Iterator[dict]:
        at = TaskContext.get().partitionId()
        for cut_off, piece, seq in pieces():
            if cut_off:
                yield from piece.parts(at, seq)
            else:
                yield piece.result()

    yield from batches_of(rows(), arrow(PARTS))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose parts arrive in order: all facts and symbols first, then all texts."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def conversations() -> Iterator[dict]:
        stream = rows()
        row = next(stream, None)
        while row is not None:
            piece = Piece(row["conv_id"])
            while row is not None and row["conv_id"] == piece.conv_id and row["lines"] is None:
                for k in SUMMED:
                    setattr(piece, k, getattr(piece, k) + row[k])
                piece.meet(row["initial_first"], row["initial_last"], row["turn_first"], row["turn_last"], row["n_turns"])
                piece.symbols += row["symbols"]
                row = next(stream, None)
            cost, audit = tables().repair(bytes(piece.symbols))

            def lines() -> Iterator[tuple[bytes, bytes]]:
                nonlocal row
                while row is not None and row["conv_id"] == piece.conv_id:  # noqa: B023 - used before the next one
                    yield from zip(row["lines"][::2], row["lines"][1::2], strict=True)
                    row = next(stream, None)

            rest = lines()
            done = piece.facts() | {"cost": cost, "audit": audit, "repaired_sha256": sha(repaired(audit, rest))}
            for _ in rest:  # rows behind the last edit: none
                pass
            yield done

    yield from batches_of(conversations(), arrow(RESULT))


def repair(rows: DataFrame) -> DataFrame:
    """Facts, cost, audit and hash of the repaired text of every conversation of (conv_id, turn, role, text).

    A row without a role stands for a row that is not there; it only names its conversation.
    """
    order = ["conv_id", "turn", "digest"]  # a mark and its row stay in one range
    ranged = marked_rows(rows).repartitionByRange(*order).sortWithinPartitions(*order, "n")
    found = cut(ranged.mapInArrow(scan, PARTS), "conversations")
    whole = [c.split(" ")[0] for c in RESULT.split(", ")]
    parts = found.filter("at is not null").repartition("conv_id")
    parts = parts.sortWithinPartitions("conv_id", F.col("lines").isNotNull(), "at", "seq")
    return found.filter("at is null").select(*whole).unionByName(parts.mapInArrow(joined, RESULT))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
