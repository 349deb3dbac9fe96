"""Repair of conversation structure by the cheapest edits, as a dynamic program over sorted streams.

A conversation's roles must read (s?(ua)+)? by their initials. Two passes follow the rows of a conversation, each
repartitioned by conversation and sorted by turn, with a state carried from one Arrow batch to the next:

1. From the last row to the first, over narrow rows without texts: the state is the least cost of the rest for each
   of four places in the grammar. The vectors differ by small numbers only, so the program is an automaton whose
   transitions are worked out once. The edit chosen at each place, a byte a row, goes out as a row for each CHUNK of
   them: giant conversations spill their backpointers to Spark's own shuffle.
2. From the first row to the last, with texts and those chunks, which sort before their rows: the edits are read off
   and carried out. No conversation's rows are ever held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places in the grammar: nothing yet, after the system row, after a user row, after an assistant row. The whole is good in the first and last.
FORCED = (2, 2, 3, 2)
#: By initial s, u, a and any other: where a row that is kept leads to from each place.
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS, ROLES = "DIKR", {2: "user", 3: "assistant"}
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT_SHORT = 5
AT_END = (0, 10, 5, 0)
#: What is known of a row, in bits above its initial's number.
BLANK, DUPLICATE, TRUNCATED, GONE = 4, 8, 16, 32
CHUNK = 1 << 16
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "place long, edit string, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text; nulls count as one space) with faults by the checksum of conv_id:turn.

    Of 20 remainders 0 drops a row (it stays with gone set, so that its conversation is known), 1 empties its text, 2
    takes its .!? away, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("m"))
    m = F.col("m")
    return rows.select(
        "conv_id", "turn", F.when(m == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(m == 1, "").when(m == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), (m == 0).alias("gone"),
        F.explode(F.when(m == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with their conversation as text and the parts of their place in it."""
    blank = F.lit(" ")
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    r = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), gone.alias("gone"))
    return r.withColumns({"timed": F.col("turn").isNotNull(), "turn": F.coalesce("turn", F.lit(0)), "digest": F.unhex(F.sha2("text", 256))})


PLACE = ["timed", "turn", "role", "digest"]


class Program:
    """The costs of the rest of a conversation, as an automaton from its end to its beginning.

    A state is a vector of costs less its smallest; step(state, row) gives the next state, what its smallest cost grew
    by, and the edits chosen at the four places, two bits each.
    """

    def __init__(self):
        self.vectors, self.number, self.known = [AT_END], {AT_END: 0}, {}

    def step(self, state: int, row: int) -> tuple[int, int, int]:
        key = state << 8 | row
        if key not in self.known:
            costs, edits = self._costs(self.vectors[state], row)
            least = min(costs)
            vector = tuple(c - least for c in costs)
            if vector not in self.number:
                self.number[vector] = len(self.vectors)
                self.vectors.append(vector)
            self.known[key] = self.number[vector], least, sum(e << 2 * s for s, e in enumerate(edits))
        return self.known[key]

    @staticmethod
    def _costs(rest: tuple, row: int) -> tuple[list[int], list[int]]:
        own = []
        for s in range(4):
            ways = [(COSTS[DELETE] + rest[s], DELETE)]
            if not row & (BLANK | DUPLICATE):
                late = CUT_SHORT if row & TRUNCATED else 0
                ways.append((COSTS[REROLE] + late + rest[FORCED[s]], REROLE))
                if s in KEPT[row & 3]:
                    ways.append((COSTS[KEEP] + late + rest[KEPT[row & 3][s]], KEEP))
            own.append(min(ways))
        costs = [c for c, _ in own]
        for _ in range(3):  # insertions before the row; more than two in a row never pay
            costs = [min(own[s][0], COSTS[INSERT] + costs[FORCED[s]]) for s in range(4)]
        return costs, [min(own[s], (COSTS[INSERT] + costs[FORCED[s]], INSERT))[1] for s in range(4)]


def backpointers(keyed: DataFrame) -> DataFrame:
    """conv, PLACE of the chunk's first row, choices (a byte a row, in order of turn), faults and cost of that part of the conversation."""
    same = Window.partitionBy("conv", "gone", "role", "digest").orderBy("timed", "turn")
    blank = F.trim("text", F.lit(SPACE)) == ""
    ended = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(0)
    narrow = keyed.select("conv", *PLACE, "gone", blank.alias("blank"), ended.alias("ended"), initial.alias("initial"))
    narrow = narrow.withColumn("again", F.row_number().over(same) > 1).select("conv", *PLACE, "again", (F.col("initial") + F.when(F.col("gone"), GONE).otherwise(fault)).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, now, begun, state, cost, choices, faults, place, done = Program(), None, False, 0, 0, bytearray(), [0, 0, 0], None, 0
        out: list[tuple] = []

        def close(last: bool) -> None:
            """A chunk's row; the conversation's cost goes with the last, which has its first rows."""
            nonlocal choices, faults, done
            if begun and choices:
                done += len(choices)
                out.append((now, *place, bytes(choices[::-1]), done, *faults, cost + program.vectors[state][0] if last else 0))
            choices, faults = bytearray(), [0, 0, 0]

        for b in batches:
            for conv, known, *at in zip(b["conv"], b["known"].tolist(), *(b[c] for c in PLACE)):
                if conv != now or not begun:
                    close(True)
                    now, begun, state, cost, done = conv, True, 0, 0, 0
                if len(choices) == CHUNK:
                    close(False)
                place = at
                if known & GONE:
                    continue
                state, more, edits = program.step(state, known)
                cost += more
                choices.append(edits)
                for k, bit in enumerate((BLANK, DUPLICATE, TRUNCATED)):
                    faults[k] += bool(known & bit)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=CHUNK_NAMES)
                out = []
        close(True)
        yield pd.DataFrame(out, columns=CHUNK_NAMES)

    down = [F.col("conv"), *(F.col(c).desc() for c in (*PLACE, "again"))]  # of rows that are alike in all, the first is none of the duplicates
    return narrow.repartition("conv").sortWithinPartitions(*down).mapInPandas(run, CHUNKS)


CHUNKS = "conv string, timed boolean, turn long, role string, digest binary, choices binary, from_end long, blank long, duplicate long, truncated long, cost long"
CHUNK_NAMES = [x.split()[0] for x in CHUNKS.split(", ")]


class Walk:
    """One conversation from its first row to its last: the edits that its backpointers say, and its summary."""

    def __init__(self, conv):
        self.conv, self.state, self.waiting, self.at = conv, 0, [], 0
        self.counts, self.before, self.illegal = [0, 0, 0, 0], None, 0
        self.turns, self.low, self.high = 0, None, None

    def chunk(self, choices: bytes, counts: list) -> None:
        self.waiting.append(choices)
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def row(self, timed: bool, turn: int, role: str, text: str) -> Iterator[tuple]:
        """(edit, role, text) of what is inserted before the row, and of the row."""
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if timed and (self.turns == 0 or turn != self.high):
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        byte = self.waiting[0][self.at]
        self.at += 1
        if self.at == len(self.waiting[0]):
            self.waiting.pop(0)
            self.at = 0
        while (edit := byte >> 2 * self.state & 3) == INSERT:
            yield self._insert()
        if edit != DELETE:
            self.state = FORCED[self.state] if edit == REROLE else KEPT["sua".index(role[0])][self.state]
            role = ROLES[self.state] if edit == REROLE else role
        yield edit, role, text

    def end(self) -> Iterator[tuple]:
        """What is inserted after the last row."""
        while AT_END[self.state]:
            yield self._insert()

    def _insert(self) -> tuple:
        self.state = FORCED[self.state]
        return INSERT, ROLES[self.state], ""

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def _walked(rows: DataFrame, schema: str, make) -> DataFrame:
    """What make() gives for each conversation of rows, in one stream: make(walk) is told of every edit, and gives rows with add and end."""
    keyed = _keyed(rows)
    none = F.lit(None)
    chunks = backpointers(keyed).select("conv", *PLACE, F.lit(0).alias("kind"), (-F.col("from_end")).alias("order"), none.cast("string").alias("text"), F.lit(False).alias("gone"), "choices", "blank", "duplicate", "truncated", "cost")
    texts = keyed.select("conv", *PLACE, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("order"), "text", "gone", none.cast("binary").alias("choices"), *(F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "cost")))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * (len(names) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), *kinds])], ["conv", *names])

    def run(batches):
        walk = maker = None
        out: list[tuple] = []

        def finish() -> None:
            for edit in walk.end():
                out.extend(maker.add(walk, edit))
            out.extend(maker.end(walk))

        columns = ["conv", "kind", "timed", "turn", "role", "text", "gone", "choices", "blank", "duplicate", "truncated", "cost"]
        for b in batches:
            for conv, kind, timed, turn, role, text, gone, choices, *counts in zip(*(b.column(c).to_pylist() for c in columns)):
                if walk is None or conv != walk.conv:
                    if walk:
                        finish()
                    walk, maker = Walk(conv), make()
                if kind == 0:
                    walk.chunk(choices, counts)
                elif not gone:
                    for edit in walk.row(timed, turn, role, text):
                        out.extend(maker.add(walk, edit))
            yield batch(out)
            out = []
        if walk:
            finish()
        yield batch(out)

    sorted_ = chunks.unionByName(texts).repartition("conv").sortWithinPartitions("conv", *PLACE, "kind", "order")
    done = sorted_.mapInArrow(run, f"conv string, {schema}")
    return done.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *names)


class _Rows:
    def __init__(self):
        self.place = -1

    def add(self, walk: Walk, edit: tuple) -> list[tuple]:
        self.place += 1
        return [(walk.conv, self.place, LETTERS[edit[0]], *edit[1:])]

    def end(self, walk: Walk) -> list[tuple]:
        return []


class _Summary:
    def __init__(self):
        self.audit, self.hash, self.some = bytearray(), hashlib.sha256(), False

    def add(self, walk: Walk, edit: tuple) -> tuple:
        self.audit.append(ord(LETTERS[edit[0]]))
        if edit[0] != DELETE:
            self.hash.update(f"{chr(10) if self.some else ''}{edit[1]}:{edit[2]}".encode())
            self.some = True
        return ()

    def end(self, walk: Walk) -> list[tuple]:
        blank, duplicate, truncated, cost = walk.counts
        return [(walk.conv, walk.gaps, blank, duplicate, truncated, walk.illegal, cost, self.audit.decode(), self.hash.hexdigest())]


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id and EDITS: every edit of each conversation of rows (see audit) in order; rows with edit D are those that go."""
    return _walked(rows, EDITS, _Rows)


def audit(rows: DataFrame) -> DataFrame:
    """conv_id and SUMMARY of each conversation of rows (conv_id, turn, role, text; gone, if there, marks rows that are only named).

    Rows are in order of turn, nulls first; those of one turn in order of role, then of their text's SHA-256. A row is
    blank without a character other than white space, else a duplicate if role and text came before, else truncated if
    its last such character is none of .!?. Keeping costs 0, another role 1, deleting 2 (blank and duplicate rows must
    go), inserting an empty user or assistant row 5, and a truncated row that stays 5 more; audit has the cheapest
    edits' initials, of equally cheap ones the ASCII-least. Null roles and texts count as one space, a null conv_id is a
    conversation like others, repeated rows are duplicates, an empty table gives no rows; other columns are ignored. A
    conversation with no row left has zeros, an empty audit and the hash of nothing. A conversation passes through one
    task, as the hash of its texts must, a batch at a time; its own audit is all that grows with it.
    """
    return _walked(rows, SUMMARY, _Summary)
