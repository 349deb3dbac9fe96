"""Conversation repair against a search over all edits, and against a plain table of costs and strings."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessera.llm import repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
GOOD = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        m = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(conv, turn, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        fault = "" if text.strip(SPACE) else "b"
        fault = fault or ("d" if (role, text) in seen else "" if text.rstrip(SPACE)[-1] in ".!?" else "t")
        seen.add((role, text))
        out.append(fault)
    return out


def plain_best(rows, found):
    """(cost, audit, lines) by a recursion over rows and the initials so far, told apart by what may follow them."""
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, at, inserted):
        ways = [(0, "", ())] if i == len(rows) and at in ("", "a") else []
        steps = []
        if inserted < 3:
            steps += [(5, "I", i, r, inserted + 1, (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            more = 5 if found[i] == "t" else 0
            steps.append((2, "D", i + 1, None, 0, ()))
            if found[i] not in ("b", "d"):
                steps.append((more, "K", i + 1, role, 0, (f"{role}:{text}",)))
                steps += [(1 + more, "R", i + 1, r, 0, (f"{r}:{text}",)) for r in ("user", "assistant") if r != role]
        for cost, letter, j, role, k, line in steps:
            if role is None or role[:1] in nexts[at]:
                rest = best(j, at if role is None else nexts[at][role[:1]], k)
                if rest:
                    ways.append((cost + rest[0], letter + rest[1], line + rest[2]))
        return min(ways, default=None)

    return best(0, "", 0)


def plain_summary(rows, conv):
    own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
    own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    found = faults(own)
    cost, audit, lines = plain_best(own, found)
    turns = {t for t, _, _ in own if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
    bad = sum(p not in ("su", "ua", "au") for p in pairs)
    return (conv, gaps, found.count("b"), found.count("d"), found.count("t"), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(rng, n):
    texts = ["Hello.", "Why?", "no end", "cut, ", "Yes!\n", "", " \t", "Hello.", "a.b", "Σ ok.", None, "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "users"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(9)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {conv} {turn}."
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), role, text))
    return rows


def test_summaries(spark):
    rng = random.Random(8)
    rows = conversations(rng, 150)
    rows += rows[:9] + [(900, 2**60 + 1, "user", "Hi."), (900, 2**60 + 4, "assistant", "Yes."), (900, None, "system", "S.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("digest", F.lit(1)).withColumn("kind", F.lit("x")).repartition(5)
    got = sorted(map(tuple, repair.audit(repair.damaged(table)).collect()), key=str)
    after = plain_damage(rows)
    assert got == sorted((plain_summary(after, c) for c in {r[0] for r in rows}), key=str)
    assert any("R" in r[7] for r in got)  # one deletion mends what an insertion can, for less
    plain = sorted(map(tuple, repair.audit(table).collect()), key=str)
    assert plain == sorted((plain_summary(rows, c) for c in {r[0] for r in rows}), key=str)
    assert repair.audit(repair.damaged(table.limit(0))).count() == 0


def test_rows_are_good(spark):
    rows = conversations(random.Random(9), 60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = repair.repaired(table).collect()
    kept: dict = {}
    for r in sorted(edits, key=lambda r: r.place):
        if r.edit != "D":
            kept.setdefault(r.conv_id, []).append(r)
    assert kept and all(GOOD.fullmatch("".join(r.role[0] for r in some)) for some in kept.values())
    summary = {r.conv_id: r for r in repair.audit(table).collect()}
    for conv, some in kept.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in some).encode()).hexdigest() == summary[conv].repaired_sha256


@pytest.mark.parametrize("chunk", [1, 7])
def test_giant_conversation(spark, monkeypatch, chunk):
    """More rows than a chunk and a batch hold; chunks of any size give the same edits."""
    rng = random.Random(3)
    texts = [None, "", "x", "same.", *(f"t{k}." for k in range(3000))]
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(texts)) for t in range(900)] + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Ho.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(repair, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted(map(tuple, repair.audit(table).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = [r for r in rows if r[0] == 1]
    own.sort(key=lambda r: (r[1], r[2].encode(), hashlib.sha256((r[3] if r[3] is not None else " ").encode()).digest()))
    known = [(r[1], r[2], " " if r[3] is None else r[3]) for r in own]
    found = faults(known)
    program, state, cost, bytes_ = repair.Program(), 0, 0, []
    for (_, role, _), fault in zip(reversed(known), reversed(found)):
        bit = {"": 0, "b": repair.BLANK, "d": repair.DUPLICATE, "t": repair.TRUNCATED}[fault]
        state, more, edits = program.step(state, "sua".find(role[0]) % 4 | bit)
        cost += more
        bytes_.append(edits)
    assert got[0][6] == cost + program.vectors[state][0]
    assert got[0][2:5] == (found.count("b"), found.count("d"), found.count("t"))
    assert len(got[0][7].replace("I", "")) == 900
    assert got[1][1:8] == (0, 0, 0, 0, 0, 0, "KK")
