"""Periodic runs and grammar extensions against plain Python."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic
from tessera.llm.recompression import Grammar


def plain_runs(words):
    """All runs by trying every period over the whole sequence."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, k, q) for (s, k), q in best.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences(rng):
    for kinds in (1, 2, 3, 30):
        for size in (0, 1, 11, 12, 13, 60, 200):
            yield [rng.randrange(kinds) for _ in range(size)]
    fib, last = [0], [0, 1]
    while len(last) < 300:
        fib, last = last, last + fib
    yield last
    unit = [rng.randrange(9) for _ in range(23)]
    yield [5, *unit * 4, *unit[:7], 6, *unit * 2, *[7] * 30, *([1, 2] * 9), 1, *[3] * 11]


def test_runs_of_sequences():
    rng = random.Random(2)
    for _ in range(3):
        some = list(sequences(rng))
        found = periodic.run_table([np.array(s, np.int64) for s in some])
        assert [list(map(tuple, f.tolist())) for f in found] == [sorted(plain_runs(s), key=lambda r: (r[0], r[2])) for s in some]


def test_extensions():
    rng = random.Random(3)
    for s in sequences(rng):
        s = [*s, *s[: len(s) // 2]]
        flat = np.array([0, *s, 0], np.int64)
        g = Grammar(flat, np.array([0, len(flat) - 1]))
        pairs = [(i, j) for i in range(1, len(s) + 1) for j in range(1, len(s) + 1) if i != j]
        if not pairs:
            continue
        i, j = np.array(rng.sample(pairs, min(2000, len(pairs)))).T
        fore, back = g.forward(i, j), g.backward(i, j)
        for a, b, f, r in zip(i - 1, j - 1, fore, back):
            want = next((k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), 0)
            assert f == want
            assert r == next((k for k in range(len(s) + 1) if min(a, b) - 1 - k < 0 or s[a - 1 - k] != s[b - 1 - k]), 0)


def test_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "a " * 12, "a " * 11, "a b " * 40 + "c", "a\tb\x0bc a b c\n" * 9, "x\x1cy x\x1cy " * 7, "É é " * 20]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(150))) for _ in range(120)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(5, texts[-1])] * 2 + [(None, texts[6]), (None, None)]
    rows += [(i, "one two three four five six seven eight nine ten eleven twelve thirteen") for i in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("x")).repartition(3)
    got = periodic.runs(docs).drop("runs")
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert periodic.runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [["a"], ["a", "b", "a"], [str(k) for k in range(999)]])
def test_long_texts(unit):
    words = np.array([hash(w) % (1 << 31) for w in unit] * (300_000 // len(unit)), np.int64)
    started = time.process_time()
    found = periodic.run_table([words])[0]
    assert (0, len(words), len(unit)) in map(tuple, found.tolist()) or len(unit) == 3
    assert time.process_time() - started < 60
