"""SimHash near-duplicates against plain Python: words, hashes, bits, and components of all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots)), key=str)


def test_texts_of_all_kinds(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    near = [base.replace(f" w{k} ", f" other{k} ", 1) for k in range(60)]
    odd = [None, "", " \t\n", "one", "One  TWO", "one two", "a\x1cb c\x0bd  e", "é É Ü x y z", "\x85 a b c", "long" * 40_000, "w " * 30_000, "x" * 70_000 + " y z"]
    texts = [*odd, base, base.upper(), base.replace(" ", "\n "), *near, *(" ".join(f"v{rng.randrange(90)}" for _ in range(rng.randrange(9))) for _ in range(80))]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(3, "twice"), (3, "twice"), (4, base), (None, base), (None, "alone at last"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit(1)).withColumn("label", F.lit("x")).repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == expected(rows)
    assert len({c for _, _, c in got}) < len({f for _, f, _ in got})  # some differ and are linked
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [0, 3, 256])
def test_no_link_is_lost(spark, crowd):
    """Prints with few bits around a few centres: segments are shared by hundreds."""
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centres for _ in range(300)}
    prints |= {0, (1 << 64) - 1, 1, 3, 1 << 63, 3 << 62, (1 << 63) | 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), crowd).collect()
    got = {frozenset((u % (1 << 64), v % (1 << 64))) for u, v in found}
    want = {frozenset((p, q)) for p in prints for q in prints if p != q and (p ^ q).bit_count() <= 2}
    assert got == want
