"""Near duplicates, exact copies, benchmark leaks and repeated bytes against plain versions, with odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import common, decontam, exact_dedup, licenses, lm_score, minhash, suffix_dedup
from tessera.llm.common import words_of
from tessera.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, key string, name string, n long, label long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "k", "x", 1, 2) for i, t in rows], DOCS)


def words(g, n, vocabulary=4000):
    return [f"w{g.randrange(vocabulary)}" for _ in range(n)]


def edited(g, base, share):
    return [f"e{g.randrange(10**6)}" if g.random() < share else w for w in base]


@pytest.fixture(scope="module")
def docs():
    g = random.Random(5)
    rows = []
    for _ in range(30):
        base = words(g, g.randint(30, 200))
        rows += [" ".join(edited(g, base, s)) for s in (0, 0.005, 0.02, 0.03, 0.1, 0.2)]
    hot = words(g, 150)  # one large group, some of it too far from its first member
    rows += [" ".join(edited(g, hot, g.choice([0.005, 0.01, 0.02, 0.04, 0.08]))) for _ in range(150)]
    rows += [rows[0]] * 40 + ["", None, "  ", "a b c", "A b, c!", "a", "..."]
    ids = list(range(len(rows)))
    g.shuffle(ids)
    return list(zip(ids, rows)) + [(ids[0], rows[0]), (None, "null id"), (None, None)]


def shingled(text):
    w = words_of((text or "").encode())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(rows):
    s, parent = {}, {}
    for i, t in rows:
        if i is not None:
            s[i], parent[i] = shingled(t), i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(s), 2):
        x, y = s[a], s[b]
        both = sum((x & y).values())
        total = sum(x.values()) + sum(y.values()) - both
        if (both / total if total else 1) >= 0.8:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {i: root(i) for i in s}


def test_near_duplicates(spark, docs):
    got = minhash.near_duplicates(make(spark, docs)).collect()
    want = plain_classes(docs)
    assert len(got) == len(docs)
    size = Counter(want[i] for i, _ in docs if i is not None)
    for r in got:
        if r.doc_id is None:
            assert (r.class_id, r.class_size, r.is_kept) == (None, 1, True)
        else:
            assert r.class_id == want[r.doc_id] and r.class_size == size[r.class_id] and r.is_kept == (r.doc_id == r.class_id)
    assert minhash.near_duplicates(make(spark, [])).count() == 0
    kept = minhash.keep_one(make(spark, docs))
    assert kept.columns == make(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None).keys() == {i for i in want if want[i] == i}


def test_blocks_of_a_large_bucket(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    want = plain_classes(docs)
    assert all(r.class_id == want[r.doc_id] for r in minhash.near_duplicates(make(spark, docs)).collect() if r.doc_id is not None)


def test_lower_thresholds(spark):
    assert minhash.bands_of(0.8) == (25, 5) and round(minhash.estimate_of(0.8, 125), 2) == 0.62 and decontam.radius_of(0.8) == 63
    g, rows, items = random.Random(21), [], []
    for k in range(100):  # each pair's similarity is a little over 0.6
        base = words(g, 120)
        for at in g.sample(range(0, 116, 8), 4):
            base[at] = "x"
        other = list(base)
        for at in range(6, 114, 24):
            other[at] = f"y{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        items.append((k, " ".join(base)))
        a, b = shingled(rows[-2][1]), shingled(rows[-1][1])
        assert 0.6 < sum((a & b).values()) / sum((a | b).values()) < 0.75
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make(spark, rows), 0.6).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(100))
    found = decontam.matches(make(spark, rows[1::2]), spark.createDataFrame(items, "item_id long, text string"), 0.6).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(2 * k + 1, k) for k in range(100)}


def test_signatures_agree_as_often_as_sets_are_similar():
    import numpy as np

    g = np.random.default_rng(3)
    e = g.integers(1, 2**62, 300).astype(np.uint64)
    w = g.integers(1, 9, 300)
    v = np.where(g.random(300) < 0.3, g.integers(0, 9, 300), w)
    a, b = (e, w), (e[v > 0], v[v > 0])
    true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    x, y = minhash.signatures([a, b], 2000)
    assert abs((x == y).mean() - true) < 0.05


def test_components(spark):
    g = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(g.randrange(300, 400), g.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {x: root(x) for x in list(parent)} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def bare(t):
    return (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


@pytest.mark.parametrize("block", [3, 2048])
def test_exact_dedup(spark, docs, block):
    g = random.Random(9)
    rows = docs + [(1000 + k, " ".join(f"x{j}" for j in range(700)) + " " * k) for k in range(6)] + [(2000 + k, "ab" * g.randint(0, 9)) for k in range(60)]
    rows += [(3000, "é" * 50), (3001, "é " * 50), (3002, "e" * 50), (1003, rows[0][1])]
    got = exact_dedup.exact_dedup(make(spark, rows).coalesce(1), block).orderBy("rid").collect()
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[bare(t)].append((-len(t or ""), d is None, d or 0, i))
    for r, (d, t) in zip(got, rows):
        group = groups[bare(t)]
        best = min(group)
        assert (r.doc_id, r.group_size, r.text_sha256) == (d, len(group), hashlib.sha256(bare(t).encode()).hexdigest())
        assert r.keep_id == rows[best[3]][0]
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(make(spark, [])).count() == 0
    kept = exact_dedup.keep_one(make(spark, rows).coalesce(1), block).collect()
    assert Counter(bare(r.text) for r in kept) == Counter(groups.keys())


def test_decontamination(spark):
    g = random.Random(2)
    items = [(k, " ".join(words(g, g.randint(5, 60), 300))) for k in range(40)] + [(40, "one two"), (41, ""), (42, None), (43, "a b c d e"), (None, "no id but words enough here"), (44, "two"), (45, "c d e f"), (46, "d e f")]
    texts = []
    for k in range(60):
        item = g.choice(items[:40])[1].split()
        change = g.choice([0, 0, 0.02, 0.05, 0.3])
        cut = item[: len(item) * 9 // 10] if k % 5 == 0 else item
        texts.append(" ".join(words(g, g.randint(0, 80), 300) + edited(g, cut, change) + words(g, g.randint(0, 80), 300)))
    texts += ["", None, "a b c d e", "A, b. c d - e f", items[3][1], items[4][1].rsplit(" ", 1)[0], "no id but words enough here", texts[0], "one", "two", "One two", "zero one two", "c d e f", "d e f g h"]
    rows = list(enumerate(texts)) + [(None, items[5][1])]
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in rows:
        w = words_of((t or "").encode())
        for k, x in items:
            y = words_of((x or "").encode())
            n, m = min(len(y), len(w)), len(y)
            if m < 5 or n < 5:  # an item under five words is one shingle; a document under five words holds no longer one
                places = [s for s in range(len(w) - m + 1) if w[s : s + m] == y] if 0 < m < 5 else []
                want |= {(i, k): (1.0, places[0])} if places else {}
                continue
            a = Counter(tuple(y[j : j + 5]) for j in range(m - 4))
            for s in range(len(w) - n + 1):
                b = Counter(tuple(w[j : j + 5]) for j in range(s, s + n - 4))
                both = sum((a & b).values())
                like = both / (sum(a.values()) + sum(b.values()) - both)
                if like >= 0.8 and like > want.get((i, k), (0, 0))[0]:
                    want[i, k] = (like, s)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k].similarity - v[0]) < 1e-9 and got[k].start_word == v[1] for k, v in want.items())
    assert decontam.matches(make(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.matches(make(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0
    left = decontam.clean(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in left} == ({i for i, _ in rows} - {i for i, _ in want}) | {None}


def test_index_finds_all_within_the_radius():
    import numpy as np

    g = np.random.default_rng(1)
    items = g.integers(0, 1 << 63, (30, 4)).astype(np.uint64)
    number = lambda p: sum(int(x) << 64 * k for k, x in enumerate(p))
    near = [number(x) ^ sum(1 << int(b) for b in g.choice(256, int(k), replace=False)) for x in items for k in g.integers(40, 70, 12)]
    near += [number(x) ^ sum(1 << 16 * b + j for b in range(16) for j in range(4)) for x in items]  # as even as can be
    q = np.array([[p >> 64 * k & (1 << 64) - 1 for k in range(4)] for p in near], np.uint64)
    for radius in (0, 15, 63, 64, 88):
        index = decontam.MultiIndex(items, radius)
        want = {(a, b, (near[a] ^ number(items[b])).bit_count()) for a in range(len(q)) for b in range(30)}
        assert set(index.within(q)) == {x for x in want if x[2] <= radius}


def test_index_lets_few_others_through():
    import numpy as np

    g = np.random.default_rng(2)
    hashes = g.integers(0, 1 << 63, 10_000 * 30).astype(np.uint64)
    items = np.concatenate([decontam.fingerprints(hashes, np.arange(k, k + 1), 30) for k in range(0, len(hashes), 30)])
    index = decontam.MultiIndex(items, decontam.radius_of(0.8))
    asked = decontam.fingerprints(g.integers(0, 1 << 63, 1000).astype(np.uint64), np.arange(200), 30)
    assert np.mean([len(index.candidates(v)) for v in index._blocks(asked).T]) < 0.05 * len(items)


def plain_removed(rows):
    first = {}
    for d, x in rows:
        for p in range(len(x) - 99):
            g = x[p : p + 100]
            first[g] = min(first.get(g, (d, p)), (d, p))
    out = []
    for d, x in rows:
        gone = bytearray(len(x))
        for p in range(len(x) - 99):
            if first[x[p : p + 100]] < (d, p):
                gone[p : p + 100] = b"\1" * 100
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [2_000, 0])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", hot)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1500)
    suffix_dedup._powers.clear()
    g = random.Random(4)
    passages = ["".join(g.choice("abcdé ") for _ in range(n)) for n in (90, 99, 100, 101, 160, 400, 1700)]
    texts = []
    for k in range(70):
        parts = []
        for _ in range(g.randint(0, 5)):
            parts.append("".join(g.choice("abcdefgh ") for _ in range(g.randint(0, 300))))
            x = g.choice(passages)
            parts.append(x if g.random() < 0.6 else x[g.randrange(40) : len(x) - g.randrange(40)])
        texts.append("".join(parts))
    texts += ["a" * 5000, "a" * 350, "ab" * 400, "", None, texts[3], texts[3], "x" * 99, "x" * 99]
    ids = list(range(len(texts)))
    g.shuffle(ids)
    rows = list(zip(ids, texts)) + [(ids[5], texts[5]), (None, texts[6])]
    got = suffix_dedup.remove_repeats(make(spark, rows).coalesce(3)).collect()
    data = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    want = Counter()
    for (d, x), gone in zip(data, plain_removed(data)):
        kept = bytes(b for b, c in zip(x, gone) if not c)
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        want[(None if d == 2**63 - 1 else d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.remove_repeats(make(spark, [])).count() == 0
    suffix_dedup._powers.clear()


def test_suffix_order():
    g = random.Random(14)
    unit = "".join(g.choice("ab") for _ in range(150))
    for alphabet in ("ab", "abcdefgh \0\x7f"):
        text = ("".join(g.choice(alphabet) for _ in range(400)) + unit + "b" + unit + unit[20:] + "a" * 130 + "\0" * 120).encode()
        at = np.array(sorted(g.sample(range(len(text) - suffix_dedup.LENGTH + 1), 300)))
        rank = suffix_dedup.suffix_ranks(np.frombuffer(text, np.uint8), at)
        strings = [text[i : i + suffix_dedup.LENGTH] for i in at.tolist()]
        order = {x: k for k, x in enumerate(sorted(set(strings)))}
        assert len(order) < len(strings) and rank.tolist() == [order[x] for x in strings]


def test_tables_are_tidied(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_root", lambda s: f"file://{tmp_path}")
    common.written(spark.range(3), "three")
    assert len(list(tmp_path.rglob("*.parquet"))) > 0
    common.tidy(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_numbers_of_rows(spark, tmp_path):
    spark.range(50).selectExpr("id as doc_id").write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    assert "/rows-" not in "".join(common.numbered(files.filter("doc_id > 3"), "rid", "rows").inputFiles())
    mixed = common.numbered(files.repartition(7).orderBy("doc_id"), "rid", "rows")
    assert "/rows-" in "".join(mixed.inputFiles()) and mixed.select("rid").distinct().count() == 50


def test_very_long_texts(spark):
    """Texts longer than all stretches and parts in which operators work, with what they look for late in the text."""
    g = random.Random(31)
    base = words(g, 260_000, 10**6)
    near = edited(g, base, 0.01)
    item = words(g, 40, 300)
    texts = [" ".join(base), " ".join(near), " ".join(base), " ".join([*words(g, 230_000, 10**6), *item, "released under the mit license", *words(g, 5)])]
    assert min(map(len, texts)) > 3 << 19
    df = make(spark, list(enumerate(texts)) + [(4, "short"), (5, None)])
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5}
    found = decontam.matches(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.similarity) for r in found] == [(3, 7, 230_000, 1.0)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert [got[k].n_removed for k in (0, 3, 4, 5)] == [0] * 4 and got[2].n_removed == len(texts[2]) and got[2].n_spans == 1
    assert 0.2 * len(texts[1]) < got[1].n_removed < len(texts[1])
    scanned = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (scanned[3].labels, scanned[3].first_word, scanned[3].n_words) == ("mit", 230_043, 230_050) and scanned[0].labels == ""
    scores = {r.doc_id: r for r in lm_score.score(df).collect()}
    assert scores[0].n_tokens == 260_001 and scores[0].score == scores[2].score and scores[5].n_tokens == 1
