"""Packing, language, licences, pages, archives and scores against plain versions or round trips, with odd rows."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from base64 import b32encode
from collections import Counter

import numpy as np
import pytest

from tessera.llm import html_extract, langid, licenses, lm_score, packing, warc

DOCS = "doc_id long, text string, lang string, source string, held_out boolean, score string, n_words long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "x", 1) for i, t, lang in rows], DOCS)


def some_docs(n=60, seed=1):
    g = random.Random(seed)
    alphabets = {"xa": ["lor", "em", "ips", "um", "the"], "xb": ["çè", "ñu", "öx", "ül", "der"], "xc": ["щи", "жа", "ло", "мы"]}
    rows = []
    for k in range(n):
        lang = g.choice(list(alphabets))
        w = ["".join(g.choice(alphabets[lang]) for _ in range(g.randint(1, 4))) for _ in range(g.randint(1, 120))]
        rows.append((k, " ".join(x.title() if g.random() < 0.1 else x + g.choice(["", "", ",", "."]) for x in w), lang))
    return rows


ODD = [(900, None, "xa"), (901, "", None), (902, "12 34 !?", "xb"), (903, " \n\t ", "xa"), (None, "lorem ipsum", "xa"), (None, None, None), (0, "lorem", "xa"), (0, "lorem", "xa")]


@pytest.mark.parametrize("capacity", [2048, 16])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*some_docs(), *ODD, (950, "don't İ ΑΣ \x1c 日本 3.14 naïve—x ﬁ é <|endoftext|> 's", "xa"), (951, " ".join("word%d" % k for k in range(5000)), "xa")]
    got = packing.pack(make(spark, rows).coalesce(2), capacity=capacity).collect()
    ids = [np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, _ in rows]
    want = Counter((d, len(x)) for (d, _, _), x in zip(rows, ids))
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (d, _, _), x in zip(rows, ids):
        if d not in (None, 0):
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
                at += r.length
            assert at == len(x)
            assert len(by_doc[d]) <= -(-len(x) // capacity) + 1
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert 1 - sum(map(len, ids)) / (len(bins) * capacity) < 0.12  # two small partitions, each with some open bins
    assert packing.pack(make(spark, [])).count() == 0
    with pytest.raises(ValueError, match="positive"):
        packing.pack(make(spark, []), capacity=0)


@pytest.mark.parametrize("lengths", [[1030] * 2000, [1400] * 2000, [683] * 2000, [33] * 4000, list(range(1, 2500)), [2049] * 500, [700, 1500, 40] * 700])
def test_bins_have_classes_and_little_padding(lengths):
    capacity, bins, rows, waiting = 2048, packing.Bins(0, 2048), [], 0
    for i, n in enumerate(lengths):
        rows += bins.document(i, bytes(4 * n))
        waiting = max(waiting, len(bins.waiting))
    closed = bins.next
    rows += bins.rest()
    by_doc, by_bin = {}, {}
    for d, start, size, _, _, sequence, _ in rows:
        by_doc.setdefault(d, []).append((start, size))
        by_bin.setdefault(sequence, []).append(size)
    for i, n in enumerate(lengths):
        assert sum(size for _, size in by_doc[i]) == n and len(by_doc[i]) <= -(-n // capacity) + 1
    for sizes in (s for q, s in by_bin.items() if q < closed and capacity // s[0] < packing.CLASSES):  # k pieces of class k, and what fills the gap
        k = capacity // sizes[0]
        assert all(capacity // s == k for s in sizes[:k])
    assert 1 - sum(lengths) / (len(by_bin) * capacity) < 0.02 and waiting < 20
    short = [size for d, pieces in by_doc.items() if len(pieces) > 1 and lengths[d] % capacity >= packing.LEAST for _, size in pieces]
    assert min(short, default=packing.LEAST) >= packing.LEAST


def test_encoder_over_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    monkeypatch.setattr(packing, "WORDS", 20)
    monkeypatch.setattr(packing, "PART", 300)
    e = packing.Encoder(packing.default_tokenizer())
    texts = [t for _, t, _ in some_docs(40, 7)] + ["longer " * 200, "a" * 700 + " b"]
    for t, got in zip(texts, e.ids(texts)):
        assert np.frombuffer(got, "<u4").tolist() == e.full.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "\u65e5\u672c\u8a9e\u6f22\u5b57", "\xe9\xe8\xfc"])
def test_long_words(letters):
    """A million letters without white space take seconds and have the tokenizer's ids."""
    e, g = packing.Encoder(packing.default_tokenizer()), random.Random(3)
    for n in (255, 256, 257, 3000, 1_000_000):
        text = "".join(g.choices(letters, k=n))
        started = time.process_time()
        got = next(e.ids([text]))
        assert time.process_time() - started < 20
        assert got == np.array(e.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_language(spark):
    rows = [*some_docs(400), *ODD]
    got = langid.identify(make(spark, rows)).collect()
    lang = {i: x for i, _, x in rows}
    assert len(got) == len(rows)
    out = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert len(out) > 50 and sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.97
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (900, 901, 902, 903):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(make(spark, [])).count() == 0
    kept = langid.keep_identified(make(spark, rows))
    assert kept.columns == make(spark, []).columns and kept.count() == len(rows) - 5
    assert langid.keep_identified(make(spark, [(1, "ab", None), (2, "1", None)])).count() == 1


def test_ngrams_by_hand():
    def plain(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            w = f" {w} "
            out.update(c for c in w if c != " ")
            out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
        return out

    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    for t in ["Ab, abc!  xé-7", "", "a", "日本 ab\n", "12"]:
        codes, n = langid.ngrams(t)
        assert dict(zip(codes.tolist(), n.tolist())) == {code(g): k for g, k in plain(t).items()}


def plain_profile(texts, size):
    n = Counter()
    for t in texts:
        n.update(plain_grams(t))
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return {x: i for i, x in enumerate(sorted(n, key=lambda x: (-n[x], code(x)))[:size])}


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update(w)
        out.update(f" {w} "[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n))
    return out


@pytest.mark.parametrize("at_once", [200, 1])
def test_language_by_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(langid, "LANGUAGES", at_once)  # one language at a time gives the same
    size, rows = 60, [*some_docs(150, 5), *ODD, (960, "the the ips", "xb"), (961, "über " * 3000, "xb")]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
    langs = sorted({x for i, t, x in rows if x and t is not None and not held(i)})
    known = {x: plain_profile([t for i, t, y in rows if y == x and not held(i)], size) for x in langs}
    want = Counter()
    for i, t, _ in rows:
        own = plain_profile([t], size)
        d = sorted((sum(abs(p[x] - k) if x in p else size for x, k in own.items()), lang) for lang, p in known.items())
        want[(i, d[0][1], round((d[1][0] - d[0][0]) / d[1][0], 9) if d[1][0] else 0.0) if own else (i, "und", 0.0)] += 1
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(make(spark, rows), size).collect()) == want


def test_ngrams_of_long_texts(monkeypatch):
    g = random.Random(9)
    texts = ["".join(g.choice("abé \nЖ1") for _ in range(g.randint(0, 60))) for _ in range(100)]
    whole = [langid.ngrams(t) for t in texts]
    for part in (1, 2, 5):
        monkeypatch.setattr(langid, "PART", part)
        for t, (codes, n) in zip(texts, whole):
            x, m = langid.ngrams(t)
            assert x.tolist() == codes.tolist() and m.tolist() == n.tolist()


def test_filter_by_language(spark):
    g = random.Random(3)
    rows = [(k, t, x) for k, t, x in some_docs(200, 2)]
    mixed = " ".join(x for pair in zip(rows[0][1].split(), next(t for _, t, x in rows if x != rows[0][2]).split()) for x in pair)
    strange = "".join(chr(g.randrange(0x4E00, 0x9000)) for _ in range(200))
    kept = {r.doc_id for r in langid.keep_identified(make(spark, [*rows, (500, strange, "xa"), (502, mixed, "xa"), (503, None, "xa")]), least=0.05).collect()}
    assert kept >= set(range(200)) and not kept & {500, 503}


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_licences(spark):
    g = random.Random(3)
    notices = [t for _, t in licenses.TEMPLATES]
    rows = []
    for k in range(150):
        w = g.choice(notices).split()
        w = [x for x in w if g.random() > g.choice([0, 0.1, 0.3])]
        if g.random() < 0.3:
            g.shuffle(w)
        for _ in range(g.choice([0, 0, 1, 3])):
            w.insert(g.randrange(len(w) + 1), g.choice(["the", "license", "é", "odd"]))
        rows.append((k, " ".join([*g.choices(["the", "of", "word", "License,", "under"], k=g.randint(0, 12)), *w, "tail"]), None))
    rows += [(500, "MIT License, MIT license and Apache\nLicense général public license mit licenses", None), *ODD]
    got = licenses.scan(make(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        if r.doc_id in (None, 0):  # ids of several rows
            continue
        w = plain_words(text[r.doc_id])
        starts, base = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        found, best = set(base), 0.0
        for label, t in licenses.TEMPLATES:
            own, n = set(plain_words(t)), math.ceil(len(plain_words(t)) / licenses.THRESHOLD - 1e-9)
            share = max((len(own & set(w[i : i + n])) / len(own) for i in range(len(w))), default=0)
            if share >= licenses.THRESHOLD - 1e-12:
                found.add(label)
                best = max(best, share)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(found))), text[r.doc_id]
        assert abs(r.score - best) < 1e-9
        for s in r.spans:
            assert any(label == s.label and len(set(plain_words(t)) & set(w[s.start : s.start + s.length])) / len(set(plain_words(t))) >= licenses.THRESHOLD - 1e-12 for label, t in licenses.TEMPLATES)
    assert licenses.scan(make(spark, [])).count() == 0


def test_positional_filter():
    counts = Counter({"released": 1, "mit": 2, "under": 5, "license": 9, "the": 99})
    index = licenses.Index([("mit", "Released under the MIT License"), ("other", "zeta the under")], counts, 0.8)
    text = b"was released by them all under the sun of the one mit license here it goes on and on released under the mit license"
    words = plain_words(text.decode())
    spans = index.spans([w.encode() for w in words], text)
    assert [(s["label"], s["start"], s["containment"]) for s in spans] == [("mit", 19, 1.0)]
    assert index.rejected > 0 and index.passed > 0
    kept = index.rejected
    index.reaches = lambda k, at, words: True  # nothing is lost by it
    assert index.spans([w.encode() for w in words], text) == spans and index.rejected == kept


def test_many_notices_take_linear_time():
    text = " ".join(f"w{k} Released under the MIT License" for k in range(20_000)).encode()
    index = licenses.Index(licenses.TEMPLATES, {}, 0.8)
    started = time.process_time()
    words = licenses.words_of(text)
    assert len(index.spans(words, text)) == 20_000
    starts, _ = licenses.phrase_places(words, b" %b " % b" ".join(words), [(b"mit license", "mit")])
    assert len(starts) == 20_000 and time.process_time() - started < 8


def test_licences_in_long_sentences(spark):
    long = "This work is licensed, unless otherwise noted in the file headers, under the GNU General Public License, version 3"
    apart = "This work is licensed. It was made under the GNU rules. A General idea. Public License, version 3"
    rows = [(0, f"Before it. {long}. After it.", None), (1, long.replace(" file ", "\n"), None), (2, long.replace(" file ", "\n\n"), None), (3, apart, None)]
    got = {r.doc_id: r for r in licenses.scan(make(spark, rows)).collect()}
    assert [got[k].labels for k in range(4)] == ["gpl,gpl-3.0", "gpl,gpl-3.0", "gpl", ""]
    (s,) = got[0].spans
    assert (s.label, s.start, s.length, s.containment, got[0].score) == ("gpl-3.0", 2, 19, 1.0, 1.0)


PAGES = "page_id long, url string, html string, text string"


def test_archives(spark, tmp_path):
    g = random.Random(2)
    pages = [(k, f"http://a/{k}", g.choice(["<p>one</p>", "<p>zwei é</p>", "", None, "x" * 50_000, f"<p>{k}</p>"]), "c") for k in range(80)]
    pages += [(80, None, "<p>one</p>", "c"), (81, "http://a\r\nX: y", "odd url", "c"), (None, "u", "<p>one</p>", "c"), (3, "again", pages[3][2], "c")]
    df = spark.createDataFrame(pages, PAGES).repartition(4)
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_records(index).collect()
    data = lambda h: (h or "").encode()
    first = {}
    for p, _, h, _ in pages:
        if p is not None:
            first[data(h)] = min(first.get(data(h), p), p)
    want = Counter()
    for p, _, h, _ in pages:
        d, f = data(h), first.get(data(h))
        want[p, len(d), b32encode(hashlib.sha1(d).digest()).decode(), "response" if p == f else "revisit", None if p == f else f] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    some = warc.read_records(index.filter("page_id % 7 = 3")).collect()
    assert Counter(r.page_id for r in some) == Counter(p for p, *_ in pages if p is not None and p % 7 == 3)
    import gzip

    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w/archives").iterdir())
    assert whole.count(b"WARC/1.1\r\n") == len(pages)
    big = {r.record_type for r in warc.round_trip(df, min_bytes=10**6).collect()}
    assert big == {"response"} and warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_noticed():
    import gzip

    rec = warc.record(1, "u", b"payload", warc.digest(b"other"), None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(gzip.compress(rec))


def test_messages_give_exact_marginals():
    g = random.Random(8)
    model = html_extract.Model()
    nodes = [html_extract.Node("html", (), -1)] + [html_extract.Node(g.choice(["p", "div", "#"]), (), g.randrange(k)) for k in range(1, 9)]
    for x in nodes:
        x.text = "t"
        for f in html_extract.features(x, nodes[x.parent] if x.parent >= 0 else None):
            model.own.setdefault(f, g.uniform(-1, 1))
    model.edge = {(k, p, c): g.uniform(-1, 1) for k in (False, True) for p in (0, 1) for c in (0, 1)}
    weight = {}
    for bits in range(1 << len(nodes)):
        y = [bits >> i & 1 for i in range(len(nodes))]
        s = 0.0
        for i, x in enumerate(nodes):
            up = nodes[x.parent] if x.parent >= 0 else None
            s += y[i] * sum(model.own[f] for f in html_extract.features(x, up))
            s += model.edge[x.tag == "#", y[x.parent], y[i]] if up else 0
        weight[bits] = math.exp(s)
    total = sum(weight.values())
    p, joint = model.marginals(nodes)
    for i, x in enumerate(nodes):
        assert abs(p[i] - sum(w for b, w in weight.items() if b >> i & 1) / total) < 1e-9
        if i:
            assert abs(joint[i][3] - sum(w for b, w in weight.items() if b >> i & 1 and b >> x.parent & 1) / total) < 1e-9


def test_main_text(spark):
    g = random.Random(6)
    say = lambda n: " ".join("".join(g.choice("abcdeimnorst") for _ in range(g.randint(2, 9))) for _ in range(n)).capitalize() + "."
    pages, want = [], {}
    for k in range(60):
        head, paras = say(6), [say(g.randint(5, 80)) for _ in range(g.randint(1, 6))]
        body = f"<h1>{head}</h1>" + "".join(f"<p>{x.replace(' ', g.choice([' ', chr(10)]), 1)} &amp; &eacute;</p>" for x in paras)
        pages.append((k, f"u{k}", f"<html><head><title>{say(3)}</title><script>if (1<2) '<p>'</script></head><body><nav><ul><li><a href=/>{say(1)}</a><li><a>{say(2)}</a></ul></nav><div class='ad'>{say(7)}</div><article>{body}</article><aside class=sidebar><p>{say(12)}</p></aside><footer>&copy; {say(5)}</footer>", "c"))
        want[k] = "\n".join([head, *(f"{x} & é" for x in paras)])
    odd = [(100, "u", None, "c"), (101, None, "", "c"), (102, "u", "<<<>>> & <p", "c"), (103, "u", "</div></p>" * 50 + "<div>" * 3000, "c"), (None, "u", "<script>", "c")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(pages + odd, PAGES)).collect()}
    assert len(got) == 65 and sum(got[k].text == want[k] for k in want) >= 57
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[100].text == got[101].text == ""
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


#: Pages whose layouts, classes and ids are in no layout of the training.
OTHER_LAYOUTS = [
    "<header><a href=/>W</a></header><main class=k1><h1>[[W]]</h1><p>[[S]]</p><p>[[S]]</p><noscript><p>[[S]]</p></noscript></main><aside>S</aside><footer>S</footer>",
    "<nav><ol><li><a>W</a><li><a>W</a></ol></nav><div class=k2><article class=k3><p>[[S]]<p>[[W]]<p>[[S]]</article></div><footer><p>&copy; W</p></footer>",
    "<aside><p>S</p></aside><article><header><h2>[[W]]</h2></header><section><p>[[S]]</p><ul><li>[[S]]<li>[[W]]</ul></section></article><form><p>S</p></form>",
    "<nav>W</nav><article><h1>[[W]]</h1><p>[[S]]</p><svg><text>[[W]]</text></svg><math><mi>[[W]]</mi></math></article><footer><nav><a>W</a><a>W</a></nav></footer>",
]


def test_main_text_of_other_layouts():
    g, good, total = random.Random(12), 0, 0
    say = lambda n: " ".join("".join(g.choice("abcdeimnorst") for _ in range(g.randint(2, 9))) for _ in range(n))
    model = html_extract.Model().fit(html_extract.labelled_pages([say(400)]))
    for _ in range(25):
        for layout in OTHER_LAYOUTS:
            page = re.sub(r"(?<=[\[> ])[WS](?=[\] <])", lambda m: say(1) if m[0] == "W" else say(g.randint(8, 60)).capitalize() + ".", layout)
            want = {x for w in re.findall(r"\[\[(.*?)\]\]", page) for x in [w.strip()]}
            got = set(filter(None, model.text(page.replace("[[", "").replace("]]", "")).split("\n")))
            good, total = good + len(want & got), total + len(want | got)
    assert good / total > 0.9, good / total


@pytest.mark.parametrize("unit", ["<a ", "</a ", "<! ", '<a ">"', "<div>", "</x>", "<p><b>", "<script></script ", "<li><div><b>", "<", '<a class="', "<a '\">' \""])
def test_a_page_takes_linear_time(unit):
    page = unit * ((1 << 20) // len(unit))
    started = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - started < 6  # hours, were it quadratic


def test_parser_keeps_all_text():
    g = random.Random(2)
    for _ in range(200):
        page = "".join(g.choice(["<p>", "</p>", "<b>", "</b>", "<div class=x>", "</div>", "<a href='>'>", "</a>", "<br>", "<li>", "<td>", "<!-- no -->", "word ", "&lt;x&gt; ", "<script>no</script>", "<ul>", "</ul>"]) for _ in range(40))
        seen = Counter(w for x in html_extract.parse(page) if x.tag == "#" for w in re.findall(r"word|<x>|no", x.text))
        assert seen["word"] == page.count("word") and seen["<x>"] == page.count(html.escape("<x>")) and not seen["no"]


def test_scores(spark):
    rows = [*some_docs(300, 11), *ODD]
    got = lm_score.score(make(spark, rows)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = lambda t: (t or "").encode().translate(lm_score.TABLE).split()
    c, end = Counter(), object()
    for i, t, _ in rows:
        if not held(i):
            c.update([*toks(t), end])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        w = [*toks(t), end]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in got)
    assert lm_score.score(make(spark, [])).count() == 0


def plain_mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> shift
        x = x * by % 2**64
    return x ^ (x >> 31)


def plain_id(word):
    assert len(word) < 16
    lo, hi = (int.from_bytes(word.ljust(16, b"\0")[i : i + 8], "little") for i in (0, 8))
    return plain_mix(lo ^ plain_mix((hi | len(word) << 56) + 0x452821E638D01377 & 2**64 - 1))


def plain_row(*parts):
    h = 0x9E3779B97F4A7C15
    for p in parts:
        h = (h ^ p) * 0xBF58476D1CE4E5B9 % 2**64
        h ^= h >> 29
    return h % lm_score.ROWS


def plain_softmax(z):
    e = [math.exp(v) for v in z]
    return [v / sum(e) for v in e]


def test_model_score_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 20)  # few words are sent, most are asked for
    g = random.Random(4)
    vocabulary = ["".join(g.choice("abcde") for _ in range(g.randint(1, 6))) for _ in range(900)]
    rows = [(k, " ".join(g.choice(vocabulary[: 900 if g.random() < 0.5 else 20]) for _ in range(g.randint(0, 40))), "x") for k in range(300)]
    rows += [(301, None, "x"), (302, " A\tb\x0b", "x"), (None, "abc", "x"), (303, "unseen1 unseen2 " * 30, "x")]
    docs = make(spark, rows).select("doc_id", lm_score.held_out().alias("held_out"), "text")
    train = docs.filter("not held_out")
    counts = lm_score.word_counts(train)
    scorer = lm_score.learn(train, counts, rounds=2)
    m = scorer.model
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = lambda t: (t or "").lower().encode().split()
    c = Counter(w for i, t, _ in rows if not held(i) for w in toks(t))
    ends = sum(not held(i) for i, _, _ in rows)
    n, once = sum(c.values()) + ends, sum(v == 1 for v in c.values())
    new = (once + 1) / (n + 2)
    cell = lambda x: int(m.cells(np.array([x], np.uint64))[0])
    x_of = {w: plain_id(w) for _, t, _ in rows for w in toks(t)}
    in_cell = Counter()
    for w, k in c.items():
        in_cell[cell(x_of[w])] += k
    assert np.abs(m.a).max() > 0.1 and len(in_cell) > 30
    end, start = int(lm_score.END), int(lm_score.BEFORE)
    want = {}
    for i, t, _ in rows:
        past, total = [start] * 3, 0.0
        for w in [*toks(t), None]:
            x = end if w is None else x_of[w]
            p1, p2, p3 = past[::-1][:3]
            cls, sub = divmod(cell(x), lm_score.CELLS)
            a = m.class_bias.astype(float) + sum(m.a[r].astype(float) for r in (plain_row(1, p1), plain_row(2, p1, p2), plain_row(3, p2), plain_row(4, p3)))
            y = m.cell_bias[cls].astype(float) + m.w[plain_row(5, p1, cls)]
            p = plain_softmax(a)[cls] * plain_softmax(y)[sub] * (1 - new)
            if w is not None:
                p = new if not c[w] else p if cls < lm_score.OWN else p * c[w] / in_cell[cell(x)]
            total += math.log10(p)
            past = [*past, x][-3:]
        want[i] = total
    got = lm_score.apply(docs, scorer, counts).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-3 * max(1, r.n_tokens), (r, want[r.doc_id])
    # over all words of all cells, the unknown one and the end, the chances after any words add up to one
    shares = Counter()
    for w, k in c.items():
        q = cell(x_of[w])
        shares[q] += 1 if q < lm_score.OWN * lm_score.CELLS else k / in_cell[q]
    assert all(abs(v - 1) < 1e-9 for v in shares.values())


def test_parts_of_a_long_text(monkeypatch):
    """A text in parts has the tokens, and the words before each, that it has as a whole."""
    g = random.Random(6)
    for _ in range(60):
        text = "".join(g.choice("ab \n") * g.choice([1, 1, 1, 30]) for _ in range(g.randint(0, 60))).encode()
        (whole,) = lm_score._parts([text])
        _, _, _, x, p, _, _ = lm_score.sequence(whole, lm_score.NONE, 0)
        monkeypatch.setattr(lm_score, "BATCH_BYTES", 10)
        last, begun, parts = lm_score.NONE, 0, []
        for part in lm_score._parts([text]):
            *_, y, q, last, begun = lm_score.sequence(part, last, begun)
            parts.append((y, *q))
        monkeypatch.undo()
        assert len(text) <= 20 or len(parts) > 1 or b" " not in text.translate(lm_score.TABLE).strip()
        for a, b in zip((x, *p), zip(*parts)):
            assert a.tolist() == np.concatenate(b).tolist()
    assert list(lm_score._groups([2, 9 << 20, 0, 1])) == [(0, 1), (1, 2), (2, 4)]


def test_words_are_told_apart():
    g = random.Random(5)
    some = ["".join(g.choice("abé") for _ in range(g.randint(1, 40))) for _ in range(3000)] + ["a" * n for n in range(1, 80)]
    text = "\n ".join(x.title() for x in some).encode()
    start, lo, hi = lm_score.words(text)
    want = text.translate(lm_score.TABLE).split()
    assert len(start) == len(want)
    by = {}
    for w, key in zip(want, zip(lo.tolist(), hi.tolist())):
        assert by.setdefault(key, w) == w
    assert len(by) == len(set(want))
    w = lm_score.Words(lo, hi)
    assert len(w.x) == len(by) and (w.lo[w.of] == lo).all() and (w.hi[w.of] == hi).all()
    assert (lm_score.found(w.x, w.lo, w.hi, (w.x, w.lo, w.hi)) == np.arange(len(w.x))).all()


def test_found_tells_words_with_equal_numbers_apart():
    x, lo = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    hi = np.zeros(4, np.uint64)
    assert lm_score.found(np.array([5, 5, 5, 7, 9], np.uint64), np.array([3, 1, 4, 1, 1], np.uint64), np.zeros(5, np.uint64), (x, lo, hi)).tolist() == [2, 0, -1, -1, 3]


def test_gradient_is_the_slope():
    g = np.random.default_rng(2)
    m = lm_score.Model(g.integers(1, 1 << 60, 600).astype(np.uint64))
    m.count(g.integers(1, 100, lm_score.CLASSES * lm_score.CELLS))
    x = np.r_[m.own[g.integers(0, 512, 150)], g.integers(1, 1 << 60, 50).astype(np.uint64)]
    p, cell = lm_score.before(x, np.arange(200) % 90, lm_score.NONE), m.cells(x)
    ga, gw = np.zeros_like(m.a), np.zeros_like(m.w)
    m.gradient(p, cell, ga, gw)
    for weights, grad in ((m.a, ga), (m.w, gw)):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = m.score(p, cell).sum(dtype=float)
        weights[at] += 0.01
        slope = (m.score(p, cell).sum(dtype=float) - old) / 0.01
        assert abs(slope - grad[at]) < 0.05 * abs(grad[at]) + 0.05
        weights[at] -= 0.01
