"""License scan: an exact set-similarity join of licence templates with the text blocks of every document.

A template is its set of words. A block matches if it holds at least threshold of the template's words. Blocks
are the runs of words of a document, across sentences, of at most the template's length / threshold, and for a
template that no such run matches the document's sentences, however long. Words are ordered by their count over
the whole corpus, rarest first; a block that matches must hold one of the template's first words in that order
(prefix filter), so only the places around such words are looked at, and all of those. Length filter: a run is
no longer than the template allows. Positional filter: of the template's words at most those can match that come
before the hit in the order and stand nearby, the hit, and as many as come after it in both the template and the
words nearby; a place where these are too few is passed over.
"""

from __future__ import annotations

import bisect
import re
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, words_of

THRESHOLD = 0.8
#: Labels and wording of notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: Phrases and labels of the base.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, spans array<struct<label:string,start:long,length:long,containment:double>>"
)


#: Between sentences: an end mark and white space before anything but a digit, or a blank line.
SENTENCE_END = re.compile(rb"[.!?]['\")\]]*\s+(?![\s0-9])|\n\s*\n")


def tightest(words: list[bytes], own: frozenset) -> tuple[int, int]:
    """(start, length) of the first shortest run that holds all words of own that words holds."""
    at = [i for i, w in enumerate(words) if w in own]
    missing, held, first, best = len({words[i] for i in at}), {}, 0, (len(words) + 1, 0)
    for i in at:
        held[words[i]] = held.get(words[i], 0) + 1
        while len(held) == missing:
            a = at[first]
            best = min(best, (i - a + 1, a))
            held[words[a]] -= 1
            if not held[words[a]]:
                del held[words[a]]
            first += 1
    return best[1], best[0]


class Index:
    """Templates by the words of their prefixes, in the corpus's order of words."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        self.templates, self.prefix, self.threshold = [], {}, threshold
        all_ = {w for _, t in templates for w in words_of(t.encode())}
        self.place = {w: i for i, w in enumerate(sorted(all_, key=lambda w: (counts.get(w, 0), w)))}
        self.passed = self.rejected = 0  # hits that the positional filter lets through, and those that it doesn't
        for label, text in templates:
            order = sorted(set(words_of(text.encode())), key=lambda w: (counts.get(w, 0), w))
            need = ceil(threshold * len(order) - 1e-9)
            length = ceil(len(words_of(text.encode())) / threshold - 1e-9)  # runs have so many words at most
            k = len(self.templates)
            self.templates.append((label, frozenset(order), need, length))
            for w in order[: len(order) - need + 1]:
                self.prefix.setdefault(w, []).append(k)

    def reaches(self, k: int, at: int, words: list[bytes]) -> bool:
        """The positional filter: whether a run around the hit at can hold enough of template k's words."""
        _, own, need, length = self.templates[k]
        hit = self.place[words[at]]
        near = {self.place.get(w, -1): w in own for w in words[max(0, at - length + 1) : at + length]}
        before = sum(mine for x, mine in near.items() if x < hit)
        after = sum(x > hit for x in near)
        left = sum(self.place[w] > hit for w in own)
        ok = before + 1 + min(left, after) >= need
        self.passed, self.rejected = self.passed + ok, self.rejected + (not ok)
        return ok

    def spans(self, words: list[bytes], text: bytes) -> list[dict]:
        """Each template's matching places in text, whose words are given; of places that overlap the fullest, then shortest, then first.

        A template that no run matches has the tightest place in each sentence that matches it.
        """
        places: dict[int, list[int]] = {}
        for w in self.prefix.keys() & set(words):
            at = -1
            for _ in range(words.count(w)):
                at = words.index(w, at + 1)
                for k in self.prefix[w]:
                    hits = places.setdefault(k, [])
                    if self.reaches(k, at, words):
                        hits.append(at)
        out, sentences, seen_all = [], None, set(words) if places else set()
        for k, hits in sorted(places.items()):
            label, own, need, length = self.templates[k]
            found, done = [], -1
            for at in sorted(hits):
                # only words of the template can begin or end a tightest block
                near = [i for i in range(max(0, at - length + 1), min(len(words), at + length)) if words[i] in own]
                for a in (i for i in near if i <= at and i > done):
                    seen, end = set(), a
                    for i in near:
                        if a <= i < a + length and words[i] not in seen:
                            seen.add(words[i])
                            end = i
                    if len(seen) >= need and end >= at:
                        found.append((-len(seen), end - a + 1, a))
                done = at
            kept: list[tuple[int, int]] = []  # starts and ends in order; none overlap
            for neg, n, a in sorted(found):
                i = bisect.bisect_right(kept, (a, a + n))
                if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or a + n <= kept[i][0]):
                    kept.insert(i, (a, a + n))
                    out.append({"label": label, "start": a, "length": n, "containment": -neg / len(own)})
            if not kept and len(own & seen_all) >= need:
                sentences = sentences or [words_of(s) for s in SENTENCE_END.split(text)]
                begin = 0
                for sentence in sentences:
                    both = len(own.intersection(sentence))
                    if both >= need:
                        a, n = tightest(sentence, own)
                        out.append({"label": label, "start": begin + a, "length": n, "containment": both / len(own)})
                    begin += len(sentence)
        return sorted(out, key=lambda s: (s["start"], s["label"], s["length"]))


def word_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Counts over all documents of the templates' words: as many rows as these have words, whatever the corpus."""
    vocabulary = {w for _, t in templates for w in words_of(t.encode())}

    def run(batches):
        for b in batches:
            n: dict[bytes, int] = {}
            for x in text_bytes(b.column(0)):
                for w in filter(vocabulary.__contains__, words_of(x)):
                    n[w] = n.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return {bytes(r.word): r.n for r in docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def phrase_places(words: list[bytes], line: bytes, phrases) -> tuple[list[int], set[str]]:
    """Word positions at which a phrase stands, and labels; line: the words with one space before, between and after."""
    starts, labels = [], set()
    for phrase, label in phrases:
        want, at, was, before = b" %b " % phrase, -1, 0, 0
        while (at := line.find(want, at + 1)) >= 0:
            was, before = at, before + line.count(b" ", was, at)
            starts.append(before)
            labels.add(label)
    return starts, labels


def scan(docs: DataFrame, templates=None, phrases=None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence notices in every document.

    docs: doc_id, text (other columns are ignored). A null text counts as empty and gives a row without
    labels; repeated rows give a row each; an empty table gives none. labels holds the base's labels and
    those of the templates that match; score is the greatest containment (0 without a match); spans has each
    template's matching places, as word positions.
    """
    templates, phrases = templates or TEMPLATES, [(p.encode(), label) for p, label in phrases or PHRASES]
    counts = word_counts(docs, templates)

    def run(batches):
        index = Index(templates, counts, threshold)
        for b in batches:
            rows = []
            for x in text_bytes(b.column(1)):
                words = words_of(x)
                starts, base = phrase_places(words, b" %b " % b" ".join(words), phrases)
                spans = index.spans(words, x)
                rows.append(
                    {
                        "n_words": len(words),
                        "n_base": len(starts),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {s["label"] for s in spans})),
                        "score": max((s["containment"] for s in spans), default=0.0),
                        "spans": spans,
                    }
                )
            span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("containment", pa.float64())])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
