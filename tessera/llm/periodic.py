"""Periodic runs of words, found by recompression.

A run of period q and at least max(12, 2q) words has at least max(12 - q, q) consecutive places whose word comes
again q words later. So a grid of that step, for each period, has a place in every run: places of the grids whose word
comes again are candidates, n log n of them in n words. Extensions on the grammar to both sides then give the whole
run. Nothing is sorted by suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import crc_of, slices, text_bytes
from .recompression import Grammar

LEAST = 12
#: Words of texts that share a grammar (a longer text has its own), and candidates that are extended at once.
WORDS, CANDIDATES = 1 << 18, 1 << 17
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def run_table(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """(start, length, period) of all runs of each sequence of numbers, by start and period."""
    order = sorted((k for k, s in enumerate(sequences) if len(s) >= LEAST), key=lambda k: -len(sequences[k]))
    out = [np.zeros((0, 3), np.int64)] * len(sequences)
    if not order:
        return out
    sizes = np.array([len(sequences[k]) for k in order])
    ends = np.r_[0, np.cumsum(sizes + 1)]  # an end mark before and after each sequence
    flat = np.zeros(ends[-1] + 1, np.int64)
    for k, at in zip(order, ends):
        flat[at + 1 : at + 1 + len(sequences[k])] = sequences[k]
    grammar = Grammar(flat, ends)
    found = _found(grammar, flat, sizes, ends)
    at = np.searchsorted(ends, found[:, 0]) - 1
    found[:, 0] -= ends[at] + 1
    cut = np.searchsorted(at, np.arange(len(order) + 1))
    for n, k in enumerate(order):
        out[k] = found[cut[n] : cut[n + 1]]
    return out


def _found(grammar: Grammar, flat: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(place, length, period) of all runs, by place and period. Sequences are in order of falling size."""
    word = grammar.levels[0].symbols
    period, until = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)  # of a known run over each place
    runs: list[np.ndarray] = []
    waiting, n_waiting = [], 0

    def extend() -> None:
        nonlocal waiting, n_waiting
        i, q = (np.concatenate(c) for c in zip(*waiting))
        waiting, n_waiting = [], 0
        known = (period[i] > 0) & (q % np.maximum(period[i], 1) == 0) & (until[i] > i + q)
        i, q = i[~known], q[~known]
        for a in range(0, len(i), CANDIDATES):
            x, p = i[a : a + CANDIDATES], q[a : a + CANDIDATES]
            back = grammar.backward(x, x + p)
            size = back + grammar.forward(x, x + p) + p
            on = size >= np.maximum(LEAST, 2 * p)
            new = np.unique(np.stack([x[on] - back[on], size[on], p[on]], 1).astype(np.int64), axis=0)
            new = new[np.r_[True, (new[1:, :2] != new[:-1, :2]).any(1)]] if len(new) else new  # multiples of the smallest period
            runs.append(new)
            for s, n, r in new.tolist():
                if n >= 4 * r:
                    some = slice(s, s + n)
                    less = (period[some] == 0) | (r < period[some])
                    period[some] = np.where(less, r, period[some])
                    until[some] = np.where(less, s + n, until[some])

    for q in range(1, int(sizes[0]) // 2 + 1):
        within = int(np.searchsorted(-sizes, -max(LEAST, 2 * q), "right"))  # sequences long enough
        top = int(ends[within])
        places = np.arange(1, top - q, max(q, LEAST - q))
        places = places[word[places] == word[places + q]]
        if len(places) and q > 1:  # no end mark between both
            places = places[np.searchsorted(ends, places) == np.searchsorted(ends, places + q)]
        if len(places):
            waiting.append((places, np.full(len(places), q)))
            n_waiting += len(places)
        if n_waiting and (n_waiting >= CANDIDATES or q in (1, 2, 4, 8, 16, 32)):
            extend()
    if n_waiting:
        extend()
    all_ = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    all_ = np.unique(all_, axis=0)  # by place, length and period: of equal stretches the smallest period is first
    all_ = all_[np.r_[True, (all_[1:, :2] != all_[:-1, :2]).any(1)]] if len(all_) else all_
    return all_[np.lexsort((all_[:, 2], all_[:, 0]))]


def numbers(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, equal for equal words of all texts."""
    known: dict[bytes, int] = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in texts]


def planted(doc_id, n: int) -> np.ndarray:
    """The places whose words stand in a text's n places: in one text of ten, from a place on, a stretch repeats."""
    h, at = crc_of(doc_id), np.arange(n)
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at >= a, a + (at - a) % p, at)


def _row(words: list[bytes], runs: np.ndarray) -> tuple:
    listed = runs.tolist()
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(gone[:-1]) == 0
    rest = words if kept.all() else [words[k] for k in np.flatnonzero(kept).tolist()]
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
    best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(listed), *top, digest, hashlib.sha256(b" ".join(rest)).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in listed]


def _groups(lists: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Texts from one number to another, with about WORDS words together."""
    at, size = 0, 0
    for k, words in enumerate(lists):
        if k > at and size + len(words) > WORDS:
            yield at, k
            at, size = k, 0
        size += len(words)
    yield at, len(lists)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and RESULT of each row of docs (doc_id, text; other columns are ignored).

    A text's words are what is between white space of ASCII; in one text of ten a repeat is planted by its doc_id (see
    planted). start, length and period are of the longest run, of equally long ones the first, then that of the
    smallest period; null without a run. A null or empty text has no words. A null doc_id counts as the empty text in
    the planting. Repeated rows and ids are rows of their own; an empty table gives no rows. Texts are taken together up to
    WORDS words; a longer text is a grammar of its own, with some 150 bytes of memory a word.
    """

    def run(batches):
        for b in (part for batch in batches for part in slices(batch, 1)):
            ids, lists = b.column(0).to_pylist(), [t.split() for t in text_bytes(b.column(1))]
            for x, y in _groups(lists):
                places = [planted(i, len(words)) for i, words in zip(ids[x:y], lists[x:y])]
                found = run_table([w[p] for w, p in zip(numbers(lists[x:y]), places)])
                words = [[own[k] for k in p.tolist()] if i % 10 == 0 else own for i, own, p in zip(map(crc_of, ids[x:y]), lists[x:y], places)]
                columns = list(zip(*map(_row, words, found))) if y > x else [()] * 8
                run_kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [run_kind]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), *map(pa.array, columns, kinds)], ["doc_id", *(c.split(" ")[0] for c in RESULT.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")
