"""Benchmark decontamination by SimHash windows of the items' sizes.

A document's windows of an item's number of words are fingerprinted with a 256-bit SimHash of their five-word
shingles. Fingerprints are looked up in a multi-index of the items' fingerprints: they are cut into blocks of 16 bits,
each block has a radius, and the radii are such that a fingerprint within the whole radius must be within them in
several blocks. So no fingerprint within the radius is missed, and few others are candidates. The weighted shingle
similarity of those within the radius is then computed exactly.

A window needs as many shingles that items of its size hold as the threshold asks to be shared; others can't match
any of these items and aren't fingerprinted.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, marked, slices, text_bytes, without
from .shingles import counted, mix, shingle_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Bits of a fingerprint, and of each block.
BITS, WIDTH = 256, 16
#: Share of unlike fingerprints that may be candidates, and blocks that may be asked for to get there.
CANDIDATES, MOST_BLOCKS = 0.03, 6
#: Benchmarks are sent to the workers in parts of at most so many bytes of text.
ITEMS_BYTES = 16 << 20
#: Starts of windows that are fingerprinted together.
STARTS = 4096
RESULT = "doc_id long, item_id long, start_word long, n_words long, similarity double, hamming int"
_SALTS = np.random.default_rng(6).integers(1, 1 << 63, BITS // 64, dtype=np.uint64)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each start on (in order), each shingle weighted by its count: a row of 64-bit words."""
    lo = int(starts[0])
    cuts = np.unique(np.r_[starts, starts + n]) - lo
    a, b = np.searchsorted(cuts, starts - lo), np.searchsorted(cuts, starts - lo + n)
    out = np.empty((len(starts), BITS // 64), np.uint64)
    for k, salt in enumerate(_SALTS):
        bits = np.unpackbits(mix(shingles[lo : lo + cuts[-1]] ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(cuts), 64), np.int32)
        np.cumsum(np.add.reduceat(bits, cuts[:-1], axis=0, dtype=np.int32), axis=0, out=sums[1:])
        out[:, k] = np.packbits(2 * (sums[b] - sums[a]) > n, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def radius_of(threshold: float) -> int:
    """Bits in which a pair at the threshold differs: as many as follow from its cosine on average, and 4.3 deviations.

    At a similarity of 0.8 that is 39 of 256 with a deviation of 6, so 63.
    """
    share = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return min(BITS, round(BITS * share + 4.3 * math.sqrt(BITS * share * (1 - share))))


def block_radii(radius: int, blocks: int = BITS // WIDTH) -> tuple[list[int], int, float]:
    """(radius of each block, blocks that must be within theirs, share of unlike fingerprints for which that holds).

    If under k blocks are within their radii t, the others differ in over t bits each; so k blocks must be if the sum
    of t + 1 over all but the k - 1 largest is beyond the whole radius. The least k is taken whose share is small.
    """
    best = None
    for k in range(1, MOST_BLOCKS + 1):
        t = -(-(radius + 1) // (blocks - k + 1)) - 1
        spare = (blocks - k + 1) * (t + 1) - (radius + 1)
        lower = min(spare, blocks - k + 1) if t > 0 else 0
        radii = [min(t, WIDTH)] * (blocks - lower) + [min(t - 1, WIDTH)] * lower
        passing = np.zeros(blocks + 1)
        passing[0] = 1.0
        for r in radii:
            p = sum(math.comb(WIDTH, i) for i in range(r + 1)) / 2**WIDTH
            passing = passing * (1 - p) + np.r_[0, passing[:-1]] * p
        share = float(passing[k:].sum())
        if best is None or share < best[2]:
            best = radii, k, share
        if share <= CANDIDATES:
            break
    return best


class MultiIndex:
    """Fingerprints by their blocks; a lookup walks the ball around each block of the one that is asked for."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.radii, self.needed, _ = block_radii(radius)
        values = self._blocks(prints)
        self.order = [np.argsort(v, kind="stable").astype(np.int32) for v in values]
        self.sorted = [v[o].astype(np.uint16) for v, o in zip(values, self.order)]
        #: A bit for each value of a block, set if a print has it.
        self.there = [np.packbits(np.bincount(v, minlength=1 << WIDTH) > 0, bitorder="little") for v in values]

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), -1).T.astype(np.int64)

    def candidates(self, values: np.ndarray) -> np.ndarray:
        """Numbers of the indexed prints that are near enough in enough blocks; values: the blocks of one print."""
        found = []
        for v, t, order, own, there in zip(values.tolist(), self.radii, self.order, self.sorted, self.there):
            keys = v ^ ball(t)
            keys = keys[there[keys >> 3] >> (keys & 7) & 1 == 1].astype(np.uint16)
            lo = np.searchsorted(own, keys)
            n = np.searchsorted(own, keys, "right") - lo
            found.append(order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
        hits = np.sort(np.concatenate(found))
        return np.unique(hits[self.needed - 1 :][hits[self.needed - 1 :] == hits[: len(hits) - self.needed + 1]])

    def within(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(number of the print, number of the indexed print, Hamming distance) of all within the radius."""
        out = []
        for q, (values, own) in enumerate(zip(self._blocks(prints).T, prints)):
            some = self.candidates(values)
            d = np.bitwise_count(self.prints[some] ^ own).sum(1, dtype=np.int64)
            out += [(q, i, x) for i, x in zip(some.tolist(), d.tolist()) if x <= self.radius]
        return out


_balls: dict[int, np.ndarray] = {}


def ball(radius: int) -> np.ndarray:
    """All values of WIDTH bits with at most radius bits set."""
    if radius not in _balls:
        _balls[radius] = np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(WIDTH), k)], np.int64)
    return _balls[radius]


class Benchmark:
    """Items of one part of a benchmark, ready to look windows up."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD):
        hashes = [h for _, some in word_hashes([t for _, t in items]) for h in some]
        kept = [(i, h) for (i, _), h in zip(items, hashes) if len(h)]
        self.ids, self.sizes = [i for i, _ in kept], [len(h) for _, h in kept]
        shingles = [shingle_hashes(h, SHINGLE) for _, h in kept]
        self.sets = [dict(zip(*(x.tolist() for x in counted(s)))) for s in shingles]
        self.totals = [len(s) for s in shingles]
        by_size: dict[int, list[int]] = {}
        for k, n in enumerate(self.sizes):
            by_size.setdefault(n, []).append(k)
        self.index = {}
        for n, ks in by_size.items():
            prints = np.concatenate([fingerprints(shingles[k], np.array([0]), len(shingles[k])) for k in ks])
            self.index[n] = (ks, MultiIndex(prints, radius_of(threshold)))
        pairs = np.zeros((0, 2), np.uint64)
        for n, ks in by_size.items():
            own = np.unique(np.concatenate([shingles[k] for k in ks]))
            pairs = np.concatenate([pairs, np.stack([own, np.full(len(own), n, np.uint64)], 1)])
        order = np.argsort(pairs[:, 0], kind="stable")
        #: Each shingle with each size of the items that hold it.
        self.shingles, self.owner_size = pairs[order, 0], pairs[order, 1].astype(np.int64)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.shingles >> np.uint64(48)).astype(np.int64)] = True
        self.short = sorted(n for n in by_size if n < SHINGLE)

    def seeds(self, shingles: np.ndarray) -> dict[int, np.ndarray]:
        """By size of window, the places whose shingle an item of that size holds."""
        at = np.flatnonzero(self.coarse[(shingles >> np.uint64(48)).astype(np.int64)])
        if not len(at):
            return {}
        lo, hi = (np.searchsorted(self.shingles, shingles[at], side) for side in ("left", "right"))
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            return {}
        places = np.repeat(at, n)
        sizes = self.owner_size[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        order = np.argsort(sizes, kind="stable")
        sizes, places = sizes[order], places[order]
        cut = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]])
        return dict(zip(sizes[cut].tolist(), np.split(places, cut[1:])))

    def matches(self, words: np.ndarray, threshold: float) -> list[tuple]:
        """(item_id, start, words, similarity, distance) of the best window of each item at or above the threshold."""
        best: dict[int, tuple] = {}
        by_width: dict[int, np.ndarray] = {}
        for size in [*self.short, None]:  # items too short for a shingle of five words are one shingle of their size
            width = size or SHINGLE
            if len(words) >= (size or 1):
                by_width[width] = shingle_hashes(words, width)
        for width, shingles in by_width.items():
            for n, places in self.seeds(shingles).items():
                if (n < SHINGLE or width < SHINGLE) and n != width and len(words) >= SHINGLE:
                    continue
                take = min(n, len(words))
                m = max(1, take - SHINGLE + 1) if width == SHINGLE else 1
                starts = self._starts(places, len(shingles), m, max(1, n - SHINGLE + 1), threshold)
                for i in range(0, len(starts), STARTS):
                    self._look(shingles, starts[i : i + STARTS], m, take, n, threshold, best)
        return [(self.ids[k], *v) for k, v in sorted(best.items())]

    @staticmethod
    def _starts(places: np.ndarray, n_shingles: int, m: int, total: int, threshold: float) -> np.ndarray:
        """Starts of windows of m shingles with enough of the places for a similarity of threshold to an item of total shingles."""
        least = max(1, math.ceil(threshold * (m + total) / (1 + threshold) - 1e-9))
        if len(places) < least:
            return np.zeros(0, np.int64)
        # The window's first place is places[i], and it has least places or more: it ends at or after places[i + least - 1].
        first, last = places[: len(places) - least + 1], places[least - 1 :]
        before = np.r_[-1, places[: len(first) - 1]]
        lo, hi = np.maximum(before + 1, last - m + 1), np.minimum(first, n_shingles - m)
        on = np.flatnonzero(lo <= hi)
        size = (hi - lo + 1)[on]
        return np.repeat(lo[on] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(on) else np.zeros(0, np.int64)

    def _look(self, shingles, starts, m, take, n, threshold, best) -> None:
        ks, index = self.index[n]
        for q, i, d in index.within(fingerprints(shingles, starts, m)):
            k, at = ks[i], int(starts[q])
            own, left, both = self.sets[k], {}, 0
            for s in shingles[at : at + m].tolist():
                if s in own and left.setdefault(s, own[s]) > 0:
                    left[s] -= 1
                    both += 1
            like = both / (self.totals[k] + m - both)
            if like >= threshold and (k not in best or (-like, at) < (-best[k][2], best[k][0])):
                best[k] = (at, take, like, d)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Places of documents that repeat a benchmark item.

    docs: doc_id, text; benchmark: item_id, text (other columns are ignored). Returns a row for each document
    and item with a window as long as the item whose weighted Jaccard similarity of five-word shingles is at
    least threshold: RESULT, with the most similar window, the first of those. A document shorter than the
    item is one window. Null texts and texts without a word match nothing; documents without a match give no
    row; repeated rows give their matches each. A null id is kept. The benchmark goes to the workers in parts
    of bounded size, one scan of docs for each.
    """
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // ITEMS_BYTES))
    out = None
    for part in range(parts):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        rows = [(r.item_id, r.text.encode()) for r in some.collect()]  # a part is bounded by ITEMS_BYTES
        got = docs.select("doc_id", "text").mapInArrow(freeing(_scan(sorted(rows, key=lambda r: (r[0] is None, r)), threshold)), RESULT)
        out = got if out is None else out.unionByName(got)
    return out


def _scan(items: list[tuple[int, bytes]], threshold: float):
    def run(batches):
        bench = Benchmark(items, threshold)
        for b in (part for b in batches for part in slices(b, 1)):
            ids, out = b.column(0).to_pylist(), []
            for at, docs in word_hashes(text_bytes(b.column(1))):
                for i, words in enumerate(docs, at):
                    if len(words):
                        out += [(ids[i], *m) for m in bench.matches(words, threshold)]
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.int32()]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that repeat a benchmark item.

    A document is all rows of a doc_id: they go together. Rows with a null doc_id stay; clean_rows judges rows.
    """
    return without(docs, matches(docs, benchmark, threshold).select("doc_id"), "doc_id", "leaks")


def clean_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that repeat a benchmark item.

    Unlike in clean, rows are dropped by a mark of their own: one with a null doc_id goes if it leaks, one that
    shares its doc_id with a leak stays if it doesn't.
    """
    rows, mark = marked(docs)
    gone = matches(rows.select(F.col(mark).alias("doc_id"), "text"), benchmark, threshold).select(F.col("doc_id").alias(mark))
    return without(rows, gone, mark, "leaks").select(docs.columns)
