"""Scores of whole texts under a hashed maximum-entropy language model.

A token is predicted in three steps: its class by a softmax over the classes, its cell within the class by a
softmax over the class's cells, and the word within the cell by its share of the cell's count. The most frequent
words have cells of their own; every other word, however rare, has one by its hash. Both softmaxes have weights found by hashing features of the words before: the last one, the last two, and
skips over one and two; features are of any words, so there is no vocabulary that bounds them. Words
that training lacks, which as in the base count as one word, have the share of tokens whose word occurs once
(Good-Turing), and those that it has the rest.

Weights are trained by gradient updates over all training rows: each round takes a part of them, every task sums
its gradients, the sums are added block by block in a shuffle, and the driver takes one step with a table of a
fixed size.

Counts cover the whole corpus and are never in one place. Texts are scored in batches of bounded size: a batch
asks for the count of each of its words once, in the bucket of the word's hash, and gets the counts back. So
what is exchanged grows with the distinct words of batches, and a word that is everywhere loads no bucket. The
counts of at most FREQUENT frequent words are sent to the tasks, which saves most requests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_column, text_bytes, written
from .shingles import mix

#: A-Z lower-cased; space, tab, newline, vertical tab, form feed and return separate tokens.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Words with at least 1 / FREQUENT of all training tokens are frequent.
FREQUENT = 1 << 16
#: Classes of words with cells of their own, of words that share cells, and the end; cells of a class.
OWN, SHARED, CELLS = 16, 15, 32
CLASSES = OWN + SHARED + 1
END_CELL = (CLASSES - 1) * CELLS
#: Rows of hashed weights for classes and for cells, at most 65,536; rows that travel together.
ROWS, BLOCK = 1 << 14, 64
#: Rounds of training, each over a part of the rows; step, and how many tokens a feature needs for a full step.
ROUNDS, RATE, CAUTION, LIMIT = 6, 0.5, 4.0, 8.0
#: Bytes of text that one training task sums gradients over, about; that a batch has; and for one bucket of words.
TASK_BYTES, BATCH_BYTES, BUCKET_BYTES = 256 << 20, 4 << 20, 64 << 20
#: Tokens whose weights are looked up together.
AT_ONCE = 1 << 13
END, BEFORE = np.uint64(0x9D5C0F5B9F1E3D71), np.uint64(0x3C6EF372FE94F82B)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out():
    """Rows that nothing is learned from: crc32(doc_id as text) mod 7 is 2."""
    return crc_column("doc_id") % 7 == 2


# ---- words as numbers

_MASKS = np.array([[255 if j < n else 0 for j in range(16)] for n in range(17)], np.uint8)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the tokens of bytes and two numbers for each, 128 bits, that tell it from all others.

    Up to 15 bytes these are the word itself and its length; for longer ones a hash of 120 bits.
    """
    b = np.frombuffer(data.translate(TABLE) + bytes(16), np.uint8)
    on = np.r_[np.int8(0), ((b != 32) & (np.arange(len(b)) < len(data))).view(np.int8)]
    edge = np.diff(on)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = end - start
    at = np.lib.stride_tricks.sliding_window_view(b, 16)
    head = (at[start] & _MASKS[np.minimum(n, 16)]).view("<u8")
    lo, hi = head[:, 0].copy(), head[:, 1] | (n.astype(np.uint64) << np.uint64(56))
    long_ = np.flatnonzero(n > 15)
    if len(long_):
        tail = at[end[long_] - 16].view("<u8")
        parts = [head[long_, 0], head[long_, 1], tail[:, 0], tail[:, 1]]
        for out, h in ((lo, np.uint64(0x243F6A8885A308D3)), (hi, np.uint64(0x13198A2E03707344))):
            h = mix(n[long_].astype(np.uint64) + h)
            for p in parts:
                h = mix((h ^ p) + np.uint64(0xA4093822299F31D0))
            out[long_] = h
        for i in np.flatnonzero(n > 32).tolist():
            digest = hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=16).digest()
            lo[i], hi[i] = np.frombuffer(digest, "<u8")
        hi[long_] |= np.uint64(255 << 56)
    return start, lo, hi


def ids_of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64 well-spread bits of a word: for features, cells and buckets."""
    return mix(lo ^ mix(hi + np.uint64(0x452821E638D01377)))


class Words:
    """The distinct words of some tokens: x, lo, hi; of: each token's word."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        x = ids_of(lo, hi)
        order = np.argsort(x)
        s, a, z = x[order], lo[order], hi[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])] if len(s) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.x, self.lo, self.hi = s[at], a[at], z[at]
        self.of = np.empty(len(x), np.int64)
        self.of[order] = np.cumsum(new) - 1


def found(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Places of words in known words (x, lo, hi, sorted by x), -1 where there is none."""
    kx, klo, khi = known
    out = np.full(len(x), -1, np.int64)
    at, left = np.searchsorted(kx, x), np.arange(len(x))
    while len(left):  # again only where two words have the same x
        on = at < len(kx)
        at, left = at[on], left[on]
        on = kx[at] == x[left]
        at, left = at[on], left[on]
        hit = (klo[at] == lo[left]) & (khi[at] == hi[left])
        out[left[hit]] = at[hit]
        at, left = at[~hit] + 1, left[~hit]
    return out


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES together."""
    a, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > BATCH_BYTES:
            yield a, i
            a, size = i, 0
        size += n + 1
    if a < len(sizes):
        yield a, len(sizes)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """The texts of an Arrow column, a group at a time, so that a large batch isn't copied at once."""
    raw = column.cast(pa.binary())
    for i, j in _groups(pc.fill_null(pc.binary_length(raw), 0).to_pylist()):
        yield i, j, text_bytes(raw.slice(i, j - i))


def _rows_of(batch: pa.RecordBatch) -> Iterator[list]:
    """The rows of a batch, with buffers in place of bytes, so that none are copied."""
    for i in range(batch.num_rows):
        row = [c[i] for c in batch.columns]
        yield [x.as_buffer() if x.is_valid and pa.types.is_binary(x.type) else x.as_py() for x in row]


def _parts(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, bool]]:
    """(bytes, offset of each text, whether the last text ends there); a long text alone comes in parts that end at white space."""
    data = b" ".join(texts)
    if len(texts) > 1 or len(data) <= 2 * BATCH_BYTES:
        yield data, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), True
        return
    at = 0
    while at < len(data):
        end = min(at + BATCH_BYTES, len(data))
        cut = data[at:end].translate(TABLE).rfind(b" ") if end < len(data) else 0
        if cut > 0:
            end = at + cut
        while cut <= 0 and end < len(data):  # a token longer than a part
            more = data[end : end + BATCH_BYTES].translate(TABLE)
            cut = more.find(b" ")
            end += cut if cut >= 0 else len(more)
            if cut >= 0:
                break
        yield data[at:end], np.zeros(1, np.int64), end >= len(data)
        at = end


# ---- counts


def _count(batches):
    for b in batches:
        for _, _, texts in _texts(b.column(0)):
            for data, _, _ in _parts(texts):
                _, lo, hi = words(data)
                w = Words(lo, hi)
                n = np.bincount(w.of, minlength=len(w.x))
                yield pa.RecordBatch.from_arrays([pa.array(w.lo.view(np.int64)), pa.array(w.hi.view(np.int64)), pa.array(n.astype(np.int64))], ["lo", "hi", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """lo, hi, n: the count of every word in docs (text); batches count their words before anything is shuffled."""
    each = docs.select("text").mapInArrow(_count, "lo long, hi long, n long")
    return written(each.groupBy("lo", "hi").agg(F.sum("n").alias("n")), "word-counts")


# ---- the model


def _rows(*parts) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(29))
    return (h % np.uint64(ROWS)).astype(np.uint16)


def before(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The one, two and three words before each token; first: its place in its text; last: the three words before x."""
    out = []
    for k in (1, 2, 3):
        p = np.r_[last[3 - k :], x][: len(x)]
        out.append(np.where(first >= k, p, BEFORE))
    return out


class Model:
    """Weights of classes (a) and of cells within classes (w); biases are the logs of how often these occur.

    own: the words that have cells of their own, by their 64 bits, most frequent first. Weights stay within LIMIT, so
    that the exp of their sums is a number.
    """

    def __init__(self, own: np.ndarray):
        own = own[: OWN * CELLS]
        order = np.argsort(own)
        self.own, self.own_cell = own[order], order
        self.class_bias, self.cell_bias = np.zeros(CLASSES, np.float32), np.zeros((CLASSES, CELLS), np.float32)
        self.a, self.w = np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, CELLS), np.float32)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Class x CELLS + cell of each word."""
        shared = OWN * CELLS + (x >> np.uint64(20)) % np.uint64(SHARED * CELLS)
        out = shared.astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, x), len(self.own) - 1)
            out = np.where(self.own[at] == x, self.own_cell[at], out)
        return np.where(x == END, END_CELL, out)

    def count(self, n: np.ndarray) -> None:
        """Sets the biases from the number of training tokens in each cell."""
        n = n.reshape(CLASSES, CELLS) + 1e-3
        self.class_bias = np.log(n.sum(1) / n.sum()).astype(np.float32)
        self.cell_bias = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)

    @staticmethod
    def class_rows(p: list[np.ndarray]) -> list[np.ndarray]:
        return [_rows(np.uint64(1), p[0]), _rows(np.uint64(2), p[0], p[1]), _rows(np.uint64(3), p[1]), _rows(np.uint64(4), p[2])]

    @staticmethod
    def cell_rows(p: list[np.ndarray], cls: np.ndarray) -> list[np.ndarray]:
        return [_rows(np.uint64(5), p[0], cls.astype(np.uint64))]

    def _each(self, p: list[np.ndarray], cell: np.ndarray):
        """Chunk by chunk and for both steps: which weights, their rows, what was chosen, exp of all sums, their totals, log of the choice."""
        for i in range(0, len(cell), AT_ONCE):
            q, c = [v[i : i + AT_ONCE] for v in p], cell[i : i + AT_ONCE]
            cls, sub = np.divmod(c, CELLS)
            for k, (weights, rows, bias, on) in enumerate(((self.a, self.class_rows(q), self.class_bias, cls), (self.w, self.cell_rows(q, cls), np.take(self.cell_bias, cls, 0), sub))):
                z = np.take(weights, rows[0], 0)
                for r in rows[1:]:
                    z += np.take(weights, r, 0)
                z += bias
                at = np.arange(len(c)) * z.shape[1] + on
                chosen = z.ravel()[at]
                e = np.exp(z, out=z)
                total = e @ np.ones(e.shape[1], np.float32)
                yield k, rows, at, e, total, chosen - np.log(total)

    def score(self, p: list[np.ndarray], cell: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's cell after the words p."""
        steps: tuple[list, list] = ([], [])
        for k, _, _, _, _, logs in self._each(p, cell):
            steps[k].append(logs)
        return np.concatenate(steps[0]) + np.concatenate(steps[1]) if steps[0] else np.zeros(0, np.float32)

    def gradient(self, p: list[np.ndarray], cell: np.ndarray, ga: np.ndarray, gw: np.ndarray) -> None:
        """Adds features seen less features expected to the sums of class and cell weights."""
        for k, rows, at, e, total, _ in self._each(p, cell):
            e *= (-1 / total)[:, None]
            d = e.ravel()
            d[at] += 1
            flat, width = (ga, gw)[k].ravel(), e.shape[1]
            for r in rows:
                np.add.at(flat, (r.astype(np.int64)[:, None] * width + np.arange(width)).ravel(), d)


def sequence(part, last: np.ndarray, begun: int):
    """(words, order, document and id of each token with the ends, words before each, last three ids, tokens so far) of a part.

    order: which of the words' tokens it is, -1 for an end. last, begun: the ids and tokens of a text that goes on.
    """
    data, offsets, ends = part
    start, lo, hi = words(data)
    w = Words(lo, hi)
    doc = np.searchsorted(offsets, start, "right") - 1
    n = np.bincount(doc, minlength=len(offsets)) + ends
    who = np.repeat(np.arange(len(offsets)), n)
    first = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    is_end = np.zeros(len(who), bool)
    if ends:
        is_end[np.cumsum(n) - 1] = True
    order = np.full(len(who), -1, np.int64)
    order[~is_end] = np.arange(len(start))
    x = np.full(len(who), END, np.uint64)
    x[~is_end] = w.x[w.of]
    first = first + np.where(who == 0, begun, 0)
    return w, order, who, x, before(x, first, last), np.r_[last, x][-3:], (len(x) + begun)


NONE = np.full(3, BEFORE, np.uint64)


def _gradients(model: Model):
    def run(batches):
        ga, gw = np.zeros_like(model.a), np.zeros_like(model.w)
        for b in batches:
            for _, _, texts in _texts(b.column(0)):
                last, begun = NONE, 0
                for part in _parts(texts):
                    w, order, _, x, p, last, begun = sequence(part, last, begun)
                    cell = np.r_[model.cells(w.x), END_CELL][np.where(order < 0, len(w.x), np.r_[w.of, 0][order])]
                    model.gradient(p, cell, ga, gw)
        for name, g in ((0, ga), (1, gw)):
            used = np.flatnonzero(g.reshape(-1, BLOCK, g.shape[1]).any((1, 2)))
            for i in range(0, len(used), 64):
                some = used[i : i + 64].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name * ROWS + k for k in some], pa.int32()), pa.array([g[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in some], pa.binary())], ["block", "sums"]
                )

    return run


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in _rows_of(b):
            x = np.frombuffer(x, np.float32)
            total[k] = total[k] + x if k in total else x.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<f4").tobytes() for v in total.values()], pa.binary())], ["block", "sums"])


def fit(model: Model, train: DataFrame, size: int, rounds: int = ROUNDS) -> Model:
    """Gradient updates over all rows of train (doc_id, text), of size bytes: one for each of rounds parts of them.

    The number of tasks follows the size. A step is RATE times the gradient over the root of the squares so far
    (AdaGrad), less for features that few tokens have.
    """
    spark = train.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    blocks = min(2 * ROWS // BLOCK, int(spark.conf.get("spark.sql.shuffle.partitions")))
    past = [np.full_like(model.a, CAUTION**2), np.full_like(model.w, CAUTION**2)]
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for k in range(rounds):
        each = train.filter(part == k).select("text").coalesce(tasks).mapInArrow(_gradients(model), "block int, sums binary")
        summed = each.repartition(blocks, "block").mapInArrow(_added, "block int, sums binary")
        g = [np.zeros_like(model.a), np.zeros_like(model.w)]
        for r in summed.collect():  # as many rows as the weights have blocks, whatever the corpus
            t, i = divmod(r.block, ROWS)
            g[t][i * BLOCK : (i + 1) * BLOCK] = np.frombuffer(r.sums, np.float32).reshape(BLOCK, -1)
        for weights, seen, x in zip((model.a, model.w), past, g):
            seen += x * x
            weights += np.float32(RATE) * x / np.sqrt(seen)
            np.clip(weights, -LIMIT, LIMIT, out=weights)
    return model


# ---- scores


class Scorer:
    """What tasks need: counts of frequent words, the model, and what each cell holds.

    n, v: training tokens and their kinds; ends: how many are ends; cells: training tokens in each cell; once: how
    many words occur once.
    """

    def __init__(self, model: Model, n: int, v: int, ends: int, frequent: tuple[np.ndarray, ...], cells: np.ndarray, once: int):
        self.model, self.n, self.v, self.ends = model, n, v, ends
        self.x, self.lo, self.hi, self.counts = frequent
        self.cells, self.new = cells, (once + 1) / (n + 2)

    def base_logs(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def word_logs(self, c: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Log10 probability of words with the counts c in training given their cells, and that a word isn't new."""
        return np.log10(np.maximum(c, 1) / np.maximum(np.where(cell < OWN * CELLS, np.maximum(c, 1), self.cells[cell]), 1)) + math.log10(1 - self.new)


DEALT = "batch long, part int, bucket int, first long, lo binary, hi binary, postings binary, facts binary"


def _deal(s: Scorer, buckets: int):
    """Of each batch: what is known of its documents, the places of words that aren't frequent, and requests for their counts."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), -1
        for b in batches:
            ids, held = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, texts in _texts(b.column(2)):
                number += 1
                yield from _requests(s, buckets, (task << 32) | number, ids[i:j], held[i:j], texts)

    return run


def _postings(each: np.ndarray, word: np.ndarray, times: np.ndarray, logs: np.ndarray) -> bytes:
    """How many words each document asks for, these, how often it has them, and logs of the words of documents that are held out."""
    wide = "<i4" if len(times) and times.max() > 255 else "u1"
    return b"".join([bytes([np.dtype(wide).itemsize]), *(v.astype(k).tobytes() for v, k in ((each, "<i4"), (word, "<i4"), (times, wide), (logs, "<f4")))])


def _unpacked(blob: bytes, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, word, times, log) of postings; the log is 0 in documents that aren't held out."""
    width = int(np.frombuffer(blob, "u1", 1)[0])
    each = np.frombuffer(blob, "<i4", len(held), 1)
    doc = np.repeat(np.arange(len(held)), each)
    at, m = 1 + 4 * len(held), len(doc)
    word, times = np.frombuffer(blob, "<i4", m, at), np.frombuffer(blob, "u1" if width == 1 else "<i4", m, at + 4 * m).astype(np.int64)
    logs = np.zeros(m)
    logs[held.astype(bool)[doc]] = np.frombuffer(blob, "<f4", -1, at + (4 + width) * m) if held.any() and each[held.astype(bool)].sum() else 0
    return doc, word, times, logs


def _requests(s: Scorer, buckets: int, key: int, ids: list, held: list, texts: list[bytes]):
    n = len(ids)
    size, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    last, begun, asked = NONE, 0, 0
    for k, part in enumerate(_parts(texts)):
        w, order, who, x, p, last, begun = sequence(part, last, begun)
        at = found(w.x, w.lo, w.hi, (s.x, s.lo, s.hi))
        c, cell = np.r_[s.counts, 0][at], s.model.cells(w.x)
        here = np.r_[at >= 0, True]  # the last one is the end
        flat = [np.where(here, np.r_[v, e], 0) for v, e in ((s.base_logs(c), s.base_logs(np.array([s.ends]))[0]), (s.word_logs(c, cell), math.log10(1 - s.new)), (c > 0, s.ends > 0))]
        of = np.where(order < 0, len(w.x), np.r_[w.of, 0][order])
        logs = s.model.score(p, np.r_[cell, END_CELL][of]) / math.log(10)
        size += np.bincount(who, minlength=n)
        base += np.bincount(who, flat[0][of], n)
        score += np.bincount(who, np.where(here[of], logs + flat[1][of], 0), n)
        known += np.bincount(who, flat[2][of], n).astype(np.int64)
        # words to ask for, by bucket
        ask = np.flatnonzero(~here)
        to = (w.x[ask] >> np.uint64(24)) % np.uint64(buckets)
        ask = ask[np.argsort(to, kind="stable")]
        to = np.sort(to).astype(np.int64)
        rank = np.full(len(w.x) + 1, -1, np.int64)
        rank[ask] = np.arange(len(ask))
        token = rank[of]
        pair, to_pair, times = np.unique((who * max(1, len(ask)) + token)[token >= 0], return_inverse=True, return_counts=True)
        doc, word = np.divmod(pair, max(1, len(ask)))
        # the words of training documents are known; in others the log of a word's cell counts if its count isn't 0
        sums, on = np.bincount(to_pair, logs[token >= 0], len(pair)), np.array(held, bool)[doc]
        score += np.bincount(doc[~on], sums[~on], n)
        postings = _postings(np.bincount(doc, minlength=n), word + asked, times, sums[on])
        full, first = np.unique(to, return_index=True)
        stop = np.r_[first[1:], len(to)].astype(np.int64)
        rows = [(key, k, int(q), int(a) + asked, w.lo[ask[a:z]].tobytes(), w.hi[ask[a:z]].tobytes(), None, None) for q, a, z in zip(full, first, stop)]
        rows.append((key, k, None, None, None, None, postings, None))
        asked += len(ask)
        yield _batch(rows, DEALT)
    facts = b"".join([np.array([i is None for i in ids], "u1").tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(held, "u1").tobytes(), *(v.tobytes() for v in (size, known, base, score))])
    yield _batch([(key, -1, None, asked, None, None, None, facts)], DEALT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


PACKED = "bucket int, kind int, batch long, first long, lo binary, hi binary, counts binary"


def _packed(buckets: int):
    """Counts of words as rows by bucket."""

    def run(batches):
        for b in batches:
            lo, hi, n = (np.asarray(b.column(i)) for i in range(3))
            to = ((ids_of(lo.view(np.uint64), hi.view(np.uint64)) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            full, first = np.unique(to[order], return_index=True)
            stop = np.r_[first[1:], len(to)].astype(np.int64)
            cut = [order[a:z] for a, z in zip(first.tolist(), stop.tolist())]
            yield _batch([(q, 0, None, None, lo[k].tobytes(), hi[k].tobytes(), n[k].tobytes()) for q, k in zip(full.tolist(), cut)], PACKED)

    return run


def _answers(batches):
    """The counts that are asked for, from rows sorted by bucket, a bucket's counts before its requests."""
    now, known, parts = None, None, []
    for b in batches:
        out = []
        for bucket, kind, batch, first, lo, hi, n in _rows_of(b):
            lo, hi = np.frombuffer(lo, "<u8"), np.frombuffer(hi, "<u8")
            if bucket != now:
                now, known, parts = bucket, None, []
            if kind == 0:
                parts.append((lo, hi, np.frombuffer(n, "<i8")))
                continue
            if known is None:
                klo, khi, kn = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64 if i == 2 else np.uint64) for i in range(3))
                x = ids_of(klo, khi)
                order = np.argsort(x)
                known, counts, parts = (x[order], klo[order], khi[order]), np.r_[kn[order], 0], []
            out.append((batch, 1, first, counts[found(ids_of(lo, hi), lo, hi, known)].tobytes(), ids_of(lo, hi).tobytes(), None))
        yield _batch(out, JOINED)


JOINED = "batch long, kind int, first long, counts binary, x binary, postings binary"


def _joined(s: Scorer):
    """The rows of whole batches, sorted by batch and kind: facts, then counts, then postings."""

    def run(batches):
        now, facts, counts, cells = None, None, None, None
        for b in batches:
            for batch, kind, first, blob, x, postings in _rows_of(b):
                if batch != now:
                    if facts is not None:
                        yield _result(s, facts)
                    now = batch
                if kind == 0:
                    facts, counts, cells = _facts(postings), np.zeros(first, np.int64), np.zeros(first, np.int64)
                elif kind == 1:
                    n = np.frombuffer(blob, "<i8")
                    counts[first : first + len(n)] = n
                    cells[first : first + len(n)] = s.model.cells(np.frombuffer(x, "<u8"))
                else:
                    doc, word, times, logs = _unpacked(postings, facts["held"])
                    c, m = counts[word], len(facts["ids"])
                    facts["base"] += np.bincount(doc, s.base_logs(c) * times, m)
                    facts["score"] += np.bincount(doc, np.where(c > 0, logs + s.word_logs(c, cells[word]) * times, math.log10(s.new) * times), m)
                    facts["known"] += np.bincount(doc, (c > 0) * times, m).astype(np.int64)
        if facts is not None:
            yield _result(s, facts)

    return run


def _facts(blob) -> dict[str, np.ndarray]:
    kinds = [("null", "u1"), ("ids", "<i8"), ("held", "u1"), ("size", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")]
    n, at, out = memoryview(blob).nbytes // sum(np.dtype(k).itemsize for _, k in kinds), 0, {}
    for name, k in kinds:
        out[name] = np.frombuffer(blob, k, n, at).copy()
        at += n * np.dtype(k).itemsize
    return out


def _result(s: Scorer, f: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(f["ids"], pa.int64(), mask=f["null"].astype(bool)), pa.array(f["held"].astype(bool)), *(pa.array(v) for v in (f["size"], f["known"], np.full(len(f["ids"]), s.n), f["base"], f["score"]))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])


def _cells(model: Model):
    """Tokens of each cell, and how many of its words occur once."""

    def run(batches):
        total = np.zeros((2, CLASSES * CELLS), np.int64)
        for b in batches:
            lo, hi, n = (np.asarray(b.column(i)) for i in range(3))
            cell = model.cells(ids_of(lo.view(np.uint64), hi.view(np.uint64)))
            for t, v in zip(total, (n, n == 1)):
                t += np.bincount(cell, v, CLASSES * CELLS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES * CELLS), pa.int32()), *(pa.array(t) for t in total)], ["cell", "n", "once"])

    return run


def learn(train: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Scorer:
    """What train (doc_id, text; all of its rows) and the counts of its words teach."""
    kinds, seen = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends, size = train.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    top = counts.filter(F.col("n") >= max(1, -(-seen // FREQUENT))).collect()  # no more words than FREQUENT have that share
    top = sorted((-r.n, r.lo, r.hi) for r in top)
    n, lo, hi = (np.array([r[i] for r in top], np.int64) for i in range(3))
    x = ids_of(lo.view(np.uint64), hi.view(np.uint64))
    model, order = Model(x), np.argsort(x)
    frequent = (x[order], lo.view(np.uint64)[order], hi.view(np.uint64)[order], -n[order])
    cells, once = np.zeros(CLASSES * CELLS, np.int64), 0
    for r in counts.mapInArrow(_cells(model), "cell int, n long, once long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect():  # a row for each cell
        cells[r.cell], once = r.n, once + r.once
    cells[END_CELL] = ends
    model.count(cells)
    if ends:
        fit(model, train, size, rounds)
    return Scorer(model, seen + ends, kinds + (ends > 0), ends, frequent, cells, once)


def apply(docs: DataFrame, scorer: Scorer, counts: DataFrame) -> DataFrame:
    """RESULT for every row of docs (doc_id, held_out, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt = written(docs.mapInArrow(_deal(scorer, tasks), DEALT), "dealt")
    null = F.lit(None)
    requests = dealt.filter("bucket is not null").select("bucket", F.lit(1).alias("kind"), "batch", "first", "lo", "hi", null.cast("binary").alias("counts"))
    both = counts.mapInArrow(_packed(tasks), PACKED).unionByName(requests)
    answers = both.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answers, JOINED)
    own = dealt.filter("bucket is null").select(
        "batch", F.when(F.col("part") < 0, 0).otherwise(2).alias("kind"), "first", null.cast("binary").alias("counts"), null.cast("binary").alias("x"), F.coalesce("postings", "facts").alias("postings")
    )
    return answers.unionByName(own).repartition(tasks, "batch").sortWithinPartitions("batch", "kind").mapInArrow(_joined(scorer), RESULT)


def score(docs: DataFrame) -> DataFrame:
    """Base and model scores of every text of docs (doc_id, text; other columns are ignored): RESULT.

    All that is learned comes from the rows that aren't held out, and from all of those. A null text counts as
    empty: its one token is the end. Repeated rows count and are scored each; a null doc_id is kept, its crc32
    that of the empty text. A text of any length is scored whole, in parts of bounded size. An empty table gives
    no rows.
    """
    source = docs.select("doc_id", held_out().alias("held_out"), "text")
    train = source.filter("not held_out")
    counts = word_counts(train)
    return apply(source, learn(train, counts), counts)
