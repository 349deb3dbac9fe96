"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Lengths are partitioned into reciprocal-capacity classes: a piece of more than capacity / (k + 1) and at most
capacity / k tokens is in class k, and a bin of class k takes k pieces; the last class holds all shorter pieces.
A document gives whole sequences and one rest, which goes to its class uncut. Each worker fills the bins of
each class on its own: no shuffle, and no piece waits for another worker.

A bin with its k pieces still has a gap of under capacity / (k + 1). The head of the next rest that is longer
than the gap fills it, and that rest's tail goes to the class of its own length, never to be cut again. So a
document is in at most one piece more than it has sequences, and padding is what the gaps under LEAST tokens
and the bins that are open at a partition's end leave.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import freeing

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: The last class, which holds all shorter pieces too; cutting leaves no piece, and filling no gap, under so many tokens.
CLASSES, LEAST = 12, 32
#: Sequences of one partition are numbered from partition << SEQUENCE_BITS.
SEQUENCE_BITS = 40
#: Distinct white-space separated strings, and distinct words, whose ids a worker remembers; then it starts afresh.
CACHE, WORDS = 400_000, 400_000
#: Words of more bytes are merged by the tokenizer, whose time grows with a word's length alone; Merges suits many short ones.
LONG_WORD = 256
#: Bytes of strings whose ids a worker remembers.
HELD = 64 << 20
#: A mark after a word is a token of its own.
MARKS = ".,;:!?"
#: Longer texts are tokenised in parts that end at white space.
PART = 1 << 20
#: Python's split() takes these for white space, the tokenizer doesn't; and its own special strings.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|startoftext|>", "<|endoftext|>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merges of many words at once: in each round every word merges its lowest-ranked pair, leftmost first."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, spec: dict, letters: dict[int, str]):
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = np.int64(max(vocab.values()) + 1)
        order = np.argsort(left * self.size + right, kind="stable")
        self.pairs, self.ranks = (left * self.size + right)[order], order.astype(np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE for those that don't merge, and where b is -1."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where((self.pairs[at] == code) & (b >= 0), self.ranks[at], self.NONE)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        top = 1
        while (lengths > top // 2).any():
            some = np.flatnonzero((lengths > top // 2) & (lengths <= top))
            for part in np.array_split(some, max(1, len(some) * top // 2_000_000)):
                for i, ids in zip(part.tolist(), self._merge([words[i] for i in part.tolist()], lengths[part], top)):
                    out[i] = ids
            top *= 2
        return out

    def _merge(self, words: list[bytes], n: np.ndarray, width: int) -> list[bytes]:
        if not words:
            return []
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        sym = np.full((len(words), width + 1), -1, np.int64)
        column = np.arange(width)
        sym[:, :-1] = np.where(column < n[:, None], self.inner[raw], -1)
        every = np.arange(len(words))
        sym[every, n - 1] = self.final[raw[every, n - 1]]
        n = n.copy()
        ranks = self.rank(sym[:, :-1], sym[:, 1:])
        live = every
        s, r = sym, ranks
        while True:
            j = r.argmin(1)
            low = r[np.arange(len(r)), j]
            on = np.flatnonzero(low < self.NONE)
            if len(on) < len(r):
                sym[live] = s
                live, s, r, j, low = live[on], s[on], r[on], j[on], low[on]
            if not len(live):
                break
            k = np.arange(len(live))
            take = column + (column > j[:, None])
            s[:, :-1] = np.take_along_axis(s, take, 1)
            r = np.take_along_axis(np.concatenate([r, np.full((len(r), 1), self.NONE, np.int32)], 1), take, 1)
            s[k, j] = self.result[low]
            r[k, j] = self.rank(s[k, j], s[k, j + 1])
            before = np.flatnonzero(j > 0)
            r[before, j[before] - 1] = self.rank(s[before, j[before] - 1], s[before, j[before]])
            n[live] -= 1
        flat = sym[:, :-1][column < n[:, None]].astype("<u4").tobytes()
        ends = 4 * np.cumsum(n)
        return [flat[b - 4 * m : b] for b, m in zip(ends.tolist(), n.tolist())]


class Encoder:
    """Ids of whole texts, the same as Tokenizer.encode(text, add_special_tokens=False), in about a third of its time.

    The vocabulary never joins characters across white space, so the ids of a text are those of its
    white-space separated strings in turn. Those repeat; merges run once for each word.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.full = Tokenizer.from_file(path)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and spec["model"]["type"] == "BPE"
            and bool(spec["model"]["end_of_word_suffix"])
        )
        if self.by_word:
            self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            hidden = [b for b in range(256) if b not in set(shown)]
            self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
            self.merges = Merges(spec, self.letters)
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word: short ones together, each long one by the tokenizer's own model."""
        coded = [w.encode() for w in words]
        long = {k for k, w in enumerate(coded) if len(w) > LONG_WORD}
        short = iter(self.merges([w for k, w in enumerate(coded) if k not in long]) if len(long) < len(coded) else ())
        return [self._model(w) if k in long else next(short) for k, w in enumerate(coded)]

    def _model(self, word: bytes) -> bytes:
        tokens = self.full.model.tokenize("".join(map(self.letters.__getitem__, word)))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def learn(self, strings: list[str]) -> None:
        """Puts the ids of strings without white space into the cache: words, words with one mark, and the rest."""
        if len(self.words) > WORDS:
            self.words = {}
        lows = [s.lower() for s in (strings if all(map(str.isascii, strings)) else [s.replace("Σ", "σ") for s in strings])]
        plain = list(map(str.isalpha, lows))
        words, others = list(compress(lows, plain)), [(s, x) for s, x, p in zip(strings, lows, plain) if not p]
        bodies = [x[:-1] for _, x in others]
        marked = [x[-1] in MARKS and w.isalpha() for w, (_, x) in zip(bodies, others)]
        rest = {s: self.pattern.findall(x) for (s, x), m in zip(others, marked) if not m}
        known = self.words
        new = [w for w in set().union(words, compress(bodies, marked), MARKS, *rest.values()) if w not in known]
        known.update(zip(new, self.merged(new)))
        self.cache.update(zip(compress(strings, plain), map(known.__getitem__, words)))
        self.cache.update((s, known[w] + known[x[-1]]) for w, (s, x), m in zip(bodies, others, marked) if m)
        self.cache.update((s, b"".join([known[w] for w in ws])) for s, ws in rest.items())

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; what is new in about PART characters is learned at once."""
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and size < PART:
                some.append(self._strings(texts[at]) if len(texts[at]) <= PART else texts[at])
                size += len(texts[at])
                at += 1
            self._know([x for x in some if isinstance(x, list)])
            done = [b"".join(map(self.cache.__getitem__, x)) if isinstance(x, list) else None for x in some]
            for x, ids in zip(some, done):
                yield ids if ids is not None else self._whole(x) if len(x) <= PART else self._long(x)

    def _strings(self, text: str) -> list[str] | str:
        """The white-space separated strings; the text itself if it must be tokenised whole."""
        if not self.by_word or any(x in text for x in ODD):
            return text
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.split()

    def _know(self, lists: list[list[str]]) -> None:
        if len(self.cache) > CACHE or self.held > HELD:
            self.forget()
        known = self.cache
        new = [s for s in set().union(*lists) if s not in known]
        if new:
            self.held += sum(map(len, new))
            self.learn(new)

    def _whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.full.encode(text, add_special_tokens=False).ids)

    def _long(self, text: str) -> bytes:
        """A long text, in parts that end at white space."""
        if not self.by_word or any(x in text for x in ODD):
            return self._whole(text)
        out, at, space = [], 0, re.compile(r"\s")
        while at < len(text):
            end = space.search(text, at + PART)
            end = end.start() if end else len(text)
            strings = self._strings(text[at:end])
            self._know([strings])
            out.append(b"".join(map(self.cache.__getitem__, strings)))
            at = end
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Bins:
    """The bins of one worker: an open one for each class, and those that wait for the head of a rest.

    Pieces are (doc_id, start, length, crc, tokens of the document).
    """

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.least = first, capacity, min(LEAST, capacity // 2)
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[int, int, list[tuple]]] = []  # (gap, number, pieces) by gap; the number breaks ties
        self.number = self.filled = 0  # filled: tokens in the open bin of the last class

    def document(self, doc_id, ids: bytes) -> list[tuple]:
        """The rows of the bins that a document's ids fill."""
        n, out, at = len(ids) // 4, [], 0

        def piece(start: int, size: int) -> tuple:
            return doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n

        while n - at >= self.capacity:
            out += self._close([piece(at, self.capacity)])
            at += self.capacity
        if at < n and (fit := self._fit(n - at)):
            i, size = fit
            _, _, pieces = self.waiting.pop(i)
            out += self._close([*pieces, piece(at, size)])
            at += size
        return out + self._put(piece(at, n - at)) if at < n else out

    def _fit(self, rest: int) -> tuple[int, int] | None:
        """(place of a waiting bin, tokens of a rest that fill it): the largest gap that leaves a tail of at least LEAST tokens.

        Without one, a gap that is a little larger takes all but such a tail.
        """
        i = bisect.bisect_right(self.waiting, rest - self.least, key=lambda w: w[0])
        if i:
            return i - 1, self.waiting[i - 1][0]
        if self.waiting and self.waiting[0][0] < rest and rest >= 2 * self.least:
            return 0, rest - self.least
        return None

    def _put(self, piece: tuple) -> list[tuple]:
        """Puts a piece into the open bin of its class; the rows of the bin that this closes, if it does."""
        k = min(self.capacity // piece[2], CLASSES)
        bin_ = self.open.setdefault(k, [])
        if k < CLASSES:
            bin_.append(piece)
            full = len(bin_) == k
        else:
            full = self.filled + piece[2] > self.capacity
            if full:
                self.open[k], self.filled = [piece], piece[2]
            else:
                bin_.append(piece)
                self.filled += piece[2]
        if not full:
            return []
        if k < CLASSES:
            del self.open[k]
        gap = self.capacity - sum(p[2] for p in bin_)
        if gap < self.least:
            return self._close(bin_)
        self.number += 1
        bisect.insort(self.waiting, (gap, self.number, bin_))
        return []

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def rest(self) -> list[tuple]:
        """The rows of all bins left: pieces of open bins, longest first, go to the smallest gap that takes them."""
        gaps = [(gap, number, pieces) for gap, number, pieces in self.waiting]
        for p in sorted((p for ps in self.open.values() for p in ps), key=lambda p: -p[2]):
            i = bisect.bisect_left(gaps, p[2], key=lambda g: g[0])
            self.number += 1
            gap, _, pieces = gaps.pop(i) if i < len(gaps) else (self.capacity, 0, [])
            bisect.insort(gaps, (gap - p[2], self.number, [*pieces, p]))
        self.open, self.waiting = {}, []
        return [row for _, _, pieces in gaps for row in self._close(pieces)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs every document into sequences of at most capacity tokens.

    docs: doc_id, text (other columns are ignored). A null or empty text is the end id alone. Rows with the
    same doc_id or a null one are packed as documents of their own. An empty table gives no rows. Returns a
    row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document has at most
    ceil(doc_tokens / capacity) + 1 pieces. A task that runs again gives the same rows: the ids depend on its
    partition alone.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    path, last = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")

    def run(batches):
        enc, bins = encoder(path), Bins(TaskContext.get().partitionId() << SEQUENCE_BITS, capacity)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.ids(texts)):
                rows += bins.document(doc_id, ids + last)
            yield _batch(rows)
        yield _batch(bins.rest())
        enc.forget()  # workers serve other stages too

    return docs.select("doc_id", "text").mapInArrow(freeing(run), SCHEMA)
