"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent 1- to 3-grams in rank order, counted over all training documents. A
document's own most frequent n-grams are ranked alike; the language with the smallest out-of-place distance
(sum of rank differences, the profile length where an n-gram is missing) is the prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import crc_column, freeing, written

PROFILE = 400
#: Profiles of so many languages are sent to the workers at once: a table of 4 bytes x n-grams x languages.
LANGUAGES = 200
#: A filter keeps texts with at least this score and at most this share of the greatest distance to the nearest language.
LEAST_SCORE, FAR = 0.02, 0.8
#: Characters of a text whose n-grams are made at once, and n-grams that are counted at once.
PART, COUNTED = 1 << 20, 1 << 21

_letters = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def codes(text: str | None) -> Iterator[np.ndarray]:
    """The 1- to 3-grams of a whole text as numbers, 21 bits a character, part by part; words are bounded by one space.

    The last two characters of a part go before the next one, so parts don't change what comes out.
    """
    low, tail = (text or "").lower(), np.array([32], np.int64)
    for at in range(0, len(low), PART):
        c = np.frombuffer(low[at : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.r_[tail, np.where(letters()[c], c, 32)]
        if at + PART >= len(low):
            c = np.r_[c, 32]
        gap = c == 32
        c = c[np.r_[True, ~(gap[1:] & gap[:-1])]]
        done, two = len(tail), (c[:-1] << 21) | c[1:]
        three = ((two[:-1] << 21) | c[2:])[c[1:-1] != 32] if done == 1 else ((two[:-1] << 21) | c[2:])[done - 2 :][c[done - 1 : -1] != 32]
        one = c[done:]
        yield np.concatenate([one[one != 32], two[done - 1 :], three])
        tail = c[-2:]


def counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order and their counts."""
    x = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.r_[at, len(x)]) if len(x) else at


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text in order and their counts."""
    got, wait = [], []
    for c in codes(text):
        wait.append(c)
        if len(c) >= PART:  # a long text: counted as it goes
            got, wait = [*got, counted(wait)], []
    got += [counted(wait)] if wait or not got else []
    if len(got) == 1:
        return got[0]
    x, inverse = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
    return x, np.bincount(inverse, np.concatenate([n for _, n in got]), len(x)).astype(np.int64)


def _count(batches):
    wait: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush():
        for lang, parts in wait.items():
            x, n = counted(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])
        wait.clear()

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            for c in codes(text.as_py()):
                wait.setdefault(lang.as_py(), []).append(c)
                held += len(c)
                if held > COUNTED:
                    yield from flush()
                    held = 0
    yield from flush()


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, code, rank of each language's most frequent n-grams; labelled: lang, text, all rows are counted.

    The table is written: size rows a language, counted once however often it is read.
    """
    known = labelled.filter("lang is not null and text is not null").select("lang", "text")
    counts = known.mapInArrow(freeing(_count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    # the bound on the row's number lets each task drop all but its first rows of a language before they are dealt out
    top = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    return written(top.select("lang", "code", (F.col("place") - 1).alias("rank")), "profiles")


class Profiles:
    """Profiles of some languages, and the distance of a text to each."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({lang for lang, _, _ in rows})
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.codes = np.array(sorted({c for _, c, _ in rows}), np.int64)
        self.table = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for lang, code, rank in rows:
            self.table[np.searchsorted(self.codes, code), column[lang]] = rank

    def distances(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of a text's n-grams that are ranked, and its out-of-place distance to each language."""
        own, counts = ngrams(text)
        own = own[np.argsort(-counts, kind="stable")[: self.size]]
        if not len(self.codes):
            return len(own), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = self.table[np.where(self.codes[at] == own, at, len(self.codes))]
        return len(own), np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None])).sum(0)


def _nearest(rows: list[tuple[str, int, int]], size: int, state: str):
    """Adds to the column state the languages of some profiles: the nearest one and the next distance."""

    def run(batches):
        known = Profiles(rows, size)
        for b in batches:
            was = b.column(state).to_pylist()
            out = []
            for text, old in zip(b.column("text"), was):
                n, d = known.distances(text.as_py())
                each = sorted(zip(d.tolist(), known.langs))[:2] if n else []
                if old["lang"] is not None:
                    each = sorted([*each, (old["near"], old["lang"])])
                near, lang = each[0] if each else (None, None)
                rest = [*(x for x, _ in each[1:]), *([old["next"]] if old["next"] is not None else [])]
                out.append({"own": n, "lang": lang, "near": near, "next": min(rest, default=None)})
            kind = pa.struct([("own", pa.int32()), ("lang", pa.string()), ("near", pa.int64()), ("next", pa.int64())])
            i = b.schema.names.index(state)
            yield b.set_column(i, b.schema.field(i).with_type(kind), pa.array(out, kind))

    return run


def _measured(docs: DataFrame, profile: DataFrame, size: int) -> tuple[DataFrame, str]:
    """docs with a column of what is nearest so far (own, lang, near, next), and its name: the nearest language of each text. All languages are looked at, LANGUAGES at a time."""
    if "text" not in docs.columns:
        raise ValueError("docs needs a column text")
    state = "nearest" + "_".join(["", *docs.columns]) if "nearest" in docs.columns else "nearest"
    parts = max(1, -(-profile.select("lang").distinct().count() // LANGUAGES))
    out = docs.withColumn(state, F.struct(F.lit(0).alias("own"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("near"), F.lit(None).cast("long").alias("next")))
    schema = StructType([*docs.schema.fields, StructField(state, StructType.fromDDL("own int, lang string, near long, next long"))])
    for part in range(parts):
        some = profile.filter(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part) if parts > 1 else profile
        rows = [(r.lang, r.code, r["rank"]) for r in some.collect()]  # size x LANGUAGES, about
        out = out.mapInArrow(freeing(_nearest(rows, size, state)), schema)
    return out, state


def predict(docs: DataFrame, profile: DataFrame, size: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score; nothing but text is looked at.

    lang_pred is ``und`` and score 0 where text is null or has no letter, or where no language was learned.
    score: how much nearer the best language is than the next, 0 (a tie, taken by name) to 1; with one
    language, the share of the greatest distance that is missing. Other columns are kept, and may have any
    name but lang_pred and score, which are replaced.
    """
    out, state = _measured(docs.drop("lang_pred", "score"), profile, size)
    near, other = F.col(state)["near"], F.coalesce(F.col(state)["next"], F.col(state)["own"].cast("long") * size)
    score = F.when(near.isNull() | (other == 0), 0.0).otherwise((other - near) / other)
    return out.withColumns({"lang_pred": F.coalesce(F.col(state)["lang"], F.lit("und")), "score": score}).drop(state)


def held_out():
    """Rows that profiles never learn from: crc32(doc_id as text) mod 4 is 2."""
    return crc_column("doc_id") % 4 == 2


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Profiles are learned from the rows that aren't held out and have a lang. Repeated rows are rows of their
    own; an empty table gives no rows.
    """
    profile = profiles(docs.filter(~held_out()), size)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profile, size).drop("text")


def keep_identified(docs: DataFrame, size: int = PROFILE, least: float = LEAST_SCORE, far: float = FAR) -> DataFrame:
    """docs, all columns, without the texts that the profiles give no language.

    Those are null texts and texts without a letter; texts whose score is under least, so that two languages are
    as near as each other; and texts whose distance to the nearest language is over far of the greatest one,
    so that they share hardly an n-gram with any. Where no row has a lang to learn from, the texts that have a
    letter stay. Each row is judged by itself, repeated ones too; an empty table gives no rows.
    """
    out, state = _measured(docs, profiles(docs.filter(~held_out()), size), size)
    own, near, other = (F.col(state)[c] for c in ("own", "near", "next"))
    most = own.cast("long") * size
    apart = F.coalesce(other, most) - near >= least * F.coalesce(other, most)
    return out.filter((own > 0) & (near.isNull() | (apart & (near <= far * most)))).drop(state)
