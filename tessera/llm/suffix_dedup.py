"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash of 16 bytes has a trigger in every stretch of 60 bytes (its smallest value there). Triggers cut
a text into phrases; a phrase is kept with the LENGTH bytes after its last start, so that every string of
LENGTH bytes lies in just one phrase, and phrases are prefix-free up to that length. The dictionary holds each
distinct phrase once, with its first place in the corpus; the parse is the list of places. Of a phrase that
comes again every start is a repeat, by the parse alone; phrases are told apart by 128 bits of two hashes.

What is left are the suffixes of dictionary phrases that share the bytes at their trigger, as two equal strings
of LENGTH bytes always do. The dictionary is dealt out by trigger, and a task builds the suffix array of its part
to a depth of LENGTH bytes by doubling prefixes, on the bytes themselves. The parse gives each suffix its first
place; of suffixes that the array finds equal, in the order of their places, all but the first are repeats.
A trigger with more than GROUP phrases is dealt out by the strings themselves instead.

Highly repetitive text costs little: beyond the first place of a phrase only a small record is moved, never
its bytes. Equal triggers are matched in buckets of bounded size; each task first settles what it holds itself
and sends at most one record of a trigger, so a passage in a third of all documents loads no bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small_or_shuffled, numbered, text_bytes, written
from .shingles import mix

LENGTH = 100
GRAM, REACH = 16, 60
#: Bytes from a trigger on that every string of LENGTH bytes anchored there holds.
CORE = LENGTH - REACH + 1
#: Bytes of text for one bucket of triggers, and of text that is hashed together.
BUCKET_BYTES, STRETCH = 16 << 20, 1 << 19
#: Bytes of phrases whose suffixes are put in order together, and phrases of a trigger that are in one task.
ORDERED_BYTES, GROUP = 1 << 20, 2_000
LAST = (1 << 63) - 1

_rng = np.random.default_rng(77)
_BYTE, _BYTE2 = (_rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2))
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        n = STRETCH + LENGTH + 1
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _powers.append(np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)]))
    return _powers


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling."""
    h, k, by = _BYTE[b], 1, 0x9E3779B97F4A7C15
    while k < GRAM:
        h = h[:-k] * np.uint64(by) + h[k:]
        h ^= h >> np.uint64(29)
        by, k = (by * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1, k * 2
    return h


def _phrases(data: bytes, ok: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first start, last start, hash at the trigger, hash of the whole) of the phrases of a stretch.

    ok: for each start whether LENGTH bytes from there are of one document.
    """
    b = np.frombuffer(data, np.uint8)
    h = _grams(b)
    # the smallest hash of each stretch of REACH places, leftmost first: the place is in the lowest bits
    m = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= REACH:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    m = np.minimum(m[: len(m) - (REACH - k)], m[REACH - k :])[: len(ok)]
    at = (m & np.uint64(0xFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]] | np.r_[True, ok[1:] != ok[:-1]])
    first, last = edge, np.r_[edge[1:], len(ok)] - 1
    first, last = first[ok[first]], last[ok[first]]
    t = at[first]
    core = mix(h[t] + mix(h[t + CORE - GRAM] + mix(h[t + (CORE - GRAM) // 2] + np.uint64(9))))
    power, inverse = _tables()
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE2[b] * power[: len(b)], out=sums[1:])
    end = last + LENGTH
    # the trigger's place in the phrase is part of its name
    whole = mix((sums[end] - sums[first]) * inverse[first] + mix(((end - first) * 4096 + t - first).astype(np.uint64)))
    return first, last, core, whole


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(number of the text, first start, last start, trigger's hash, phrase's hash) of all phrases of the texts."""
    out: list[tuple[np.ndarray, ...]] = []

    def stretch(parts: list[tuple[int, int, bytes]]) -> None:
        data = b"".join(p for _, _, p in parts)
        size = np.array([len(p) for _, _, p in parts])
        begin = np.r_[0, np.cumsum(size)]
        n = len(data) - LENGTH + 1
        if n <= 0:
            return
        who = np.searchsorted(begin, np.arange(n), "right") - 1
        ok = np.arange(n) + LENGTH <= begin[who + 1]
        if not ok.any():
            return
        # two texts side by side: a start in the one never shares a phrase with a start in the other, for the
        # last LENGTH - 1 starts of a text are not ok
        first, last, core, whole = _phrases(data, ok)
        w = who[first]
        doc, base = np.array([d for d, _, _ in parts]), np.array([o for _, o, _ in parts])
        shift = base[w] - begin[w]
        out.append((doc[w], first + shift, last + shift, core, whole))

    wait, held = [], 0
    for i, x in enumerate(texts):
        at = 0
        while len(x) - at >= LENGTH:
            part = x[at : at + STRETCH - held + LENGTH] if STRETCH - held >= LENGTH else b""
            if len(part) < LENGTH:
                stretch(wait)
                wait, held = [], 0
                continue
            wait.append((i, at, part))
            held += len(part)
            at += len(part) - LENGTH + 1
            if held >= STRETCH:
                stretch(wait)
                wait, held = [], 0
    if wait:
        stretch(wait)
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def settle(core, whole, doc, first, marked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of phrases by their hashes and places: which are repeats, which are of a trigger with several phrases, and order.

    Returns (order, repeat, several) in that order: order sorts by trigger, phrase and place. marked: rows that
    only say of their trigger that it has several phrases; they come with whole 0.
    """
    order = np.lexsort((first, doc, whole, core))
    c, w, d, f, k = (x[order] for x in (core, whole, doc, first, marked))
    new_c = np.r_[True, c[1:] != c[:-1]]
    new_w = new_c | np.r_[True, w[1:] != w[:-1]] | np.r_[False, k[1:] != k[:-1]]
    lead = np.maximum.accumulate(np.where(new_w, np.arange(len(c)), 0))
    repeat = (d[lead] != d) | (f[lead] != f)
    group = np.cumsum(new_c) - 1
    several = (np.bincount(group, new_w) + np.bincount(group, 2 * k) > 1)[group]
    return order, repeat, several


_KINDS = [("core", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("first", "<i4"), ("span", "u1"), ("marked", "u1")]
_KNOWN = [("rid", "<i8"), ("first", "<i4"), ("span", "u1"), ("several", "u1"), ("core", "<u8")]


def _packed(kinds, columns: dict, at) -> bytes:
    return b"".join(columns[n][at].astype(t).tobytes() for n, t in kinds)


def _unpacked(kinds, blobs: list[bytes]) -> dict:
    width = sum(np.dtype(t).itemsize for _, t in kinds)
    parts: dict[str, list] = {n: [] for n, _ in kinds}
    for x in blobs:
        n, at = len(x) // width, 0
        for name, t in kinds:
            parts[name].append(np.frombuffer(x, t, n, at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(v) if v else np.zeros(0, t) for (n, t), v in zip(kinds, parts.values())}


def _deal(buckets: int):
    """Phrases of a batch, settled among themselves, as one record per bucket of triggers."""

    def run(batches):
        for b in batches:
            rid, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            who, first, last, core, whole = parse(text_bytes(b.column(2)))
            if not len(who):
                continue
            c = {"core": core, "whole": whole, "doc": doc[who], "rid": rid[who], "first": first, "span": last - first, "marked": np.zeros(len(who), np.uint8)}
            order, repeat, several = settle(core, whole, c["doc"], first, c["marked"])
            c = {n: v[order] for n, v in c.items()} | {"several": several.astype(np.uint8) * ~repeat}
            known = _packed(_KNOWN, c, repeat | several)
            # one record of each trigger goes on: its only phrase, or a mark that it has several
            lead = np.r_[True, c["core"][1:] != c["core"][:-1]]
            c["marked"] = several.astype(np.uint8)
            c["whole"] = np.where(several, np.uint64(0), c["whole"])
            to = (c["core"] % np.uint64(buckets)).astype(np.int64)
            sent = np.flatnonzero(lead | (~repeat & ~several))
            sent = sent[np.argsort(to[sent], kind="stable")]
            cut = np.searchsorted(to[sent], np.arange(buckets + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            spare = int(rid[0]) % len(full)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array([_packed(_KINDS, c, sent[cut[i] : cut[i + 1]]) for i in full], pa.binary()),
                    pa.array([known if j == spare else b"" for j in range(len(full))], pa.binary()),
                ],
                ["bucket", "records", "known"],
            )

    return run


def _match(batches):
    """The phrases that are repeats (core null) or of a trigger with several phrases, from all records of some buckets."""
    records, known = [], []
    for b in batches:
        records += b.column(1).to_pylist()
        known.append(_unpacked(_KNOWN, b.column(2).to_pylist()))
    c = _unpacked(_KINDS, records)
    if not len(c["core"]):
        return
    order, repeat, several = settle(c["core"], c["whole"], c["doc"], c["first"], c["marked"])
    c = {n: v[order] for n, v in c.items()} | {"several": (several & ~repeat).astype(np.uint8)}
    on = (repeat | several) & (c["marked"] == 0)
    known.append({n: c[n][on] for n, _ in _KNOWN})
    for k in known:
        if len(k["rid"]):
            first = k["first"].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k["rid"].astype(np.int64)), pa.array(first), pa.array(first + k["span"].astype(np.int32)), pa.array(k["core"].view(np.int64), mask=k["several"] == 0)],
                ["rid", "first", "last", "core"],
            )


def _suffixes(batches):
    """Bytes of the dictionary's phrases whose trigger has several."""
    for b in batches:
        rows = []
        for rid, doc, x, places in zip(*(b.column(i).to_pylist() for i in range(2)), text_bytes(b.column(2)), b.column(3).to_pylist()):
            rows += [(p["core"], doc, rid, p["first"], p["last"], x[p["first"] : p["last"] + LENGTH]) for p in places]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        cols = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], ["core", "doc", "rid", "first", "last", "phrase"])


def suffix_ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rank of the LENGTH bytes from each place at among those of all these places; equal for equal bytes.

    Prefix doubling: the ranks of 8 bytes give those of 16, these those of 32 and 64, and two of these overlap
    in LENGTH. at: places with LENGTH bytes after them.
    """
    b = np.r_[data, np.zeros(8, np.uint8)]
    rank = _dense(np.lib.stride_tricks.sliding_window_view(b, 8)[: len(data)].copy().view(">u8").ravel().astype(np.uint64))
    width = 8
    while 2 * width <= LENGTH:
        rank = _dense((rank[:-width] << np.uint64(32)) | rank[width:]) if len(rank) > width else rank[:0]
        width *= 2
    return _dense((rank[at] << np.uint64(32)) | rank[at + LENGTH - width])


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]], dtype=np.uint64) if len(s) else 0
    return out


def _repeats(rows: list[tuple]) -> pa.RecordBatch:
    """Runs of starts whose string starts earlier too, among whole groups of phrases (core, doc, rid, first, last, bytes)."""
    n = np.array([r[4] - r[3] + 1 for r in rows])
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    begin = np.cumsum([0, *(len(r[5]) for r in rows[:-1])])
    who = np.repeat(np.arange(len(rows)), n)
    step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    doc, rid, first = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    rank, d, p = suffix_ranks(data, begin[who] + step), doc[who], first[who] + step
    order = np.lexsort((p, d, rank))
    lead = np.maximum.accumulate(np.where(np.r_[True, rank[order][1:] != rank[order][:-1]], np.arange(len(order)), 0))
    later = np.empty(len(order), bool)
    later[order] = (d[order] != d[order][lead]) | (p[order] != p[order][lead])
    # maximal runs of later starts within a phrase
    open_ = later & np.r_[True, ~later[:-1] | (who[1:] != who[:-1])]
    close = later & np.r_[~later[1:] | (who[1:] != who[:-1]), True]
    kinds = (pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(v).cast(k) for v, k in zip((rid[who[open_]], p[open_], p[close]), kinds)], ["rid", "first", "last"])


def _ordered(batches):
    """Repeats among the phrases of each trigger, from phrases sorted by trigger; whole groups are put in order together."""
    wait, size = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if size > ORDERED_BYTES and row[0] != wait[-1][0]:
                yield _repeats(wait)
                wait, size = [], 0
            wait.append(row)
            size += len(row[5])
    if wait:
        yield _repeats(wait)


def _strings(batches):
    """Each string of some phrases with its place."""
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
    for b in batches:
        for _, doc, rid, first, last, phrase in zip(*(c.to_pylist() for c in b.columns)):
            n = last - first + 1
            columns = [[phrase[i : i + LENGTH] for i in range(n)], [doc] * n, [rid] * n, range(first, last + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], ["string", "doc", "rid", "p"])


def _cut(batches):
    """Kept text of documents from the starts of their repeats."""
    for b in batches:
        rows = []
        for rid, x, places in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
            spans: list[list[int]] = []
            for p in sorted((p["first"], p["last"]) for p in places):
                if spans and p[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], p[1] + LENGTH)
                else:
                    spans.append([p[0], p[1] + LENGTH])
            kept, at = hashlib.sha256(), 0
            for a, z in spans:
                kept.update(x[at:a])
                at = z
            kept.update(x[at:])
            rows.append((rid, sum(z - a for a, z in spans), [{"start": a, "stop": z} for a, z in spans], kept.hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 4
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, (pa.int64(), pa.int64(), span, pa.string()))], ["rid", "n", "spans", "sha"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The bytes of each text that a string of LENGTH bytes covers which also starts earlier.

    Earlier: in a document with a smaller doc_id, or at an earlier start of the same; a null doc_id is after
    all others. docs: doc_id, text (other columns are ignored). A null text counts as empty; texts under LENGTH bytes lose nothing. Of
    rows that repeat a doc_id none is earlier than another at the same start. Returns a row per row: doc_id,
    n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes of the removed runs). An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    source = numbered(docs.select("doc_id", "text"), "rid", "rows").select("rid", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "text", "doc_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt = source.select("rid", "doc", "text").mapInArrow(_deal(buckets), "bucket int, records binary, known binary")
    found = dealt.repartition(buckets, "bucket").mapInArrow(_match, "rid long, first int, last int, core long")
    place = F.struct("first", "last", "core")
    lists = found.groupBy("rid").agg(
        F.collect_list(F.when(F.col("core").isNull(), F.struct("first", "last"))).alias("repeats"), F.collect_list(F.when(F.col("core").isNotNull(), place)).alias("several")
    )
    lists = written(lists, "phrases")
    open_ = lists.filter(F.size("several") > 0).select("rid", "several")
    texts = join_small_or_shuffled(source, open_.select("rid"), "rid", "left_semi", F.lit(16))
    phrases = texts.join(open_, "rid").select("rid", "doc", "text", "several").mapInArrow(_suffixes, "core long, doc long, rid long, first int, last int, phrase binary")
    phrases = written(phrases, "dictionary")
    size = phrases.agg(F.sum(F.length("phrase"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    large = written(phrases.groupBy("core").count().filter(F.col("count") > GROUP).select("core"), "large-groups")
    few = join_small_or_shuffled(phrases, large, "core", "left_anti", F.lit(16)).repartition(tasks, "core").sortWithinPartitions("core")
    runs = few.mapInArrow(_ordered, "rid long, first int, last int")
    strings = join_small_or_shuffled(phrases, large, "core", "left_semi", F.lit(16)).select(*phrases.columns).mapInArrow(_strings, "string binary, doc long, rid long, p int")
    # written, so that the join below deals both sides out and can split a string that is common
    least = written(strings.groupBy("string").agg(F.min(F.struct("doc", "p")).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least-places")
    later = strings.join(least, "string").filter(F.struct("doc", "p") > F.col("least")).select("rid", F.col("p").alias("first"), F.col("p").alias("last"))
    runs = runs.unionByName(later).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    both = lists.select("rid", "repeats").join(runs, "rid", "left")
    places = F.concat("repeats", F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")))
    both = written(both.select("rid", places.alias("places")).filter(F.size("places") > 0), "repeats")
    texts = join_small_or_shuffled(source.select("rid", "text"), both.select("rid"), "rid", "left_semi", F.lit(16))
    cut = texts.join(both, "rid").select("rid", "text", "places").mapInArrow(_cut, "rid long, n long, spans array<struct<start:long,stop:long>>, sha string")
    all_ = source.select("rid", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("whole"))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    return all_.join(cut, "rid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"),
        F.size(F.coalesce("spans", none)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"),
    )
