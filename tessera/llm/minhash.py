"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

Darts are a Poisson process over shingle x weight x rank, drawn by hashing, so that two documents see the
same darts. The weight axis is cut into the regions [0,1), [1,2), [2,4) ...; a region throws its darts in
order of rank, and those under the shingle's weight count. Each dart belongs to one of K coordinates; the
earliest dart of each coordinate is the signature, and two signatures agree in a coordinate with a
probability equal to the weighted Jaccard similarity. About K ln K darts are drawn per document, however long.

Signatures are cut into bands. A band's bucket is linked to its smallest document; the pairs' true
similarity is then computed from the texts. Other documents of one bucket that are still in different
components after that are compared inside tasks, those outside a bucket's largest component with all, by an
index of shingles; one link to each component that a document is similar to comes out. So no link that a
bucket shows is lost, and no group is expanded into rows of pairs. A large bucket is cut into blocks of both
sides.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, join_small_or_shuffled, marked, slices, text_bytes, without, written
from .components import components
from .shingles import counted, mix, shingle_hashes, weighted_jaccard, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Coordinates of a signature, and how seldom a pair at the threshold may share no band.
COORDINATES, MISSED = 125, 1 / 20_000
#: Shingles, and documents, of one side of a bucket that meet in one task, about.
UNITS, BLOCK = 1 << 18, 500
#: Documents are thrown at together until they have so many shingles.
AT_ONCE = 100_000


def bands_of(threshold: float, k: int = COORDINATES) -> tuple[int, int]:
    """(bands, coordinates of each): the longest bands that miss a pair at the threshold at most MISSED of the time.

    At a similarity of 0.8 these are 25 bands of 5.
    """
    rows = max((r for r in range(1, k + 1) if (1 - threshold**r) ** (k // r) <= MISSED), default=1)
    return k // rows, rows


def estimate_of(threshold: float, k: int) -> float:
    """Pairs whose signatures agree in a smaller share are not verified: 5 standard errors below the threshold."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / k)


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(weighted: list[tuple[np.ndarray, np.ndarray]], k: int, spread: float = 3.0) -> np.ndarray:
    """Signatures (uint32, k columns) of weighted sets (elements, weights); of an empty set zeros.

    spread: how many more darts than ln k per coordinate are expected; sets with an empty coordinate are
    thrown at again with twice as many.
    """
    best = np.full(len(weighted) * k, np.inf)
    sig = np.zeros(len(weighted) * k, np.uint32)
    owner = np.repeat(np.arange(len(weighted)), [len(e) for e, _ in weighted])
    element = np.concatenate([e for e, _ in weighted]) if len(weighted) else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in weighted]).astype(np.float64) if len(weighted) else np.zeros(0)
    total = np.bincount(owner, weight, len(weighted))
    limit = k * (np.log(k) + spread) / np.maximum(total, 1)
    low, width, region = 0.0, 1.0, 1
    while True:
        inside = np.flatnonzero(weight > low)
        if not len(inside):
            break
        rank, own, top = np.zeros(len(inside)), owner[inside], limit[owner[inside]]
        over = weight[inside]
        h = mix(element[inside] + np.uint64(region * 0x9E3779B97F4A7C15 % 2**64))
        while len(h):
            h = mix(h + np.uint64(0xD1B54A32D192ED03))
            rank = rank - np.log(_unit(h)) / width
            on = rank <= top
            h, rank, own, top, over = h[on], rank[on], own[on], top[on], over[on]
            dart = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
            under = low + width * _unit(mix(dart)) <= over if width > 1 else slice(None)
            d, r = dart[under], rank[under]
            place = own[under] * k + ((d >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            was = best[place]
            nearer = r < was
            d, r, place = d[nearer], r[nearer], place[nearer]
            np.minimum.at(best, place, r)
            won = r == best[place]
            sig[place[won]] = d[won].astype(np.uint32)
        low, width, region = low + width, 1.0 if region == 1 else width * 2, region + 1
    sig, best = sig.reshape(-1, k), best.reshape(-1, k)
    again = np.flatnonzero(np.isinf(best).any(1) & (total > 0))
    if len(again):
        sig[again] = signatures([weighted[i] for i in again], k, spread * 2 + np.log(k))
    return sig


def _sign(k: int):
    def run(batches):
        for b in (part for b in batches for part in slices(b, 1)):
            texts, ids = text_bytes(b.column(1)), b.column(0)
            keys, sizes, sigs, wait = [], [], [], []

            def throw():
                sigs.extend(row.tobytes() for row in signatures(wait, k))
                wait.clear()

            held = 0
            for _, docs in word_hashes(texts):
                for w in docs:
                    s = counted(shingle_hashes(w, SHINGLE))
                    keys.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                    sizes.append(int(s[1].sum()))
                    wait.append(s)
                    held += len(s[0])
                    if held > AT_ONCE:
                        throw()
                        held = 0
            throw()
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "key", "n", "sig"])

    return run


def _band(bands: int, rows: int):
    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
            for j in range(rows):
                h = mix(h + sig[:, :, j])
            node = np.repeat(np.asarray(b.column(0)), bands)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(node)], ["h", "node"])

    return run


def _agree(least: float):
    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            like = (x == y).mean(1) >= least if b.num_rows else np.zeros(0, bool)
            yield b.select(["a", "b"]).filter(pa.array(like))

    return run


def _similar(threshold: float):
    def run(batches):
        last, kept = None, None
        for b in batches:
            out = []
            for a, x, y in zip(b.column("a").to_pylist(), text_bytes(b.column("text_a")), text_bytes(b.column("text_b"))):
                if a != last:
                    last, kept = a, _shingles(x)
                out.append(weighted_jaccard(kept, _shingles(y)))
            like = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), like], ["a", "b", "similarity"]).filter(pa.array([s >= threshold for s in out], pa.bool_()))

    return run


def _shingles(text: bytes):
    return counted(shingle_hashes(next(word_hashes([text]))[1][0], SHINGLE))


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, k: int) -> DataFrame:
    """a, b, similarity of the pairs (a, b) whose weighted Jaccard similarity is at least the threshold."""
    x = reps.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    y = reps.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    likely = pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agree(estimate_of(threshold, k)), "a long, b long").distinct()
    likely = written(likely, "likely")
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    texts = join_small_or_shuffled(docs, wanted, "doc_id", "left_semi", F.lit(16))
    with_b = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    full = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(freeing(_similar(threshold)), "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes of documents linked by a weighted Jaccard similarity of five-word shingles of at least threshold.

    docs: doc_id, text (other columns are ignored). Words are runs of letters and digits, A-Z lower-cased. A
    text of fewer than five words is one shingle; texts without a word (null ones too) are one class.
    Returns a row per row: doc_id, class_id (the smallest doc_id of its class), class_size (rows), is_kept (the
    row's doc_id is class_id). Rows that repeat a doc_id are in one class. A row with a null doc_id is
    compared with none: class_id null, class_size 1, is_kept true. An empty table gives no rows.
    """
    source = docs.select("doc_id", "text")
    known = source.filter("doc_id is not null")
    bands, rows = bands_of(threshold)
    k = bands * rows
    signed = written(known.mapInArrow(freeing(_sign(k)), "doc_id long, key binary, n long, sig binary"), "signatures")
    # this table and those below are written, so that joins with them deal both sides out and can split a large key
    same = written(signed.groupBy("key").agg(F.min("doc_id").alias("node")), "texts")
    reps = signed.filter("n > 0").withColumnRenamed("doc_id", "node").join(same, ["key", "node"], "left_semi")
    reps = written(reps.select("node", "n", "sig"), "representatives")
    banded = reps.select("node", "sig").mapInArrow(_band(bands, rows), "h long, node long")
    leaders = banded.groupBy("h").agg(F.min("node").alias("leader"), F.count("*").alias("m")).filter("m > 1")
    crowded = written(banded.join(written(leaders.drop("m"), "leaders"), "h"), "buckets")
    tested = written(crowded.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    twice = signed.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("doc_id")
    own = signed.select("doc_id", "key").join(twice, "doc_id", "left_semi").join(same, "key").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = written(verified(tested, reps, known, threshold, k).select("a", "b").unionByName(own).distinct(), "links")
    labels = written(components(links), "labels")
    more = written(_across(crowded, labels, reps, known, threshold), "more-links")
    if not more.isEmpty():
        labels = written(components(links.unionByName(more)), "labels")
    classed = (
        signed.select("doc_id", "key")
        .join(same, "key")
        .join(labels, "node", "left")
        .select("doc_id", F.coalesce("label", "node").alias("class_id"))
    )
    sizes = written(classed.groupBy("class_id").agg(F.count("*").alias("class_size")), "class-sizes")
    found = classed.join(sizes, "class_id").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("is_kept"))
    lone = source.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("is_kept"))
    return found.unionByName(lone)


def _units(batches):
    """Sorted hashes of the shingles of each document, one for each time that a shingle occurs."""
    for b in (part for b in batches for part in slices(b, 1)):
        out = []
        for x in text_bytes(b.column(1)):
            e, n = _shingles(x)
            again = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.sort(mix(np.repeat(e, n) + again.astype(np.uint64))).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["node", "units"])


def _links_of(few: list[tuple], all_: list[tuple], threshold: float) -> list[tuple]:
    """(a, b): for each of few (node, label, units) its most similar of all_ in each other component that reaches the threshold."""
    units = [np.frombuffer(u, np.uint64) for _, _, u in all_]
    size = np.array([len(u) for u in units])
    owner, unit = np.repeat(np.arange(len(units)), size), np.concatenate(units)
    order = np.argsort(unit, kind="stable")
    owner, unit = owner[order], unit[order]
    label = np.array([x for _, x, _ in all_])
    out = []
    for node, own, u in few:
        u = np.frombuffer(u, np.uint64)
        lo, hi = np.searchsorted(unit, u, "left"), np.searchsorted(unit, u, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], minlength=len(units))
        like = both / (len(u) + size - both)
        near = np.flatnonzero((like >= threshold) & (label != own))
        best: dict[int, int] = {}
        for i in near[np.argsort(-like[near], kind="stable")].tolist():
            best.setdefault(int(label[i]), i)
        out += [(min(node, all_[i][0]), max(node, all_[i][0])) for i in best.values()]
    return out


def _compare(threshold: float):
    """Links of the groups (h, i, j) of sorted rows: side 0 is compared with side 1."""

    def run(batches):
        now, sides = None, ([], [])
        for b in batches:
            out = []
            for h, i, j, side, node, label, units in zip(*(c.to_pylist() for c in b.columns)):
                if (h, i, j) != now:
                    if all(sides):
                        out += _links_of(*sides, threshold)
                    now, sides = (h, i, j), ([], [])
                sides[side].append((node, label, units))
            yield _pairs(out)
        yield _pairs(_links_of(*sides, threshold) if all(sides) else [])

    return run


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _across(crowded: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links between the components in one bucket; the bucket's leader has been compared with all already."""
    placed = crowded.filter("node <> leader").select("h", "node").join(labels, "node", "left").select("h", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h")
    placed = placed.join(written(mixed, "mixed"), "h", "left_semi").join(reps.select("node", "n"), "node")
    placed = written(placed.select("h", "node", "label", "n"), "mixed-buckets")
    size = placed.groupBy("h", "label").agg(F.count("*").alias("m"), F.sum("n").alias("u"))
    sizes = size.groupBy("h").agg(F.max_by(F.struct("label", "m", "u"), F.struct("m", "label")).alias("most"), F.sum("m").alias("m"), F.sum("u").alias("u"))
    blocks = lambda m, u: F.ceil(F.greatest(m / BLOCK, u / UNITS)).cast("int")
    few = blocks(F.col("m") - F.col("most.m"), F.col("u") - F.col("most.u"))
    sizes = sizes.select("h", F.col("most.label").alias("largest"), few.alias("ni"), blocks(F.col("m"), F.col("u")).alias("nj"))
    rows = placed.join(written(sizes, "bucket-sizes"), "h")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    few = rows.filter("label <> largest").select("h", block("ni").alias("i"), each("nj").alias("j"), F.lit(0).alias("side"), "node", "label")
    all_ = rows.select("h", each("ni").alias("i"), block("nj").alias("j"), F.lit(1).alias("side"), "node", "label")
    wanted = placed.select(F.col("node").alias("doc_id")).distinct()
    texts = join_small_or_shuffled(docs, wanted, "doc_id", "left_semi", F.lit(16))
    units = texts.select("doc_id", "text").mapInArrow(freeing(_units), "node long, units binary")
    met = few.unionByName(all_).join(units, "node").select("h", "i", "j", "side", "node", "label", "units")
    return met.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "side").mapInArrow(freeing(_compare(threshold)), "a long, b long").distinct()


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each class of near duplicates.

    Rows are compared and dropped by a mark of their own, so those with a null or repeated doc_id are too. Of a
    class the row with the smallest doc_id stays (a null one last); of rows that repeat it one.
    """
    rows, mark = marked(docs)
    near = near_duplicates(rows.select(F.col(mark).alias("doc_id"), "text"), threshold).filter("class_size > 1")
    near = near.select(F.col("doc_id").alias("mark"), "class_id")
    near = written(near.join(rows.select(F.col(mark).alias("mark"), "doc_id"), "mark"), "near-classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "mark"))
    stays = near.groupBy("class_id").agg(best.alias("best")).select(F.col("best.mark").alias("mark"))
    gone = near.select("mark").join(stays, "mark", "left_anti").select(F.col("mark").alias(mark))
    return without(rows, gone, mark, "near-copies").select(docs.columns)
