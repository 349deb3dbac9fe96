"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into a high and a low segment of 32 bits. Of two fingerprints at most two bits apart, either
the high segments are at most one bit apart or the low segments are equal. So every fingerprint is in two tables, by
its high and by its low segment, and looks up the Hamming ball of radius one around its high segment in the first
and its low segment in the second; whole distances are then verified. A ball is only walked upwards, from a bit that
is 0 to 1, since the other fingerprint of a pair walks the rest.

Only different fingerprints are looked up, each once, however many texts have it. A segment that more than CROWD
fingerprints share, or that those reach, gets keys of a second level from the other segment. Two fingerprints with the
same first segment both have the ball of radius one around their other one; where the first differs in a bit, one
has the ball and the other its segment itself. Two that may match share one of these keys, and such a key holds at
most 33 * 33 fingerprints, so no bucket grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small_or_shuffled, slices, text_bytes, written
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints that may share a segment before it gets keys of a second level.
CROWD = 256
#: Shingles whose bits are counted at once.
STRETCH = 1 << 16
#: A-Z lower-cased, white space to spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each run of SHINGLE words joined by spaces; of all words where there are fewer; none without words."""
    b = np.frombuffer(text := text.translate(NORMAL), np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[False, b != 32, False]))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    width, hashed = min(SHINGLE, len(start)), xxhash.xxh64_intdigest
    firsts, lasts = start[: len(start) - width + 1], end[width - 1 :]
    spaced = (lasts - firsts) == sum(end[k : k + len(firsts)] - start[k : k + len(firsts)] for k in range(width)) + width - 1
    out = np.fromiter((hashed(text[i:j], SEED) for i, j in zip(firsts.tolist(), lasts.tolist())), np.uint64, len(firsts))
    for k in np.flatnonzero(~spaced).tolist():  # words with more than one space between them
        out[k] = hashed(b" ".join(text[firsts[k] : lasts[k]].split()), SEED)
    return out


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STRETCH):
        part = hashes[at : at + STRETCH].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the fingerprint's 64 bits as a long) of each row of docs (doc_id, text)."""

    def run(batches):
        for b in (part for batch in batches for part in slices(batch, 1)):
            prints = np.array([fingerprint_of(shingle_hashes(t)) for t in text_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


def _bits(*before: int):
    """An array of the numbers before, -1, and those of a segment's bits."""
    return F.array(*map(F.lit, [*before, -1, *range(32)]))


def _mask(bit: str):
    """The bit as a long; 0 for negative numbers."""
    return F.when(F.col(bit) < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit)))


def _lookups(prints: DataFrame) -> DataFrame:
    """side, key, own (whether it is the print's own segment), other, print: where each print is looked up."""
    rows = prints.select("print", F.shiftrightunsigned("print", 32).alias("high"), F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.explode(_bits(-2)).alias("bit"))
    rows = rows.withColumn("mask", _mask("bit")).filter(F.col("high").bitwiseAND(F.col("mask")) == 0)
    low = F.col("bit") == -2
    key, other = F.when(low, F.col("low")).otherwise(F.col("high").bitwiseXOR(F.col("mask"))), F.when(low, F.col("high")).otherwise(F.col("low"))
    return rows.select(low.cast("int").alias("side"), key.alias("key"), (F.col("bit") < 0).alias("own"), other.alias("other"), "print")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """u, v: pairs of the different values of print that are at most RADIUS bits apart, each at least once."""
    asked = _lookups(prints)
    crowded = _crowded(written(asked.filter("own").groupBy("side", "key").agg(F.count("*").alias("n")), "segments"), crowd)
    rows = join_small_or_shuffled(asked, crowded, ["side", "key"], "left", F.lit(16)).filter("full is null or full")
    steps = F.when(F.col("full") & F.col("own"), _bits(-2)).when(F.col("full"), _bits()).otherwise(F.array(F.lit(-3)))
    rows = rows.select("side", "key", "own", "print", "other", F.explode(steps).alias("bit"))
    kind = F.when(F.col("bit") == -3, 0).when(F.col("own") & (F.col("bit") > -2), 2).otherwise(1)
    near = F.when(F.col("bit") == -3, F.lit(-1).cast("long")).otherwise(F.col("other").bitwiseXOR(_mask("bit")))
    rows = rows.select("side", "key", "own", "print", kind.alias("kind"), near.alias("near"))
    on = ["side", "key", "kind", "near"]
    a, b = rows.filter("own").select(*on, F.col("print").alias("u")), rows.select(*on, F.col("print").alias("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    return a.join(b, on).filter((F.col("u") != F.col("v")) & close).select("u", "v")


def _crowded(segments: DataFrame, crowd: int) -> DataFrame:
    """side, key, full of the segments that many fingerprints have or ask for: full if they get a second level, else no fingerprint has them.

    segments: side, key, n. Besides a segment that over crowd fingerprints have, those that they reach upwards.
    """
    hot = segments.filter(F.col("n") > crowd).select("side", "key")
    reached = hot.filter("side = 0").select("side", "key", F.explode(_bits()).alias("bit")).withColumn("mask", _mask("bit")).filter(F.col("key").bitwiseAND(F.col("mask")) == 0)
    around = written(hot.unionByName(reached.select("side", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))).distinct(), "around")
    there = join_small_or_shuffled(segments, around, ["side", "key"], "left_semi", F.lit(16)).select("side", "key", F.lit(True).alias("full"))
    return written(around.join(there, ["side", "key"], "left").withColumn("full", F.coalesce("full", F.lit(False))), "crowded")


def _join_crowded(rows: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """rows join found (key, n: its number of rows, value): no key's rows come together if they are many.

    Keys of more than one row in 65,536, so at most 65,536 of them, are broadcast; the others spread over a shuffle.
    """
    many = ((found.agg(F.sum("n")).first()[0] or 0) >> 16) + 1
    hot = F.broadcast(found.filter(F.col("n") > many).select(key, F.col(value).alias("hot_value"), F.lit(True).alias("hot")))
    rows = rows.join(hot, key, "left")
    rest = join_small_or_shuffled(rows.filter("hot is null").drop("hot", "hot_value"), found.filter(F.col("n") <= many).drop("n"), key, "inner", F.lit(24))
    return rows.filter("hot").drop("hot").withColumnRenamed("hot_value", value).unionByName(rest)


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (doc_id, text; others are ignored).

    Rows are linked when their fingerprints are at most RADIUS bits apart; component_id is the smallest doc_id that
    links reach, the row's own included. Texts that are null, empty or without a word have the fingerprint 0 and are
    linked like any other. Repeated rows and rows that share a doc_id are rows of their own, with a result each; a
    row with a null doc_id links like others, and a component of such rows alone has a null component_id. Ties can't
    change a result. An empty table gives no rows. A text and a component may be of any size.
    """
    rows = written(fingerprints(docs), "prints")
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "values")
    parts = components(links(prints.select("print"), crowd)).withColumnRenamed("node", "print")
    labelled = written(join_small_or_shuffled(prints, parts, "print", "left", F.lit(16)), "labels")
    linked = labelled.filter("label is not null")
    least = written(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    found = _join_crowded(linked.withColumnRenamed("n", "rows"), least, "label", "component_id").select("print", F.col("rows").alias("n"), "component_id")
    alone = labelled.filter("label is null").select("print", "n", F.col("least").alias("component_id"))
    all_ = _join_crowded(rows, written(found.unionByName(alone), "components"), "print", "component_id")
    return all_.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
