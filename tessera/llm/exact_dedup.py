"""Exact deduplication by deterministic block naming.

The text without white space is cut into blocks of a fixed size. Blocks are sorted into integer names; then
adjacent names are paired and the pairs sorted into new names, until one name stands for a document. Equal
names mean equal texts at every level, with no hashing of identities, so there is no collision to settle. A
block or pair that occurs once in the corpus proves its document unique: such a document leaves the rounds. So
does one with a block whose 64-bit hash occurs once; that takes out most blocks before any is shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, join_small_or_shuffled, marked, numbered, slices, text_bytes, without, written

BLOCK = 2048
#: Spark samples keys on the driver to cut their range into partitions: so much of a block, then its hash, so that
#: many blocks with one beginning are cut too.
PREFIX = 48
SPACES = b" \t\n\x0b\x0c\r"


def _facts(batches):
    for b in (part for b in batches for part in slices(b, 2)):
        bare = [x.translate(None, SPACES) for x in text_bytes(b.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(1),
                pc.fill_null(pc.utf8_length(b.column(2)), 0).cast(pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bare]),
            ],
            ["rid", "doc_id", "n_chars", "text_sha256"],
        )


def _blocks(size: int):
    def run(batches):
        for b in (part for b in batches for part in slices(b, 2)):
            rid, n, at, block = [], [], [], []
            for r, x in zip(b.column(0).to_pylist(), text_bytes(b.column(2))):
                x = x.translate(None, SPACES)
                parts = [x[i : i + size] for i in range(0, len(x), size)] or [b""]
                rid += [r] * len(parts)
                n += [len(parts)] * len(parts)
                at += range(len(parts))
                block += parts
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(block, pa.binary())],
                ["rid", "n", "at", "block"],
            )

    return run


def _names(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Integer names of the keys that occur more than once; they are cut into sorted ranges and sorted in each."""
    repeated = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
    dealt = [x for k in keys for x in ([F.substring(k, 1, PREFIX), F.xxhash64(k)] if k == "block" else [F.col(k)])]
    return written(repeated.repartitionByRange(*dealt).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), what)


def _regroup(named: DataFrame, what: str) -> DataFrame:
    """Documents all of whose parts have names, with the names in order."""
    whole = named.groupBy("rid", "n").agg(F.collect_list(F.struct("at", "name")).alias("parts")).filter(F.size("parts") == F.col("n"))
    return written(whole.select("rid", F.transform(F.array_sort("parts"), lambda p: p["name"]).alias("names")), what)


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """rid, level, name of each row whose text occurs more than once; docs: rid, doc_id, text."""
    rows = docs.mapInArrow(freeing(_blocks(block)), "rid long, n int, at int, block binary").withColumn("h", F.xxhash64("block"))
    again = written(rows.groupBy("h").count().filter("count > 1").select("h"), "block-hashes")
    rows = written(join_small_or_shuffled(rows, again, "h", "left_semi", F.lit(16)).drop("h"), "blocks")
    left = _regroup(rows.join(_names(rows, ["block"], "block-names"), "block").select("rid", "n", "at", "name"), "named")
    level, done = 0, []
    while True:
        done.append(left.filter(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        left = left.filter(F.size("names") > 1)
        if left.isEmpty():
            break
        level += 1
        half = F.expr(
            "transform(sequence(0, cast((size(names) - 1) div 2 as int)), i -> struct(names[2 * i] as a,"
            " if(2 * i + 1 < size(names), names[2 * i + 1], -1L) as b))"
        )
        pairs = left.select("rid", half.alias("half")).select("rid", F.size("half").alias("n"), F.posexplode("half").alias("at", "p"))
        pairs = pairs.select("rid", "n", "at", "p.a", "p.b")
        left = _regroup(pairs.join(_names(pairs, ["a", "b"], "pair-names"), ["a", "b"]).select("rid", "n", "at", "name"), "paired")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Groups of documents that are equal when white space ``[\\x20\\x09-\\x0D]`` is deleted.

    docs: doc_id, text (other columns are ignored). A null text counts as empty, and all empty texts are equal.
    Of a group the row with most code points stays, then the smallest doc_id (a null one last); of repeated rows one. Returns a row
    for each row: doc_id, keep_id, group_size, kept, text_sha256, rid. An empty table gives no rows.
    """
    return _groups_of(numbered(docs.select("doc_id", "text"), "rid", "rows").select("rid", "doc_id", "text"), block)


def _groups_of(rows: DataFrame, block: int) -> DataFrame:
    facts = rows.mapInArrow(freeing(_facts), "rid long, doc_id long, n_chars long, text_sha256 string")
    ids = identities(rows, block)
    # a row that stands alone gets a key of its own, so that such rows don't meet in one task
    all_ = facts.join(ids, "rid", "left").withColumns({"level": F.coalesce("level", F.lit(-1)), "name": F.coalesce("name", "rid")})
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("x"), "doc_id", "rid"))
    # written, so that the join below deals both sides out and can split a group that is large
    groups = written(facts.join(ids, "rid").groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return all_.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        "text_sha256",
        "rid",
    )


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs, all columns, with the row that stays of each group: exact_dedup's, whatever its doc_id."""
    rows, mark = marked(docs)
    gone = _groups_of(rows.select(F.col(mark).alias("rid"), "doc_id", "text"), block).filter("not kept").select(F.col("rid").alias(mark))
    return without(rows, gone, mark, "copies").select(docs.columns)
