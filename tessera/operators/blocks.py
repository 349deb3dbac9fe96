"""Operators on blocks: histogram, classification, neighbourhoods, model overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blockstats import STATS, histograms, with_statistics
from ..functions.labels import TYPES, anomalous, classified, override
from ..sources.sinks import small, written

STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
#: Blocks beyond that many candidates: only the suspicious ones, in order of id.
CANDIDATE_CAP = 50_000


def byte_histogram(blocks: DataFrame) -> DataFrame:
    """image_id, block_id, byte, cnt of the bytes that occur in each block; a block's counts need no other row, so no shuffle."""
    return histograms(blocks.select("image_id", "block_id", "data"))


def byte_statistics(blocks: DataFrame, *keys: str) -> DataFrame:
    """n_bytes, kinds (of bytes), entropy and zero_ratio of all bytes of each group of blocks, by default of each image.

    Histograms of blocks add up before and after the shuffle, at most 256 rows a group from each task; no bytes are shuffled.
    """
    keys = keys or ("image_id",)
    h = histograms(blocks.select("image_id", "block_id", "data"))
    if set(keys) - {"image_id", "block_id"}:
        h = h.join(blocks.select("image_id", "block_id", *(k for k in keys if k not in ("image_id", "block_id"))), ["image_id", "block_id"])
    c = h.groupBy(*keys, "byte").agg(F.sum("cnt").alias("c"))
    g = c.groupBy(*keys).agg(F.sum("c").alias("n_bytes"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log2("c")).alias("s"), F.coalesce(F.sum(F.when(F.col("byte") == 0, F.col("c"))), F.lit(0)).alias("zeros"))
    return g.select(*keys, "n_bytes", "kinds", (F.log2("n_bytes") - F.col("s") / F.col("n_bytes")).alias("entropy"), (F.col("zeros") / F.col("n_bytes")).alias("zero_ratio"))


def classify(blocks: DataFrame) -> DataFrame:
    """Label, confidence and statistics of every block, in one pass without a shuffle."""
    s = with_statistics(blocks)
    label = classified({c: F.col(c) for c in STAT_NAMES})
    return s.withColumn("c", label).select("image_id", "block_id", "offset", "c.*", *STAT_NAMES)


def candidates(labelled: DataFrame, reach: int = 2) -> DataFrame:
    """Suspicious blocks and those within reach of one; ids may have gaps.

    Each suspicious block is sent to the places around it, at most 2 * reach + 1 small rows, so no window over
    a whole image is needed.
    """
    near = labelled.filter("is_suspicious").select("image_id", F.explode(F.sequence(F.col("block_id") - reach, F.col("block_id") + reach)).alias("block_id")).distinct()
    return labelled.join(near, ["image_id", "block_id"], "left_semi")


def capped_candidates(labelled: DataFrame, cap: int = CANDIDATE_CAP, reach: int = 2) -> DataFrame:
    """The candidates of each image; of an image with more than cap only suspicious blocks, the first cap by id.

    Candidates are counted by stretch of an image. Sums over the stretches before say which are kept whole and in
    which one the cap falls, so ranks are of blocks within a stretch and no image is ever in one place.
    """
    found = written(candidates(labelled, reach).withColumn("stretch", F.call_function("shiftright", "block_id", F.lit(16))), "candidates")
    before = Window.partitionBy("image_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = found.groupBy("image_id", "stretch").agg(F.count("*").alias("n"), F.count_if("is_suspicious").alias("s"))
    per = per.withColumns({"few": F.sum("n").over(Window.partitionBy("image_id")) <= cap, "room": cap - F.coalesce(F.sum("s").over(before), F.lit(0))})
    per = per.filter("few or (room > 0 and s > 0)").select("image_id", "stretch", "few", "room", (F.col("s") > F.col("room")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("image_id", "stretch").orderBy("block_id"))
    j = found.join(small(per), ["image_id", "stretch"]).filter("few or is_suspicious")
    inside = j.filter("few or not cut").drop("cut", "room", "few", "stretch")
    last = j.filter("not few and cut").withColumn("rank", rank).filter("rank <= room").drop("cut", "room", "few", "stretch", "rank")
    return inside.unionByName(last)


def apply_model(labelled: DataFrame, predicted: DataFrame) -> DataFrame:
    """labelled (image_id, block_id, wipe_type, confidence, is_suspicious, entropy) with a model's labels taken in.

    predicted: image_id, block_id, ml_label, ml_confidence; blocks without a prediction stay as they are.
    """
    j = labelled.join(predicted, ["image_id", "block_id"], "left")
    over = F.coalesce(override(F.col("wipe_type"), F.col("ml_label"), F.col("ml_confidence")), F.lit(False))
    odd = F.col("ml_label").isNotNull() & anomalous(F.col("wipe_type"), F.col("entropy"), F.col("ml_override"))
    j = j.withColumn("ml_override", over).withColumn("promoted", odd)
    final = F.when(F.col("ml_override"), F.col("ml_label")).when(F.col("promoted"), "RANDOM_WIPE").otherwise(F.col("wipe_type"))
    sure = F.when(F.col("ml_override"), F.col("ml_confidence")).when(F.col("promoted"), F.greatest("ml_confidence", F.lit(0.55))).otherwise(F.col("confidence"))
    return j.select(
        "image_id",
        "block_id",
        F.col("wipe_type").alias("base_label"),
        final.alias("wipe_type"),
        sure.alias("confidence"),
        final.isin(TYPES).alias("is_suspicious"),
        "entropy",
        (F.col("ml_override") | F.col("promoted")).alias("ml_override"),
    )


def ml_summary(applied: DataFrame) -> DataFrame:
    """image_id, blocks_analyzed, overrides, false_positive_reductions."""
    return applied.groupBy("image_id").agg(
        F.count("*").alias("blocks_analyzed"),
        F.count_if("ml_override").alias("overrides"),
        F.count_if(F.col("ml_override") & F.col("base_label").isin(TYPES) & ~F.col("is_suspicious")).alias("false_positive_reductions"),
    )
