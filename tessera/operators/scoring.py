"""Evidence score of an image from its labelled blocks and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import PARTIAL, STRONG, TYPES

# Fixed values.
LEVELS = ["NEGLIGIBLE", "LOW", "MEDIUM", "HIGH"]
FILLS = ["ZERO_WIPE", "FF_WIPE", "LIKELY_ZERO_WIPE", "LIKELY_FF_WIPE"]


def block_stats(labelled: DataFrame) -> DataFrame:
    """A row per image: counts, share, mean entropy of suspicious blocks, and a count of each type."""
    s = F.col("is_suspicious")
    return labelled.groupBy("image_id").agg(
        F.count("*").alias("total_blocks"),
        F.count_if(s).alias("suspicious_blocks"),
        F.coalesce(F.avg(F.when(s, F.col("entropy"))), F.lit(0.0)).alias("avg_entropy_flagged"),
        *(F.count_if(s & (F.col("wipe_type") == t)).alias(f"n_{t}") for t in TYPES),
    )


def stats_of_runs(parts: DataFrame) -> DataFrame:
    """block_stats of blocks that are summed up in runs (see regions.stretch_runs)."""
    s = F.col("is_suspicious")
    return parts.groupBy("image_id").agg(
        F.sum("n").alias("total_blocks"),
        F.coalesce(F.sum(F.when(s, F.col("n"))), F.lit(0)).alias("suspicious_blocks"),
        F.coalesce(F.try_divide(F.sum(F.when(s, F.col("sum_entropy"))), F.sum(F.when(s, F.col("n")))), F.lit(0.0)).alias("avg_entropy_flagged"),
        *(F.coalesce(F.sum(F.when(s, F.col(f"c_{t}"))), F.lit(0)).alias(f"n_{t}") for t in TYPES),
    )


def type_histogram(stats: DataFrame) -> DataFrame:
    """image_id, type_counts: a map with all seven keys."""
    return stats.select("image_id", F.create_map(*(x for t in TYPES for x in (F.lit(t), F.col(f"n_{t}")))).alias("type_counts"))


def region_stats(regions: DataFrame) -> DataFrame:
    """A row per image with regions: sizes, counts by kind, and the type with most blocks (of equal ones the earliest)."""
    far = F.col("boundary_context") == "BEYOND_BOUNDARY"
    gone = far & F.col("type").isin(FILLS)
    by_type = regions.groupBy("image_id", "type").agg(
        F.count("*").alias("n"), F.count_if(~gone).alias("effective"), F.count_if(far).alias("beyond"), F.coalesce(F.sum(F.when(gone, F.col("n_susp"))), F.lit(0)).alias("excluded"),
        F.sum("confidence").alias("confidence"), F.sum("block_count").alias("b"), F.min("id").alias("i"), F.max(F.struct("size", -F.col("id"))).alias("largest"), F.sum("size").alias("size"),
        F.max(F.col("boundary_context") != "UNKNOWN").alias("has_map"),
    )
    of = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0))
    out = by_type.groupBy("image_id").agg(
        F.sum("n").alias("regions_count"),
        F.sum("effective").alias("effective_regions"),
        F.sum("beyond").alias("beyond_regions"),
        F.sum("excluded").alias("excluded_blocks"),
        of("RANDOM_WIPE").alias("random_regions"),
        of("MULTI_PASS").alias("multi_regions"),
        (F.sum("confidence") / F.sum("n")).alias("mean_confidence"),
        F.sum("b").alias("region_blocks"),
        F.max("largest").alias("largest"),
        (F.sum("size") / F.sum("n")).alias("avg_region_size"),
        F.max("has_map").alias("has_map"),
        F.max_by("type", F.struct("b", -F.col("i"))).alias("dominant_type"),
    )
    return out.withColumns({"largest_region_id": -F.col("largest")["col2"], "largest_region_size": F.col("largest.size")}).drop("largest")


def density_floor(density: Column, suspicious: Column) -> Column:
    """The verdict (as a number into LEVELS) that density alone gives."""
    return F.when(density > 0.30, 3).when(density > 0.10, 2).when(density > 0.02, 1).when(suspicious >= 2, 1).otherwise(0)


def points(pct: Column, effective: Column, random: Column, multi: Column) -> Column:
    one = F.lit(1.0)
    return 40 * F.least(pct / 10, one) + 20 * F.least(effective / 10, one) + 25 * F.least(random / 3, one) + 15 * F.least(multi / 2, one)


def penalties(suspicious: Column, partial: Column, strong: Column, mean_confidence: Column, beyond: Column, regions: Column, has_map: Column) -> Column:
    share = F.try_divide(beyond, regions)  # null without regions
    return (
        F.when((suspicious > 0) & (partial > strong) & (strong < 10), 10).otherwise(0)
        + F.when(mean_confidence < 0.55, 5).otherwise(0)
        + F.when(has_map & (share > 0.6), 15).when(has_map & (share > 0.3), 7).otherwise(0)
    )


def level_of(score: Column) -> Column:
    return F.when(score >= 70, 3).when(score >= 35, 2).when(score >= 10, 1).otherwise(0)


def score(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """Scan statistics, intent score and verdict of each image; an image without blocks has no row."""
    return scored(block_stats(labelled), regions)


def scored(stats: DataFrame, regions: DataFrame) -> DataFrame:
    """score, from the statistics of the images' blocks."""
    s = stats.join(region_stats(regions), "image_id", "left")
    s = s.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("regions_count", "effective_regions", "beyond_regions", "excluded_blocks", "random_regions", "multi_regions", "region_blocks")})
    total = F.col("total_blocks")
    adjusted = F.greatest(F.col("suspicious_blocks") - F.col("excluded_blocks"), F.lit(0))
    strong, partial = sum((F.col(f"n_{t}") for t in STRONG), F.lit(0)), sum((F.col(f"n_{t}") for t in PARTIAL), F.lit(0))
    s = s.withColumn("adjusted_density", adjusted / total)
    raw = points(100 * F.col("adjusted_density"), F.col("effective_regions"), F.col("random_regions"), F.col("multi_regions"))
    less = penalties(F.col("suspicious_blocks"), partial, strong, F.col("mean_confidence"), F.col("beyond_regions"), F.col("regions_count"), F.coalesce("has_map", F.lit(False)))
    s = s.withColumns({"floor_level": density_floor(F.col("adjusted_density"), F.col("suspicious_blocks")), "points": raw, "penalty": less})
    s = s.withColumn("intent_score", F.greatest(F.least(F.bround(F.col("points") - F.col("penalty"), 0), F.lit(100.0)), F.lit(0.0)).cast("int"))
    names = F.array(*map(F.lit, LEVELS))
    verdict = F.element_at(names, F.greatest("floor_level", level_of(F.col("intent_score"))) + 1)
    return s.withColumns({"verdict": verdict, "suspicious_pct": 100 * F.col("suspicious_blocks") / total, "coverage_pct": 100 * F.col("region_blocks") / total})
