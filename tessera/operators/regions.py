"""Regions of suspicious blocks.

Blocks are summarised to runs in stretches of an image, and runs to regions by scans that go along an image in two
passes (see segments). Every run knows the sums over all blocks before it; sums over gaps are differences of those.
What a step reads twice is a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import PARTIAL, STRONG, TYPES, round3
from ..sources.sinks import written
from . import segments
from .intervals import containing

# Fixed values.
MAX_GAP, MIN_BLOCKS, BAND_GAP, MIN_BANDS, NEAR, SELF_EVIDENT, BLOCK = 8, 16, 4, 3, 50, 64, 512
TYPE_ADJUST = {"ZERO_WIPE": 0.0, "FF_WIPE": -0.02, "RANDOM_WIPE": -0.04, "MULTI_PASS": -0.08, "LIKELY_ZERO_WIPE": -0.12, "LIKELY_FF_WIPE": -0.12, "LOW_ENTROPY_SUSPECT": -0.15}


def runs(labelled: DataFrame, bits: int = segments.BITS) -> DataFrame:
    """Maximal runs of blocks that are all suspicious, of any type, or all not.

    image_id, is_suspicious, first_block, last_block, n, sum_entropy, sum_confidence, dominant, and before_n,
    before_entropy, before_confidence: the sums over the image's blocks before the run. dominant: the most
    frequent type, of equally frequent ones the first to occur.
    """
    return joined_runs(stretch_runs(labelled, bits), bits)


#: Sums of a run that add up when runs are joined.
SUMS = ("n", "sum_entropy", "sum_confidence")


def stretch_runs(labelled: DataFrame, bits: int = segments.BITS) -> DataFrame:
    """The runs within each stretch: image_id, is_suspicious, first_block, last_block, SUMS, and for each type c_<type> blocks, the first of them f_<type>."""
    w = Window.partitionBy("image_id", "part").orderBy("block_id")
    b = labelled.withColumn("part", F.call_function("shiftright", "block_id", F.lit(bits)))
    b = b.withColumn("new", F.coalesce((F.col("is_suspicious") != F.lag("is_suspicious").over(w)).cast("int"), F.lit(1)))
    b = b.withColumn("run", F.sum("new").over(w))
    each = [F.count_if(F.col("wipe_type") == t).alias(f"c_{t}") for t in TYPES]
    at = [F.min(F.when(F.col("wipe_type") == t, F.col("block_id"))).alias(f"f_{t}") for t in TYPES]
    r = b.groupBy("image_id", "part", "run").agg(
        F.first("is_suspicious").alias("is_suspicious"),
        F.min("block_id").alias("first_block"),
        F.max("block_id").alias("last_block"),
        F.count("*").alias("n"),
        F.sum("entropy").alias("sum_entropy"),
        F.sum("confidence").alias("sum_confidence"),
        *each,
        *at,
    )
    return r.drop("part", "run")


def joined_runs(parts: DataFrame, bits: int = segments.BITS) -> DataFrame:
    """Runs (see runs) of those within stretches or other parts of an image, which come next to each other without overlaps."""
    sums = SUMS
    r = segments.islands(written(parts, "runs"), ["is_suspicious"], lambda a, b: a["is_suspicious"] == b["is_suspicious"], sums, bits)
    r = r.groupBy("image_id", "island").agg(
        F.first("is_suspicious").alias("is_suspicious"), F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"), F.min_by(F.struct(*(f"before_{c}" for c in sums)), "first_block").alias("before"),
        *(F.sum(c).alias(c) for c in (*sums, *(f"c_{t}" for t in TYPES))), *(F.min(f"f_{t}").alias(f"f_{t}") for t in TYPES),
    )
    most = F.array_max(F.array(*(F.struct(F.col(f"c_{t}").alias("c"), F.coalesce(-F.col(f"f_{t}"), F.lit(-(1 << 62))).alias("f"), F.lit(t).alias("t")) for t in TYPES)))
    return r.select(
        "image_id", "is_suspicious", "first_block", "last_block", *sums, F.when(F.col("is_suspicious"), most["t"]).alias("dominant"),
        F.col("before.before_n").alias("before_n"), F.col("before.before_sum_entropy").alias("before_entropy"), F.col("before.before_sum_confidence").alias("before_confidence"),
    )


def absorb(run: DataFrame, max_gap: int = MAX_GAP, bits: int = segments.BITS) -> DataFrame:
    """Suspicious runs of one type with gaps of at most max_gap blocks made one; the gaps' blocks belong to it.

    full_*: sums with all gaps. avg_entropy leaves out the blocks of the last gap. n_susp: suspicious blocks.
    """
    sums = (("n", "n"), ("entropy", "sum_entropy"), ("confidence", "sum_confidence"))
    carried = ["first_block", "last_block", "dominant", *(x for d, c in sums for x in (f"before_{d}", c))]
    goes_on = lambda a, b: (a["dominant"] == b["dominant"]) & (b["first_block"] - a["last_block"] - 1 <= max_gap)
    s = segments.islands(written(run.filter("is_suspicious"), "suspicious"), carried, goes_on, bits=bits)
    gaps = {f"gap_{d}": F.col(f"before_{d}") - F.col(f"prev.before_{d}") - F.col(f"prev.{c}") for d, c in sums}
    s = s.withColumns({k: F.when(~F.col("starts"), v) for k, v in gaps.items()})
    inner = [F.coalesce(F.sum(f"gap_{d}"), F.lit(0.0)).alias(f"in_{d}") for d in ("n", "entropy", "confidence")]
    last = F.max_by(F.struct("gap_n", "gap_entropy"), F.when(~F.col("starts"), F.col("first_block"))).alias("last_gap")
    g = s.groupBy("image_id", "island").agg(
        F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"), F.first("dominant").alias("wipe_type"),
        F.sum("n").alias("n_susp"), F.sum("sum_entropy").alias("own_entropy"), F.sum("sum_confidence").alias("own_confidence"), *inner, last,
    )
    count = F.col("n_susp") + F.col("in_n").cast("long")
    full_e = F.col("own_entropy") + F.col("in_entropy")
    return g.select(
        "image_id", "first_block", "last_block", "wipe_type", count.alias("block_count"), "n_susp",
        full_e.alias("full_entropy"), (F.col("own_confidence") + F.col("in_confidence")).alias("full_confidence"),
        ((full_e - F.coalesce("last_gap.gap_entropy", F.lit(0.0))) / (count - F.coalesce("last_gap.gap_n", F.lit(0)))).alias("avg_entropy"),
    )


def sized(regions: DataFrame, least: int = MIN_BLOCKS) -> DataFrame:
    return regions.filter(F.col("block_count") >= least)


def bands(regions: DataFrame, bits: int = segments.BITS) -> DataFrame:
    """Chains of at least MIN_BANDS neighbours of differing strong types with small gaps made one MULTI_PASS region.

    A chain is summed up; of a shorter one the first and the last region are all there is.
    """
    link = lambda a, b: (b["first_block"] - a["last_block"] - 1 <= BAND_GAP) & (b["wipe_type"] != a["wipe_type"]) & a["wipe_type"].isin(STRONG) & b["wipe_type"].isin(STRONG)
    names = ["first_block", "last_block", "wipe_type", "block_count", "n_susp", "full_entropy", "full_confidence", "avg_entropy"]
    r = segments.islands(written(regions.select("image_id", *names), "regions"), ["first_block", "last_block", "wipe_type"], link, bits=bits)
    one, sums = F.struct(*names), ("block_count", "n_susp", "full_entropy", "full_confidence")
    g = r.groupBy("image_id", "island").agg(F.count("*").alias("k"), F.min_by(one, "first_block").alias("a"), F.max_by(one, "first_block").alias("z"), *(F.sum(c).alias(c) for c in sums))
    whole = F.struct(F.col("a.first_block").alias("first_block"), F.col("z.last_block").alias("last_block"), F.lit("MULTI_PASS").alias("wipe_type"), *sums, (F.col("full_entropy") / F.col("block_count")).alias("avg_entropy"))
    pieces = F.when(F.col("k") >= MIN_BANDS, F.array(whole)).when(F.col("k") == 2, F.array("a", "z")).otherwise(F.array("a"))
    return g.select("image_id", F.explode(pieces).alias("r")).select("image_id", "r.*")


def with_support(regions: DataFrame, bits: int = segments.BITS) -> DataFrame:
    """regions with supported: strong, large, or within NEAR blocks of a strong region."""
    r = segments.nearest(written(regions, "bands"), F.col("wipe_type").isin(STRONG), bits)
    near = F.coalesce(F.col("last_before") >= F.col("first_block") - NEAR, F.lit(False)) | F.coalesce(F.col("first_after") <= F.col("last_block") + NEAR, F.lit(False))
    return r.withColumn("supported", ~F.col("wipe_type").isin(PARTIAL) | (F.col("block_count") >= SELF_EVIDENT) | near).drop("last_before", "first_after")


def suppress(regions: DataFrame, bits: int = segments.BITS) -> DataFrame:
    return with_support(regions, bits).filter("supported").drop("supported")


def suppressed(regions: DataFrame) -> DataFrame:
    """The regions that suppress() takes out."""
    return with_support(regions).filter("not supported").drop("supported")


def scored(regions: DataFrame) -> DataFrame:
    """regions with confidence: mean of the blocks', with terms for size, density and type, within 0 and 1."""
    adjust = F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_ADJUST.items() for x in kv)), F.col("wipe_type"))
    n = F.col("block_count")
    x = F.col("full_confidence") / n + 0.10 * F.least(n / 512, F.lit(1.0)) + 0.10 * (F.col("n_susp") / n - 0.5) + adjust
    return regions.withColumn("confidence", round3(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))))


def boundary_of(start: Column, end: Column, has_table: Column, last_end: Column) -> Column:
    """INSIDE_PARTITION, BEYOND_BOUNDARY (it starts after the last partition or is mostly after it) or UNKNOWN."""
    out = (end - last_end) / (end - start + 1)
    return F.when(~has_table, "UNKNOWN").when((start > last_end) | (out > 0.5), "BEYOND_BOUNDARY").otherwise("INSIDE_PARTITION")


def with_boundary(regions: DataFrame, maps: DataFrame | None) -> DataFrame:
    """Boundary context and the confidence that it changes.

    maps: a row per image: image_id, scheme, last_end (offset of the last byte in a partition, null without
    partitions). Images without a map or of scheme UNKNOWN keep their confidence.
    """
    if maps is None:
        return regions.withColumn("boundary_context", F.lit("UNKNOWN"))
    j = regions.join(maps.select("image_id", "scheme", "last_end"), "image_id", "left")
    known = F.col("scheme").isNotNull() & (F.col("scheme") != "UNKNOWN")
    where = F.when(known, boundary_of(F.col("first_block") * BLOCK, (F.col("last_block") + 1) * BLOCK - 1, F.col("last_end").isNotNull(), F.col("last_end"))).otherwise("UNKNOWN")
    t, c = F.col("wipe_type"), F.col("confidence")
    less = F.when(t.isin("ZERO_WIPE", "FF_WIPE"), 0.28).when(t.isin(PARTIAL), 0.364).otherwise(0.14)
    j = j.withColumn("boundary_context", where)
    new = (
        F.when(F.col("boundary_context") == "BEYOND_BOUNDARY", round3(F.greatest(c - less, F.lit(0.10))))
        .when(F.col("boundary_context") == "INSIDE_PARTITION", round3(F.least(c + 0.04, F.lit(1.0))))
        .otherwise(c)
    )
    return j.withColumn("confidence", new).drop("scheme", "last_end")


def numbered(regions: DataFrame, bits: int = segments.BITS) -> DataFrame:
    """The result's columns, with ids from 1 in order of start in each image."""
    return segments.numbered(regions, "id", bits).select(
        "image_id", F.col("id").cast("long").alias("id"), (F.col("first_block") * BLOCK).alias("start"), ((F.col("last_block") + 1) * BLOCK - 1).alias("end"),
        ((F.col("last_block") - F.col("first_block") + 1) * BLOCK).alias("size"), F.col("wipe_type").alias("type"), F.col("avg_entropy").alias("entropy"), "confidence", "block_count", "n_susp", "boundary_context",
    )


def aggregate(labelled: DataFrame, maps: DataFrame | None = None, bits: int = segments.BITS) -> DataFrame:
    """Regions of labelled blocks (image_id, block_id, wipe_type, entropy, confidence, is_suspicious), as a table: scores and reports read it again."""
    return of_runs(runs(labelled, bits), maps, bits)


def of_runs(run: DataFrame, maps: DataFrame | None = None, bits: int = segments.BITS) -> DataFrame:
    """Regions of runs (see runs), as a table."""
    found = suppress(bands(sized(absorb(run, bits=bits)), bits), bits)
    return written(numbered(with_boundary(scored(found), maps), bits), "found")


def region_blocks(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks (image_id, block_id, any others) with region_id and region_type of each region (see numbered) that holds them; regions may overlap."""
    r = regions.select("image_id", F.col("id").alias("region_id"), F.col("type").alias("region_type"), (F.col("start") / BLOCK).cast("long").alias("from_block"), ((F.col("end") + 1) / BLOCK - 1).cast("long").alias("to_block"))
    return containing(blocks, r, "block_id", "from_block", "to_block", top=20).drop("from_block", "to_block")
