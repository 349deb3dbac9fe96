"""Report sections of a scan, as columns over one row per image and its regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import TYPES, entropy_meaning, region_bounds

# Tools and standards by type of overwrite.
SIGNATURES = {
    "ZERO_WIPE": (["dd (if=/dev/zero)", "sdelete -z", "cipher /w:", "Windows format /P:1"], "NIST SP 800-88 — single-pass zero overwrite"),
    "FF_WIPE": (["dd (if=/dev/urandom truncated)", "hdparm --security-erase", "Flash erase"], "Common in embedded/flash memory secure erase"),
    "RANDOM_WIPE": (["shred", "dd (if=/dev/urandom)", "Eraser", "DBAN random pass", "sdelete -p", "srm"], "NIST SP 800-88 / DoD 5220.22-M compliant random overwrite"),
    "MULTI_PASS": (["shred -n 3/7", "DBAN Gutmann (35-pass)", "DoD 5220.22-M (7-pass)", "Eraser Gutmann", "Blancco"], "Gutmann method / DoD 5220.22-M — multi-pass overwrite"),
    "LIKELY_ZERO_WIPE": (["Interrupted zero-fill", "Partial wipe", "TRIM-affected sectors"], "Partial evidence — incomplete overwrite"),
    "LIKELY_FF_WIPE": (["Interrupted FF-fill", "Flash device residue"], "Partial evidence — incomplete overwrite"),
}
# Tools by mix of types.
ATTRIBUTION = {
    "multi": ["DBAN (Gutmann/DoD mode)", "shred -n 3+", "Blancco", "Eraser"],
    "random and zero": ["shred (multi-pass)", "DoD 5220.22-M wiper", "sdelete -p"],
    "random": ["shred", "dd if=/dev/urandom", "Eraser (random pass)", "srm"],
    "zero": ["dd if=/dev/zero", "sdelete -z", "cipher /w:", "TRIM"],
    "ff": ["hdparm --security-erase", "Flash memory erase", "firmware wipe"],
}
# Actions by verdict (priority, title, condition).
ACTIONS = {
    "HIGH": [
        ("IMMEDIATE", "Preserve and Isolate Evidence", ""), ("HIGH", "Assign Qualified Forensic Examiner", ""), ("HIGH", "Filesystem Metadata Carving", ""),
        ("HIGH", "Wipe Tool Identification", "tools"), ("HIGH", "Full-Disk Sanitisation Confirmation", "most"), ("MEDIUM", "Timeline Correlation", ""), ("MEDIUM", "Network and Cloud Artefact Review", ""),
    ],
    "MEDIUM": [
        ("HIGH", "Manual Region Verification", ""), ("HIGH", "Filesystem Metadata Correlation", ""), ("HIGH", "Wipe Tool Artefact Search", "tools"),
        ("MEDIUM", "Selective vs Full-Disk Assessment", ""), ("LOW", "Expanded Image Acquisition", ""),
    ],
    "LOW": [("MEDIUM", "Supplementary Manual Review", ""), ("MEDIUM", "Alternative Explanation Assessment", ""), ("LOW", "Contextual Investigation", "")],
    "NEGLIGIBLE": [("LOW", "No Immediate Forensic Action Required", ""), ("LOW", "Retain Image for Reference", "")],
}
LAST_ACTION = ("LOW", "Evidence Hash Verification")
TOP_REGIONS = 20


def _ranked() -> Column:
    """The types that occur, most blocks first: an array of rank, type, block_count, tools (sorted), standard."""
    rows = F.array(*(F.struct(F.col(f"n_{t}").alias("block_count"), F.lit(-i).alias("place"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)))
    ordered = F.reverse(F.array_sort(F.filter(rows, lambda r: r["block_count"] > 0)))
    tools = F.create_map(*(x for t, (names, _) in SIGNATURES.items() for x in (F.lit(t), F.array(*map(F.lit, sorted(names))))))
    standards = F.create_map(*(F.lit(x) for t, (_, standard) in SIGNATURES.items() for x in (t, standard)))
    return F.transform(
        ordered,
        lambda r, i: F.struct(
            (i + 1).alias("rank"), r["type"].alias("type"), r["block_count"].alias("block_count"),
            F.coalesce(F.try_element_at(tools, r["type"]), F.array(F.lit("Unknown"))).alias("tools"), F.coalesce(F.try_element_at(standards, r["type"]), F.lit("")).alias("standard"),
        ),
    )


def types_ranked(stats: DataFrame) -> DataFrame:
    """image_id, rank, type, block_count, tools (sorted), standard of the types that occur, most blocks first."""
    return stats.select("image_id", F.inline(_ranked()))


def _has(*types: str) -> Column:
    out = F.lit(False)
    for t in types:
        out = out | (F.col(f"n_{t}") > 0)
    return out


def _basis() -> Column:
    rnd, zero = _has("RANDOM_WIPE"), _has("ZERO_WIPE")
    return F.when(_has("MULTI_PASS"), "multi").when(rnd & zero, "random and zero").when(rnd, "random").when(zero, "zero").when(_has("FF_WIPE"), "ff").otherwise("none")


def _tools(basis: Column) -> Column:
    tools = F.create_map(*(x for k, v in ATTRIBUTION.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))))
    return F.coalesce(F.try_element_at(tools, basis), F.array().cast("array<string>"))


def attribution(stats: DataFrame) -> DataFrame:
    """image_id, basis, tools (sorted): the tools that the mix of types points to."""
    return stats.select("image_id", _basis().alias("basis")).withColumn("tools", _tools(F.col("basis")))


def _dominant() -> Column:
    rows = F.array(*(F.struct(F.col(f"n_{t}").alias("n"), F.lit(-i).alias("p"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)))
    return F.array_max(rows)["t"]


def dominant_type(stats: DataFrame) -> DataFrame:
    """image_id, dominant_type by blocks; of equal counts the first key, ZERO_WIPE if all are 0."""
    return stats.select("image_id", _dominant().alias("dominant_type"))


def _reliability() -> list[Column]:
    """factors, caveats and level, with the rounding that reports have."""
    d, h = F.round(F.col("suspicious_blocks") / F.col("total_blocks"), 4), F.round("avg_entropy_flagged", 3)
    factors = F.array_compact(
        F.array(
            F.when(d > 0.30, "density"), F.when(_has("RANDOM_WIPE"), "random"), F.when(_has("MULTI_PASS"), "multi-pass"), F.when(F.col("regions_count") >= 3, "regions"),
        )
    )
    caveats = F.array_compact(
        F.array(
            F.when(d < 0.05, "low density"), F.when((h >= 7.0) & _has("RANDOM_WIPE"), "high entropy"),
            F.when((F.col("verdict") == "MEDIUM") & (F.col("regions_count") < 3), "few regions"), F.when(F.col("n_LIKELY_ZERO_WIPE") > F.col("n_ZERO_WIPE"), "partial evidence"),
        )
    )
    level = F.when((F.size(factors) >= 3) & (F.size(caveats) <= 1), "HIGH").when(F.size(factors) >= 2, "MEDIUM").otherwise("LOW")
    return [factors.alias("factors"), caveats.alias("caveats"), level.alias("reliability_level")]


def reliability(scores: DataFrame) -> DataFrame:
    """image_id, factors, caveats, reliability_level from scores."""
    return scores.select("image_id", *_reliability())


def _actions() -> Column:
    """The recommended actions of the verdict in order: an array of position, priority, action."""
    each = lambda rows: F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"), F.lit(c).alias("needs")) for p, a, c in rows))
    table = F.create_map(*(x for v, some in ACTIONS.items() for x in (F.lit(v), each([*some, (*LAST_ACTION, "")]))))
    tools, most = _has("RANDOM_WIPE", "MULTI_PASS"), F.coalesce(F.col("coverage_pct") > 50, F.lit(False))
    own = F.filter(F.element_at(table, F.col("verdict")), lambda r: (r["needs"] == "") | ((r["needs"] == "tools") & tools) | ((r["needs"] == "most") & most))
    return F.transform(own, lambda r, i: F.struct((i + 1).alias("position"), r["priority"].alias("priority"), r["action"].alias("action")))


def actions(scores: DataFrame) -> DataFrame:
    """image_id, position, priority, action: the recommended actions of each image's verdict, in order."""
    return scores.select("image_id", F.inline(_actions()))


def top_regions(regions: DataFrame, n: int = TOP_REGIONS) -> DataFrame:
    """The first n regions of each image as a report shows them."""
    return regions.filter(F.col("id") <= n).select(
        "image_id", "id", "type", region_bounds(F.col("start"), F.col("end")).alias("bounds"), "block_count", entropy_meaning(F.col("entropy")).alias("meaning"),
        F.concat(F.format_string("%.1f", 100 * F.col("confidence")), F.lit("%")).alias("confidence"), "boundary_context",
    )


OPINIONS = {
    "HIGH": "Strong evidence of deliberate overwriting.",
    "MEDIUM": "Evidence points to deliberate overwriting, but needs support from other findings.",
    "LOW": "Few signs of overwriting; ordinary use may explain them.",
    "NEGLIGIBLE": "No significant sign of overwriting.",
}


#: What an opinion adds for the kinds of overwriting found, and what every report says of itself.
REMARKS = {"multi": " Several passes over the same places have hardly another cause than a wiping tool.", "random": " Random content points to a tool that is made to defeat recovery."}
NOTE = "Made by rules and models alone; an examiner must review it before it is relied on."
VERSION = "1.0"


def _opinion() -> Column:
    text = F.element_at(F.create_map(*(F.lit(x) for kv in OPINIONS.items() for x in kv)), F.col("verdict"))
    remark = F.when(F.col("verdict") != "HIGH", "").when(_has("MULTI_PASS"), REMARKS["multi"]).when(_has("RANDOM_WIPE"), REMARKS["random"]).otherwise("")
    return F.concat(text, remark)


def _ml_section() -> Column:
    """Of the columns blocks_analyzed, overrides, false_positive_reductions, model_version; null where no model was used."""
    text = F.when(F.col("blocks_analyzed") > 0, F.format_string("A model looked at %d blocks and changed the label of %d, %d of them from suspicious to not.", "blocks_analyzed", "overrides", "false_positive_reductions")).otherwise("No model was applied.")
    used = F.col("blocks_analyzed").isNotNull()
    return F.struct(
        used.alias("available"), F.when(used, F.coalesce("model_version", F.lit("unknown"))).alias("model_version"), "blocks_analyzed", F.col("overrides").alias("total_overrides"),
        "false_positive_reductions", F.when(used, text).otherwise("No model was used, or its results are missing.").alias("description"),
    )


def documents(scores: DataFrame, regions: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """image_id, report: one JSON document per image with the sections of a report.

    scores: a row per image, as scoring.score gives; regions: as regions.aggregate gives; model: image_id,
    blocks_analyzed, overrides, false_positive_reductions (blocks.ml_summary) and model_version, if a model was
    used. All sections but the regions are made of an image's scores, so scores are read once.
    """
    kinds = {"blocks_analyzed": "long", "overrides": "long", "false_positive_reductions": "long", "model_version": "string"}
    t = top_regions(regions).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "bounds", "block_count", "meaning", "confidence"))).alias("regions"))
    j = scores.join(t, "image_id", "left")
    if model is not None:
        j = j.join(model.select("image_id", *(c if c in model.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items())), "image_id", "left")
    else:
        j = j.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
    pct, coverage = F.round("suspicious_pct", 2), F.round("coverage_pct", 1)
    factors, caveats, level = _reliability()
    largest = F.struct(F.col("largest_region_id").alias("id"), F.col("largest_region_size").alias("size"))
    report = F.struct(
        F.lit(VERSION).alias("report_version"),
        F.lit(NOTE).alias("note"),
        F.struct("verdict", "intent_score", coverage.alias("coverage_pct"), "regions_count", _opinion().alias("opinion")).alias("executive_summary"),
        F.struct(
            "total_blocks", "suspicious_blocks", pct.alias("suspicious_pct"), F.round("avg_entropy_flagged", 3).alias("avg_entropy"), entropy_meaning(F.col("avg_entropy_flagged")).alias("meaning"),
            "regions_count", largest.alias("largest_region"), F.round("avg_region_size", 1).alias("avg_region_size"), "regions",
        ).alias("technical_findings"),
        F.struct(_ranked().alias("types"), _basis().alias("basis"), _tools(_basis()).alias("tools")).alias("pattern_analysis"),
        F.struct(level, factors, caveats).alias("reliability"),
        _ml_section().alias("ml_analysis"),
        F.struct(_opinion().alias("forensic_opinion"), "intent_score", "verdict", F.lit(NOTE).alias("confidence_note")).alias("conclusions"),
        _actions().alias("recommended_actions"),
        F.struct(
            "intent_score", "verdict", pct.alias("coverage_pct"), F.col("regions_count").alias("regions_found"), pct.alias("suspicious_pct"), _dominant().alias("dominant_type"),
            _has("MULTI_PASS").alias("has_multi_pass"), _has("RANDOM_WIPE").alias("has_random_wipe"),
        ).alias("metrics"),
    )
    return j.select("image_id", F.to_json(report).alias("report"))
