"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, html_extract, langid, licenses, lm_score, minhash, packing, periodic, repair, simhash, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs(table(spark, sf_dir, "documents")).drop("runs")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_prefix_free_parsing": op7_prefix_free_parsing,
    "op8_warc": op8_warc,
    "op9_maxent_scores": op9_maxent_scores,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_recompression_runs": op11_recompression_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_simhash": op13_simhash,
}

#: DuckDB SQL for the rows of a query, where SQL can express it.
ORACLES = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY bare ORDER BY length(t) DESC, doc_id)
    """,
}
