"""Result files: block tables, region tables, one JSON document per image, the custody log, sessions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; with a local master a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Deletes all tables that this application has written to the shared folder; for when its results have been read or stored elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tessera/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read again; what several steps need is made once."""
    folder = shared_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small(rows: DataFrame, limit_rows: int = 200_000) -> DataFrame:
    """rows of a few numbers each, to be joined to: broadcast while a count of them is within the limit, else left to a shuffle."""
    return F.broadcast(rows) if rows.limit(limit_rows + 1).count() <= limit_rows else rows


def result_documents(scores: DataFrame, regions: DataFrame, reports: DataFrame, custody: DataFrame | None = None) -> DataFrame:
    """image_id, document: the public JSON result of each image, without its blocks, which are a table of their own."""
    r = regions.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("id", "start", "end", "size", "type", F.round("entropy", 3).alias("entropy"), F.round("confidence", 3).alias("confidence"), "block_count", "boundary_context"))).alias("regions")
    )
    stats = F.struct(
        "total_blocks", "suspicious_blocks", F.round("suspicious_pct", 2).alias("suspicious_pct"), F.round("adjusted_density", 4).alias("wipe_density"), "regions_count",
        F.round("avg_entropy_flagged", 3).alias("avg_entropy_flagged"), "intent_score", "verdict", F.round("coverage_pct", 1).alias("coverage_pct"), "dominant_type",
    )
    j = scores.join(r, "image_id", "left").join(reports, "image_id", "left")
    parts = [F.col("image_id").alias("filename"), stats.alias("stats"), "regions", F.col("report").alias("forensic_report")]
    if custody is not None:
        j = j.join(custody.select(F.col("session_id").alias("image_id"), F.struct("events", "total_entries", "final_hash").alias("chain_of_custody")), "image_id", "left")
        parts.append("chain_of_custody")
    return j.select("image_id", F.to_json(F.struct(*parts)).alias("document"))


def write_results(folder: str, labelled: DataFrame, regions: DataFrame, documents: DataFrame) -> None:
    """Blocks as Parquet by image, regions as CSV, documents as JSON lines."""
    labelled.select("image_id", "block_id", F.col("wipe_type").alias("type"), F.round("entropy", 3).alias("entropy")).write.partitionBy("image_id").parquet(f"{folder}/blocks")
    regions.write.option("header", True).csv(f"{folder}/regions")
    documents.select("document").write.text(f"{folder}/documents")
