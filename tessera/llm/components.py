"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _print(edges: DataFrame):
    """A fingerprint of an edge table, from one aggregate."""
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of an edge: label is the smallest node of its component.

    edges: two columns of ids; loops, repeats and nulls are ignored. Edges are only joined and aggregated, so
    a component of any size is never in one place; each round is written, so a lost executor costs a part
    of one round.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = written(e, "edges")
    before = _print(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = written(small, "small-star")
        now = _print(e)
        if now == before:
            break
        before = now
    root = e.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("node"), F.col("u").alias("label"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(root)
