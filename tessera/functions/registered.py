"""Functions for SQL: register(spark) adds them to a session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .blockstats import FEATURES, _by_length, features, statistics


def _per_block(data: pd.Series, compute, width: int | None = None):
    column = pa.array(data, pa.binary())
    out = np.zeros(len(column) if width is None else (len(column), width))
    for at, v in _by_length(column, compute):
        out[at] = v
    return pd.Series(out if width is None else list(out))


@pandas_udf(DoubleType())
def block_entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes of a block, 0 for none."""
    return _per_block(data, lambda x: statistics(x)["entropy"])


@pandas_udf(DoubleType())
def block_uniformity(data: pd.Series) -> pd.Series:
    """How far the byte frequencies of a block are from equal ones."""
    return _per_block(data, lambda x: statistics(x)["uniformity"])


@pandas_udf(ArrayType(DoubleType()))
def block_features(data: pd.Series) -> pd.Series:
    """The 30 features of a block."""
    return _per_block(data, features, FEATURES)


@udtf(returnType=StructType([StructField("block_id", LongType()), StructField("data", BinaryType())]))
class SplitBlocks:
    """split_blocks(data, size): the blocks of some bytes, the last one shorter; none of null or empty bytes."""

    def eval(self, data: bytes, size: int = 512) -> Iterator[tuple[int, bytes]]:
        data = bytes(data or b"")
        for i in range(0, len(data), size):
            yield i // size, data[i : i + size]


@udtf
class BlockRuns:
    """block_runs(TABLE(labels)): the runs of labelled blocks (image_id, block_id, is_suspicious, entropy, any others) within stretches of 65,536 blocks.

    The function asks for its rows by stretch and in order, so a call needs no PARTITION BY or ORDER BY, and holds one
    run at a time. A run ends where the next block is of the other kind or isn't there.
    """

    def __init__(self):
        self.run = None

    @staticmethod
    def analyze(labels: AnalyzeArgument) -> AnalyzeResult:
        if not labels.isTable:
            raise ValueError("block_runs takes a table: block_runs(TABLE(labels))")
        missing = {"image_id", "block_id", "is_suspicious", "entropy"} - set(labels.dataType.names)
        if missing:
            raise ValueError(f"block_runs needs the columns {', '.join(sorted(missing))}")
        out = [labels.dataType["image_id"], StructField("is_suspicious", BooleanType()), *(StructField(c, LongType()) for c in ("first_block", "last_block", "n")), StructField("sum_entropy", DoubleType())]
        return AnalyzeResult(schema=StructType(out), partitionBy=[PartitioningColumn("image_id"), PartitioningColumn("shiftright(block_id, 16)")], orderBy=[OrderingColumn("block_id")])

    def eval(self, row) -> Iterator[tuple]:
        r = self.run
        if r and r[1] == row["is_suspicious"] and r[3] + 1 == row["block_id"]:
            r[3], r[4], r[5] = row["block_id"], r[4] + 1, r[5] + row["entropy"]
            return
        if r:
            yield tuple(r)
        self.run = [row["image_id"], row["is_suspicious"], row["block_id"], row["block_id"], 1, row["entropy"]]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    """block_entropy, block_uniformity, block_features and the table functions split_blocks and block_runs."""
    for f in (block_entropy, block_uniformity, block_features):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("split_blocks", SplitBlocks)
    spark.udtf.register("block_runs", BlockRuns)
