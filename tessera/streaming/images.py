"""Images or block tables that arrive over time, in any number of batches and in any order.

Blocks are labelled and summed up to runs where they arrive. An image's runs are its state; a timer closes it when
nothing has come for a while, and its regions and scores are then made of the runs. So a batch costs what is in it:
neither labels nor regions are read or made again as an image grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.labels import TYPES
from ..operators.blocks import classify
from ..operators.regions import SUMS, joined_runs, of_runs
from ..operators.scoring import scored, stats_of_runs
from ..operators.segments import BITS

BLOCKS = "image_id string, block_id long, offset long, data binary"
RUN = ["is_suspicious", "first_block", "last_block", *SUMS, *(f"c_{t}" for t in TYPES), *(f"f_{t}" for t in TYPES)]
RUNS = "image_id string, is_suspicious boolean, first_block long, last_block long, n long, sum_entropy double, sum_confidence double, " + ", ".join(f"{x}_{t} long" for x in "cf" for t in TYPES)
ROW = np.dtype([(c, "?" if c == "is_suspicious" else "<f8" if c.startswith("sum_") else "<i8") for c in RUN])
#: The first block of a type that a run doesn't have.
NEVER = np.int64(2**62)


def block_stream(spark: SparkSession, folder: str, files_per_batch: int = 8, schema: str = BLOCKS) -> DataFrame:
    """A stream of Parquet files of blocks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def label_stream(blocks: DataFrame) -> DataFrame:
    """Labels are per block, so a stream is labelled without state."""
    return classify(blocks)


def _joined(runs: np.ndarray) -> np.ndarray:
    """Runs of one image (ROW) in order, those that go on from one another made one; a run ends with its stretch."""
    r = runs[np.argsort(runs["first_block"], kind="stable")]
    if not len(r):
        return r
    goes_on = (r["first_block"][1:] == r["last_block"][:-1] + 1) & (r["is_suspicious"][1:] == r["is_suspicious"][:-1]) & (r["first_block"][1:] >> BITS == r["first_block"][:-1] >> BITS)
    at = np.flatnonzero(np.r_[True, ~goes_on])
    out = r[at].copy()
    out["last_block"] = r["last_block"][np.r_[at[1:], len(r)] - 1]
    for c in (*SUMS, *(f"c_{t}" for t in TYPES)):
        out[c] = np.add.reduceat(r[c], at)
    for t in TYPES:
        out[f"f_{t}"] = np.minimum.reduceat(r[f"f_{t}"], at)
    return out


def _runs_of(blocks: pd.DataFrame) -> np.ndarray:
    """Labelled blocks of one image as runs."""
    r = np.zeros(len(blocks), ROW)
    r["is_suspicious"], r["n"] = blocks["is_suspicious"], 1
    r["first_block"] = r["last_block"] = blocks["block_id"]
    r["sum_entropy"], r["sum_confidence"] = blocks["entropy"], blocks["confidence"]
    for t in TYPES:
        own = (blocks["wipe_type"] == t).to_numpy()
        r[f"c_{t}"], r[f"f_{t}"] = own, np.where(own, r["first_block"], NEVER)
    return _joined(r)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labelled blocks as runs of what came together: image_id, ts, runs."""
    for b in batches:
        rows = [(image, own["ts"].max(), _runs_of(own).tobytes()) for image, own in b.groupby("image_id", sort=False)]
        yield pd.DataFrame(rows, columns=["image_id", "ts", "runs"])


class OpenRuns(StatefulProcessor):
    """The runs of an image that is still open, by stretch, until nothing has come for quiet milliseconds."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "stretch long", "runs binary")
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else -1
        newest = last
        for b in rows:
            new = np.concatenate([np.frombuffer(x, ROW) for x in b["runs"]])
            stretch = new["first_block"] >> BITS
            for k in np.unique(stretch).tolist():
                part = new[stretch == k]
                if self.runs.containsKey((k,)):
                    part = np.concatenate([np.frombuffer(self.runs.getValue((k,))[0], ROW), part])
                self.runs.updateValue((k,), (_joined(part).tobytes(),))
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
        if newest > last:
            if last >= 0:
                self.handle.deleteTimer(last + self.quiet)
            self.handle.registerTimer(newest + self.quiet)
            self.seen.update((newest,))
        yield pd.DataFrame(columns=["image_id", *RUN])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for value in self.runs.values():
            runs = np.frombuffer(value[0], ROW)
            out = pd.DataFrame({c: runs[c] for c in RUN})
            for t in TYPES:
                out[f"f_{t}"] = out[f"f_{t}"].where(out[f"c_{t}"] > 0).astype("Int64")
            out.insert(0, "image_id", key[0])
            yield out
        self.runs.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def run_stream(labelled: DataFrame, quiet_seconds: int = 600, late_seconds: int = 60) -> DataFrame:
    """The runs (see regions.stretch_runs) of each image once it is closed, from a stream of labelled blocks with their time of arrival, ts.

    An image is closed when the stream's watermark, late_seconds behind its latest ts, has passed quiet_seconds from
    the image's own latest. A batch's blocks are summed up before they are shuffled, so an image's task sees runs.
    Needs the RocksDB state store (see state_store).
    """
    summed = labelled.select("image_id", "block_id", "wipe_type", "entropy", "confidence", "is_suspicious", "ts").mapInPandas(_summed, "image_id string, ts timestamp, runs binary")
    grouped = summed.withWatermark("ts", f"{late_seconds} seconds").groupBy("image_id")
    return grouped.transformWithStateInPandas(statefulProcessor=OpenRuns(quiet_seconds * 1000), outputStructType=RUNS, outputMode="Append", timeMode="EventTime")


def state_store(spark: SparkSession) -> None:
    """Sets the state store that run_stream needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def score_stream(labelled: DataFrame, out: str, checkpoint: str, quiet_seconds: int = 600, late_seconds: int = 60):
    """Writes regions and scores of each closed image under out, in a folder a batch; one that runs again overwrites its own."""
    state_store(labelled.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/runs/batch={number}")
        runs = spark.read.schema(batch.schema).parquet(f"{out}/runs/batch={number}")
        if runs.isEmpty():
            return
        regions = of_runs(joined_runs(runs))
        for name, df in (("regions", regions), ("scores", scored(stats_of_runs(runs), regions))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return run_stream(labelled, quiet_seconds, late_seconds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def suspicious_rate(labelled: DataFrame, seconds: int = 60) -> DataFrame:
    """Blocks and suspicious blocks per window of arrival time; needs a column ts."""
    timed = labelled.withWatermark("ts", f"{seconds} seconds")
    return timed.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("blocks"), F.count_if("is_suspicious").alias("suspicious"))
