"""Scattered re-reads of image files, and hashes of whole files and of their ranges, in tasks of bounded bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockimage import BLOCK, PARTITION_BYTES, READ_BYTES, image_files, open_input, part_of
from .sinks import written

#: Files and wanted blocks meet by stretches of so many blocks.
STRETCH = 65_536
#: A gap of more blocks is never read over.
MOST_GAP = 128
RANGES = "image_id string, path string, begin long, first long, last long, wanted array<int>"


def image_table(spark: SparkSession, path: str, size: int = BLOCK) -> DataFrame:
    """image_id, path, begin (first block), past (block after the last), n_bytes of each file of the images below path (see image_files)."""
    rows = []
    for file, where, n in image_files(path):
        image, begin = part_of(file)
        rows.append((image, where, begin, begin - (-n // size), n))
    return spark.createDataFrame(rows, "image_id string, path string, begin long, past long, n_bytes long")


def _stretched(files: DataFrame) -> DataFrame:
    """files, a row for each stretch of blocks that a file reaches into."""
    lo, hi = (F.floor(c / STRETCH).cast("long") for c in (F.col("begin"), F.col("past") - 1))
    return files.filter("past > begin").withColumn("stretch", F.explode(F.sequence(lo, hi)))


def coalesced(wanted: DataFrame, files: DataFrame, size: int = BLOCK) -> DataFrame:
    """RANGES to read so that all wanted blocks (image_id, block_id) of the files (see image_table) are in one.

    wanted has the places, from first on, of the blocks that are. A gap between two blocks is read over while what
    is read over in a range stays within what is wanted in it, so no more than twice the wanted bytes are read.
    Repeated ids count once; ids beyond an image's blocks, and of images without a file, are in no range.
    """

    def run(batches):
        most = max(1, READ_BYTES // size)
        image = path = begin = first = last = None
        places: list[int] = []
        out: list[tuple] = []
        for b in batches:
            for own, where, at, k in zip(*(b.column(c).to_pylist() for c in range(4))):
                gap = None if where != path or last is None else k - last - 1
                if gap is not None and gap < 0:
                    continue  # again
                n = len(places)
                if gap is not None and gap <= MOST_GAP and k - first < most and k - first - n <= n + 1:
                    places.append(k - first)
                    last = k
                    continue
                if places:
                    out.append((image, path, begin, first, last, places))
                image, path, begin, first, last, places = own, where, at, k, k, [0]
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if places:
            out.append((image, path, begin, first, last, places))
        yield _batch(out)

    w = wanted.select("image_id", "block_id").withColumn("stretch", F.floor(F.col("block_id") / STRETCH).cast("long"))
    j = w.join(_stretched(files), ["image_id", "stretch"]).filter("block_id >= begin and block_id < past")
    return j.repartition("image_id", "stretch").sortWithinPartitions("path", "block_id").select("image_id", "path", "begin", "block_id").mapInArrow(run, RANGES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in RANGES.split(", ")])


def read_ranges(ranges: DataFrame, size: int = BLOCK) -> DataFrame:
    """image_id, block_id, offset, data of the wanted blocks of RANGES, each range by one read."""

    most = max(1, READ_BYTES // size)

    def rows(images, counts, ids, blocks):
        n = np.concatenate(ids)
        image = pa.array(images).take(pa.array(np.repeat(np.arange(len(images)), counts)))
        return pa.RecordBatch.from_arrays([image, pa.array(n), pa.array(n * size), pa.array(blocks, pa.binary())], ["image_id", "block_id", "offset", "data"])

    def run(batches):
        images, counts, ids, blocks = [], [], [], []
        opened: dict = {}
        for b in batches:
            for image, path, begin, first, last, wanted in zip(*(b.column(c).to_pylist() for c in range(6))):
                if path not in opened:
                    opened = {path: open_input(path)}
                data = opened[path].read_at((last + 1 - first) * size, (first - begin) * size)
                images.append(image)
                counts.append(len(wanted))
                ids.append(np.array(wanted, np.int64) + first)
                blocks += [data[k * size : (k + 1) * size] for k in wanted]
                if len(blocks) >= most:  # ranges may be of a few blocks each
                    yield rows(images, counts, ids, blocks)
                    images, counts, ids, blocks = [], [], [], []
        if blocks:
            yield rows(images, counts, ids, blocks)

    return ranges.mapInArrow(run, "image_id string, block_id long, offset long, data binary")


def reread(spark: SparkSession, wanted: DataFrame, path: str, size: int = BLOCK) -> DataFrame:
    """The wanted blocks (image_id, block_id) of the images below path: image_id, block_id, offset, data.

    The ranges to read are written once, in order of place, and dealt to as many tasks as their bytes ask for.
    """
    ranges = written(coalesced(wanted, image_table(spark, path, size), size), "ranges")
    total = ranges.agg(F.sum(F.col("last") + 1 - F.col("first"))).first()[0] or 0
    tasks = max(1, -(-total * size // PARTITION_BYTES))
    return read_ranges(ranges.repartitionByRange(tasks, "path", "first").sortWithinPartitions("path", "first"), size)


def image_hashes(spark: SparkSession, path: str) -> DataFrame:
    """image_id, n_bytes, sha256 of each image below path: one task an image, its files in order. A hash is sequential by nature."""

    def run(batches):
        for b in batches:
            for image, files, n in zip(*(b.column(c).to_pylist() for c in range(3))):
                h = hashlib.sha256()
                for f in files:
                    with open_input(f["path"]) as data:
                        while part := data.read(READ_BYTES):
                            h.update(part)
                yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], ["image_id", "n_bytes", "sha256"])

    files = image_table(spark, path)
    images = files.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("begin", "path"))).alias("files"), F.sum("n_bytes").alias("n_bytes"))
    n = files.select("image_id").distinct().count()
    return images.repartition(n, "image_id").mapInArrow(run, "image_id string, n_bytes long, sha256 string")


def manifest(spark: SparkSession, path: str, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """image_id, path, offset (in the file), n_bytes, sha256 of each range of range_bytes of the files below path, hashed in parallel."""

    def run(batches):
        for b in batches:
            for image, where, at, n in zip(*(b.column(c).to_pylist() for c in range(4))):
                h = hashlib.sha256()
                with open_input(where) as f:
                    for k in range(at, at + n, READ_BYTES):
                        h.update(f.read_at(min(READ_BYTES, at + n - k), k))
                yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([where]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([h.hexdigest()])], ["image_id", "path", "offset", "n_bytes", "sha256"])

    files = image_table(spark, path).filter("n_bytes > 0")
    step = F.lit(range_bytes).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, step))
    ranges = files.select("image_id", "path", "n_bytes", starts.alias("offset")).select("image_id", "path", "offset", F.least(step, F.col("n_bytes") - F.col("offset")).alias("n_bytes"))
    n = ranges.count()
    return ranges.repartitionByRange(max(1, n), "path", "offset").mapInArrow(run, "image_id string, path string, offset long, n_bytes long, sha256 string")


def manifest_roots(ranges: DataFrame) -> DataFrame:
    """image_id, n_bytes, root: the hash of a manifest's hashes in order, which stands for the whole image."""
    listed = F.array_sort(F.collect_list(F.struct("path", "offset", "sha256")))
    return ranges.groupBy("image_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sha2(F.array_join(F.transform(listed, lambda x: x["sha256"]), ""), 256).alias("root"))


def changed(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """image_id, path, offset, state of the ranges that differ between two manifests: changed, gone or new."""
    a, b = (m.select("image_id", "path", "offset", F.struct("n_bytes", "sha256").alias(n)) for m, n in ((recorded, "was"), (now, "is")))
    state = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, ["image_id", "path", "offset"], "full").withColumn("state", state).filter("state is not null").drop("was", "is")
