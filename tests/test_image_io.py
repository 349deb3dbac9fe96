"""Images as a stream and as a sink that publishes a write whole or not at all."""

import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from tessera.sources.blockimage import BLOCK, BlockImageReader, read_images, stream_images, write_images


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.startswith(".") and not f.endswith(".crc"))


def blocks(spark, images):
    return spark.createDataFrame([(i, k, x[k * BLOCK : (k + 1) * BLOCK]) for i, x in images.items() for k in range(-(-len(x) // BLOCK))], "image_id string, block_id long, data binary")


def test_written_images_are_read(spark, tmp_path):
    images = {"a": random.Random(1).randbytes(500 * BLOCK + 7), "dir/b": random.Random(2).randbytes(90 * BLOCK)}
    path = str(tmp_path / "out")
    write_images(blocks(spark, images).repartition(7), path)
    got = {}
    for r in read_images(spark, path).orderBy("image_id", "block_id").collect():
        got[r.image_id] = got.get(r.image_id, b"") + bytes(r.data)
    assert got == images and not any(n.startswith(".pending") for n in os.listdir(path))
    write_images(blocks(spark, {"c": bytes(BLOCK)}), path)
    assert read_images(spark, path).select("image_id").distinct().count() == 3
    write_images(blocks(spark, {"d": bytes(BLOCK)}), path, "overwrite")
    assert [r.image_id for r in read_images(spark, path).collect()] == ["d"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write_images(blocks(spark, {"a": bytes(9 * BLOCK)}), path)
    before = tree(path)
    bad = blocks(spark, {"b": bytes(300 * BLOCK), "c": bytes(300 * BLOCK)}).withColumn("data", F.when((F.col("image_id") == "c") & (F.col("block_id") == 250), F.raise_error(F.lit("no more"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="no more"):
        write_images(bad, path)
    assert tree(path) == before and os.listdir(path) == ["a"]


def test_a_task_that_runs_again(tmp_path):
    """Its first attempt writes half of its blocks and fails; the images have each block once."""
    script = f"""
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from tessera.sources.blockimage import BlockImageSource, read_images
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("OFF")
        def once(batches):
            for n, b in enumerate(batches):
                yield b
                if TaskContext.get().attemptNumber() == 0 and n == 3:
                    raise RuntimeError("lost")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        df = spark.range(0, 1000, 1, 2).selectExpr("concat('i', cast(floor(id / 500) as string)) AS image_id", "id % 500 AS block_id", "cast(rpad(cast(id as string), 512, '.') as binary) AS data")
        spark.dataSource.register(BlockImageSource)
        df.mapInArrow(once, df.schema).write.format("blockimage").mode("append").save({str(tmp_path / "out")!r})
        rows = read_images(spark, {str(tmp_path / "out")!r}).collect()
        assert sorted(int(bytes(r.data).rstrip(b".")) for r in rows) == list(range(1000)), len(rows)
        print("whole")
    """
    env = os.environ | {"PYTHONPATH": os.getcwd() + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, env=env, timeout=200)
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]
    assert len(tree(tmp_path / "out")) == 2 and sorted(os.listdir(tmp_path / "out")) == ["i0", "i1"]


def test_stream(spark, tmp_path):
    images = {f"s{i}": random.Random(i).randbytes((20 + i) * BLOCK) for i in range(5)}
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        q = stream_images(spark, str(folder), files_per_batch=2, partition_bytes=8 * BLOCK).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).option("path", str(tmp_path / "rows")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def put(names):
        for n in names:
            (tmp_path / n).write_bytes(images[n])
            os.rename(tmp_path / n, folder / n)

    put(["s3", "s4", "s0"])
    run()
    put(["s1", "s2"])
    for _ in range(3):
        run()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "rows")).orderBy("image_id", "block_id").collect():
        got[r.image_id] = got.get(r.image_id, b"") + bytes(r.data)
    assert got == images


def test_ranges_grow_with_the_images(tmp_path, monkeypatch):
    from tessera.sources import blockimage

    (tmp_path / "big").write_bytes(bytes(4000 * BLOCK))
    monkeypatch.setattr(blockimage, "MOST_TASKS", 10)
    reader = BlockImageReader({"path": str(tmp_path), "partition_bytes": str(BLOCK)})
    assert len(reader.partitions()) == 10


def test_small_images_share_tasks(spark, tmp_path):
    """Many small images are read in few tasks, each block once; a few of them stay apart."""
    for i in range(300):
        (tmp_path / f"{i:03d}.img").write_bytes(bytes([i % 256]) * (BLOCK * (1 + i % 7)))
    parts = BlockImageReader({"path": str(tmp_path)}).partitions()
    assert 64 <= len(parts) < 128
    got = sorted((r.image_id, r.block_id, r.data[0]) for r in read_images(spark, str(tmp_path)).collect())
    assert got == [(f"{i:03d}.img", k, i % 256) for i in range(300) for k in range(1 + i % 7)]
    assert len(BlockImageReader({"path": f"{tmp_path}/00*.img"}).partitions()) == 10


def test_writes_of_many_images_at_once(spark, tmp_path):
    """Gaps and other images end a file, also within a batch."""
    rows = [(i, k, bytes([k % 251]) * BLOCK) for i in ("a", "b/c", "d") for k in [*range(40), *range(50, 53), 99]]
    write_images(spark.createDataFrame(rows, "image_id string, block_id long, data binary").coalesce(1), str(tmp_path))
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.part")) == sorted(f"{i}/{k:012d}.part" for i in ("a", "b/c", "d") for k in (0, 50, 99))
    assert sorted((r.image_id, r.block_id, bytes(r.data)) for r in read_images(spark, str(tmp_path)).collect()) == rows
