import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import blockstats, labels
from tessera.operators import blocks
from tessera.sources import blockimage

BLOCKS = "image_id string, block_id long, offset long, data binary"


def rand(seed, n=512):
    out = b""
    i = 0
    while len(out) < n:
        out += hashlib.sha256(f"{seed}:{i}".encode()).digest()
        i += 1
    return out[:n]


def plain_entropy(data):
    return -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0


def noisy(fill, k, distinct=True):
    out = bytearray([fill]) * 512
    for i in range(k):
        out[40 * i + 3] = (i + 1 if distinct else 7) if fill == 0 else (i if distinct else 7)
    return bytes(out)


CASES = [
    (bytes(512), "ZERO_WIPE"),
    (b"\xff" * 512, "FF_WIPE"),
    (noisy(0, 9), "ZERO_WIPE"),
    (noisy(0, 10), "NORMAL"),
    (noisy(0, 11), "NORMAL"),
    (bytes(384) + rand("a", 128), "LIKELY_ZERO_WIPE"),
    (b"\xff" * 384 + rand("b", 128), "LIKELY_FF_WIPE"),
    (bytes(384) + b"\x01\x02" * 64, "NORMAL"),
    (b"\x55\xaa" * 256, "NORMAL"),
    (b"plain words of a language " * 20, "NORMAL"),
    (b"", "NORMAL"),
    (b"\0" * 37, "ZERO_WIPE"),
]


def test_labels_of_contents(spark):
    rows = [("i", k, k * 512, d) for k, (d, _) in enumerate(CASES)]
    got = {r.block_id: r for r in blocks.classify(spark.createDataFrame(rows, BLOCKS)).collect()}
    for k, (data, label) in enumerate(CASES):
        assert got[k].wipe_type == label, (k, got[k])
        assert abs(got[k].entropy - plain_entropy(data)) < 1e-9
    assert got[3].confidence == 0.90 and got[4].confidence == 0.82  # the gaps between the rules
    assert got[10].confidence == 1.0 and got[10].dominant_pct == 1.0
    assert got[0].confidence == 1.0 and abs(got[1].confidence - 0.96) < 1e-12


def test_random_blocks(spark):
    rows = [("i", k, k * 512, rand(k)) for k in range(300)]
    for r in blocks.classify(spark.createDataFrame(rows, BLOCKS)).collect():
        if r.entropy < 7.6:
            assert (r.wipe_type, r.confidence) == ("NORMAL", 0.90)
        elif r.legit:
            assert (r.wipe_type, r.confidence) == ("NORMAL", 0.72)
        else:
            assert r.wipe_type == "RANDOM_WIPE" and 0.5 < r.confidence <= 0.92


def test_rules_that_data_cannot_reach(spark):
    base = dict(n=512, entropy=1.0, uniformity=0.01, zero_ratio=0.0, ff_ratio=0.0, dominant_byte=1, dominant_pct=0.5, entropy_nonzero=1.0, entropy_nonff=1.0, legit=False)
    cases = [
        ({}, "LOW_ENTROPY_SUSPECT"),
        ({"entropy": 5.0, "zero_ratio": 0.4, "uniformity": 0.001}, "MULTI_PASS"),
        ({"entropy": 7.7, "uniformity": 0.5}, "NORMAL"),
        ({"entropy": 3.0, "dominant_byte": 0, "dominant_pct": 0.75}, "UNALLOCATED"),
    ]
    for change, label in cases:
        s = {k: F.lit(v) for k, v in (base | change).items()}
        assert spark.range(1).select(labels.classified(s).alias("c")).first().c.wipe_type == label


def test_features_by_hand():
    import numpy as np

    g = random.Random(3)
    for n in (1, 5, 100, 512):
        data = bytes(g.choice(b"abcdef\x00\xff ") for _ in range(n))
        f = blockstats.features(np.frombuffer(data, np.uint8).reshape(1, -1))[0]
        assert abs(f[0] - plain_entropy(data) / 8) < 1e-9
        assert abs(f[28] - plain_entropy(data[::2]) / 8) < 1e-9
        runs, longest = 1, 1
        now = 1
        for a, b in zip(data, data[1:]):
            now = now + 1 if a == b else 1
            runs += a != b
            longest = max(longest, now)
        assert abs(f[13] - min(n / runs / 8, 1)) < 1e-9 and abs(f[14] - min(longest / 50, 1)) < 1e-9
        assert abs(f[21] - data.count(0) / n) < 1e-12
    assert not blockstats.features(np.zeros((2, 0), np.uint8)).any()


def test_image_source(spark, tmp_path):
    data = rand("image", 512 * 70 + 100)
    (tmp_path / "a.img").write_bytes(data)
    (tmp_path / "empty.img").write_bytes(b"")
    df = blockimage.read_images(spark, str(tmp_path), partition_bytes=512 * 16)
    rows = df.orderBy("block_id").collect()
    assert len(rows) == 71 and b"".join(r.data for r in rows) == data and rows[-1].offset == 70 * 512
    part = blockimage.read_images(spark, str(tmp_path / "a.img"), start_block=3, end_block=9)
    assert sorted(r.block_id for r in part.collect()) == list(range(3, 10))
    assert blockimage.read_block(str(tmp_path / "a.img"), 70) == data[-100:]
    for k in (71, -1):
        with pytest.raises(IndexError):
            blockimage.read_block(str(tmp_path / "a.img"), k)
    assert blockimage.hash_file(str(tmp_path / "a.img")) == hashlib.sha256(data).hexdigest()
    with pytest.raises(Exception, match="FileNotFound|nothing"):
        blockimage.read_images(spark, str(tmp_path / "nothing.img")).count()


def test_images_of_one_name_and_pushed_filters(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "disk.img").write_bytes(rand(folder, 512 * 40))
    df = blockimage.read_images(spark, str(tmp_path), partition_bytes=512 * 4)
    assert {(r.image_id, r["count"]) for r in df.groupBy("image_id").count().collect()} == {("a/disk.img", 40), ("b/disk.img", 40)}
    some = df.filter("block_id >= 5 and block_id < 9 and image_id = 'b/disk.img'")
    assert sorted(r.block_id for r in some.collect()) == [5, 6, 7, 8] and some.rdd.getNumPartitions() == 1
    assert df.filter("block_id = 11").rdd.getNumPartitions() == 2 and df.filter("block_id = 99").count() == 0
    assert df.filter("image_id in ('a/disk.img', 'x') and block_id > 37").count() == 2


def test_split_images(spark, tmp_path):
    rows = [(i, k, k * 512, rand(f"{i}{k}", 512 if (i, k) != ("y", 29) else 77)) for i in "xy" for k in range(30)]
    blockimage.write_images(spark.createDataFrame(rows, BLOCKS).repartition(5), f"file://{tmp_path}/out")
    df = blockimage.read_images(spark, f"file://{tmp_path}/out")
    assert sorted((r.image_id, r.block_id, r.offset, bytes(r.data)) for r in df.collect()) == rows
    assert [r.block_id for r in df.filter("block_id between 7 and 9 and image_id = 'y'").orderBy("block_id").collect()] == [7, 8, 9]


def test_override_matrix(spark):
    rows = [("RANDOM_WIPE", "NORMAL", 0.7, True), ("RANDOM_WIPE", "NORMAL", 0.69, False), ("NORMAL", "MULTI_PASS", 0.9, True), ("LIKELY_FF_WIPE", "NORMAL", 0.8, True), ("ZERO_WIPE", "NORMAL", 0.99, False), ("NORMAL", "NORMAL", 0.99, False)]
    df = spark.createDataFrame(rows, "base string, ml string, c double, expected boolean")
    assert all(r.got == r.expected for r in df.withColumn("got", labels.override(F.col("base"), F.col("ml"), F.col("c"))).collect())


def test_runs_in_sql(spark):
    """The table function against a plain fold; rows come in any order, ids have gaps and two stretches meet."""
    import itertools
    import random

    from tessera.functions.registered import register

    register(spark)
    g = random.Random(4)
    ids = [*range(50), *range(60, 90), *range(65_520, 65_560)]
    rows = [(i, k, g.random() < 0.6, g.random(), "x") for i in ("a", "b") for k in ids]
    spark.createDataFrame(g.sample(rows, len(rows)), "image_id string, block_id long, is_suspicious boolean, entropy double, other string").repartition(5).createOrReplaceTempView("labels_of_test")
    got = sorted(map(tuple, spark.sql("SELECT image_id, is_suspicious, first_block, last_block, n, round(sum_entropy, 9) FROM block_runs(TABLE(labels_of_test))").collect()))
    want = []
    for _, run in itertools.groupby(enumerate(rows), lambda x: (x[1][0], x[1][2], x[1][1] - x[0], x[1][1] >> 16)):
        own = [r for _, r in run]
        want.append((own[0][0], own[0][2], own[0][1], own[-1][1], len(own), round(sum(r[3] for r in own), 9)))
    assert got == sorted(want)
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM block_runs(TABLE(SELECT 1 AS image_id))").collect()


def test_sizes_beyond_a_long(spark, tmp_path):
    """Cubes of event ids as text, against exact fractions; 65,536 is a tie in PB."""
    from fractions import Fraction

    from tessera.plans.catalogue import QUERIES

    def tenths(n, unit):
        x = round(Fraction(10 * n, unit))  # halves to the even one
        return f"{x // 10}.{x % 10}"

    ids = [0, 1, 6, 7, 64, 4_095, 65_536, 131_036, 131_100, 999_999, 1_000_000, 5_999_999, 36_000_000, 50_000_000_000, None]
    spark.createDataFrame([(k,) for k in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    for r in QUERIES["format_bytes"](spark, str(tmp_path)).collect():
        if r.event_id is None:
            assert (r.gb, r.tb, r.floored, r.floored0) == (None,) * 4
            continue
        n = r.event_id**3 * 4097
        i = next((i for i in range(5) if n < 1024 ** (i + 1)), 5)
        a, b = min(i, 4), min(i, 5)
        assert r.gb == f"{tenths(n, 1024**a)} {['B', 'KB', 'MB', 'GB', 'TB'][a]}" and r.tb == f"{tenths(n, 1024**b)} {['B', 'KB', 'MB', 'GB', 'TB', 'PB'][b]}"
        assert r.floored == r.floored0 == f"{n // 1024**a} {['B', 'KB', 'MB', 'GB', 'TB'][a]}"
