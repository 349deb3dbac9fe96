"""Scattered re-reads, hashes of files and ranges, and joins of points with intervals."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals, partitions, regions
from tessera.sources import ranges
from tessera.sources.blockimage import BLOCK, write_images


@pytest.fixture
def images(spark, tmp_path):
    """Two whole images, one of them with a short last block, an empty one, and a split one."""
    data = {"a.img": random.Random(1).randbytes(3000 * BLOCK), "sub/b.img": random.Random(2).randbytes(700 * BLOCK + 99), "none.img": b""}
    for name, x in data.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(x)
    split = [("s", k, bytes([k % 251]) * BLOCK) for k in range(900)]
    write_images(spark.createDataFrame(split, "image_id string, block_id long, data binary").repartition(3), str(tmp_path / "in"))
    data["s"] = b"".join(x for *_, x in split)
    return str(tmp_path / "in"), data


def test_reread(spark, images):
    path, data = images
    g = random.Random(3)
    ids = {"a.img": [*range(100, 400), *range(900, 1100, 2), *g.sample(range(3000), 60), 2999], "sub/b.img": [0, 700, 3, 3, 3], "s": [*range(0, 900, 7), 899]}
    wanted = [(i, k) for i, ks in ids.items() for k in ks] + [("a.img", 3000), ("a.img", -1), ("none.img", 0), ("missing", 0), (None, 1), ("a.img", None)]
    df = spark.createDataFrame(wanted, "image_id string, block_id long").repartition(4)
    got = ranges.reread(spark, df, path).collect()
    want = {(i, k) for i, ks in ids.items() for k in ks}
    assert {(r.image_id, r.block_id) for r in got} == want and len(got) == len(want)
    assert all(r.offset == r.block_id * BLOCK and bytes(r.data) == data[r.image_id][r.offset : r.offset + BLOCK] for r in got)
    cut = ranges.coalesced(df, ranges.image_table(spark, path)).collect()
    assert sum(r.last + 1 - r.first for r in cut) <= 2 * len(want)
    assert any(len(r.wanted) == 300 for r in cut) and len(cut) < 0.6 * len(want)  # neighbours are read at once
    assert ranges.reread(spark, df.limit(0), path).count() == 0


def test_hashes(spark, images, tmp_path):
    path, data = images
    got = {r.image_id: (r.n_bytes, r.sha256) for r in ranges.image_hashes(spark, path).collect()}
    assert got == {i: (len(x), hashlib.sha256(x).hexdigest()) for i, x in data.items()}
    before = ranges.manifest(spark, path, 100_000)
    rows = before.collect()
    assert all(r.sha256 == hashlib.sha256(open(r.path, "rb").read()[r.offset : r.offset + r.n_bytes]).hexdigest() for r in rows)
    assert sum(r.n_bytes for r in rows) == sum(map(len, data.values())) and max(r.n_bytes for r in rows) == 100_000
    before = spark.createDataFrame(rows, before.schema)
    assert ranges.changed(before, ranges.manifest(spark, path, 100_000)).count() == 0
    roots = {r.image_id: r.root for r in ranges.manifest_roots(before).collect()}
    x = bytearray(data["a.img"])
    x[250_000] ^= 1
    (tmp_path / "in" / "a.img").write_bytes(bytes(x) + b"more")
    now = ranges.manifest(spark, path, 100_000)
    assert sorted((r.offset, r.state) for r in ranges.changed(before, now).collect()) == [(200_000, "changed"), (1_500_000, "changed")]
    after = {r.image_id: r.root for r in ranges.manifest_roots(now).collect()}
    assert {i for i in after if after[i] != roots[i]} == {"a.img"}


@pytest.mark.parametrize("top", [3, 26, 62])
def test_intervals(spark, top):
    g = random.Random(4)
    rows = [(f"k{g.randrange(3)}", n, a := g.randrange(400), a + g.choice([-1, 0, 1, 3, 60, 500])) for n in range(120)] + [("k1", 500, 0, 2**40), ("k2", 501, None, 4), (None, 502, 0, 9)]
    points = [(g.choice(["k0", "k1", "k2", "other", None]), g.choice([None, g.randrange(-5, 900)])) for _ in range(300)] + [("k1", 2**40)]
    if top == 3:
        rows = [r for r in rows if (r[3] or 0) < 2**40]
    got = intervals.containing(spark.createDataFrame(points, "image_id string, p long"), spark.createDataFrame(rows, "image_id string, n long, a long, z long"), "p", "a", "z", top=top)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = sorted((i, p, n) for i, p in points for k, n, a, z in rows if i is not None and i == k and p is not None and a is not None and a <= p <= z)
    assert sorted((r.image_id, r.p, r.n) for r in got.collect()) == want
    assert intervals.containing(spark.createDataFrame(points, "image_id string, p long"), spark.createDataFrame([], "image_id string, n long, a long, z long"), "p", "a", "z").count() == 0


def test_partition_of_an_offset(spark):
    rows = [("d", "MBR", 0, 10, "NTFS", 5120, 10239), ("d", "MBR", 4, 15, "Linux", 7680, 20479), ("raw", "UNKNOWN", None, None, None, None, None)]
    tables = spark.createDataFrame(rows, "image_id string, scheme string, index int, start_lba long, type_name string, start_offset long, end_offset long")
    at = [("d", 0), ("d", 5120), ("d", 9000), ("d", 10240), ("d", 20479), ("d", 20480), ("raw", 5), ("gone", 5), ("d", 9000)]
    got = partitions.partition_of(spark.createDataFrame(at, "image_id string, offset long"), tables).collect()
    want = {("d", 5120): (0, "NTFS"), ("d", 9000): (0, "NTFS"), ("d", 10240): (4, "Linux"), ("d", 20479): (4, "Linux")}
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((*k, *want.get(k, (None, None)))) for k in at)


def test_partitions_of_any_length(spark):
    """Overlapping partitions, some of more bytes than could be cut into bins, against plain Python."""
    g = random.Random(8)
    rows = [(f"d{g.randrange(3)}", n, f"t{n % 4}", a := 512 * g.randrange(40), a + 512 * g.choice([1, 2, 9, 30]) - 1) for n in range(40)] + [("d0", 90, "far", 0, (1 << 62) - 1), ("d3", 0, "big", 512, (1 << 61) - 1), ("d3", 1, "all", 0, (1 << 62) - 1)]
    tables = spark.createDataFrame(rows, "image_id string, index int, type_name string, start_offset long, end_offset long").withColumn("start_lba", F.col("start_offset") / 512)
    at = [(g.choice(["d0", "d1", "d2", "d3", "none", None]), g.choice([None, g.randrange(-600, 40_000), 1 << 61, (1 << 62) - 1, 1 << 62])) for _ in range(400)]
    got = partitions.partition_of(spark.createDataFrame(at, "image_id string, offset long").withColumn("same", F.col("offset")), tables)
    want = [(i, x, min(((n, t) for k, n, t, a, z in rows if k == i and x is not None and a <= x <= z), default=(None, None))) for i, x in at]
    assert sorted(str((r.image_id, r.offset, (r["index"], r.type_name))) for r in got.collect()) == sorted(map(str, want))
    assert got.filter("same <=> offset").count() == len(at)


@pytest.mark.parametrize("bits", [2, 5, 26])
def test_last_marks(spark, bits):
    g = random.Random(bits)
    marks = {(g.choice("ab"), g.randrange(-40, 300)): g.choice([None, 1, 2, 3]) for _ in range(30)}
    points = [(g.choice(["a", "b", "c", None]), g.choice([None, g.randrange(-60, 400)])) for _ in range(300)]
    got = intervals.last_mark(spark.createDataFrame(points, "image_id string, p long"), spark.createDataFrame([(*k, v) for k, v in marks.items()], "image_id string, p long, v int"), "p", "v", bits=bits)
    want = [(i, x, marks[max(k for k in marks if k[0] == i and k[1] <= x)] if x is not None and any(k[0] == i and k[1] <= x for k in marks) else None) for i, x in points]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_blocks_of_regions(spark):
    found = spark.createDataFrame([("i", 1, "ZERO_WIPE", 0, 10 * 512 - 1), ("i", 2, "FF_WIPE", 5 * 512, 7 * 512 - 1), ("j", 1, "ZERO_WIPE", 0, 511)], "image_id string, id long, type string, start long, end long")
    blocks = spark.createDataFrame([(i, k) for i in "ij" for k in range(12)], "image_id string, block_id long")
    got = {(r.image_id, r.block_id, r.region_id, r.region_type) for r in regions.region_blocks(blocks, found).collect()}
    assert got == {("i", k, 1, "ZERO_WIPE") for k in range(10)} | {("i", k, 2, "FF_WIPE") for k in (5, 6)} | {("j", 0, 1, "ZERO_WIPE")}
