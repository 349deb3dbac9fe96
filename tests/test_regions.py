import random

from pyspark.sql import functions as F

from tessera.functions.labels import PARTIAL, STRONG
from tessera.operators import regions as R
from tessera.operators import scoring, segments

SCHEMA = "image_id string, block_id long, wipe_type string, entropy double, confidence double, is_suspicious boolean"
TYPES = [*STRONG, *PARTIAL]


def fold(rows):
    """The regions of one image, block by block."""
    runs, now = [], []
    for r in rows:
        if r[5]:
            now.append(r)
        elif now:
            runs.append(now)
            now = []
    if now:
        runs.append(now)
    by_id = {r[1]: r for r in rows}
    out = []
    for run in runs:
        count = {}
        for r in run:
            count[r[2]] = count.get(r[2], 0) + 1
        t = max(count, key=lambda k: (count[k], -next(i for i, r in enumerate(run) if r[2] == k)))
        ids = [r[1] for r in run]
        if out and out[-1]["t"] == t and ids[0] - out[-1]["ids"][-1] - 1 <= 8:
            gap = list(range(out[-1]["ids"][-1] + 1, ids[0]))
            out[-1]["quirk"] = out[-1]["ids"] + ids
            out[-1]["ids"] = out[-1]["ids"] + gap + ids
        else:
            out.append({"t": t, "ids": ids, "quirk": ids})
    out = [r | {"e": sum(by_id[i][3] for i in r["quirk"]) / len(r["quirk"])} for r in out if len(r["ids"]) >= 16]
    merged, k = [], 0
    while k < len(out):
        z = k
        while z + 1 < len(out) and out[z + 1]["ids"][0] - out[z]["ids"][-1] - 1 <= 4 and out[z + 1]["t"] != out[z]["t"] and out[z]["t"] in STRONG and out[z + 1]["t"] in STRONG:
            z += 1
        if z - k >= 2:
            ids = [i for r in out[k : z + 1] for i in r["ids"]]
            merged.append({"t": "MULTI_PASS", "ids": ids, "e": sum(by_id[i][3] for i in ids) / len(ids)})
        else:
            merged += out[k : z + 1]
        k = z + 1
    strong = {i for r in merged if r["t"] in STRONG for i in r["ids"]}
    keep = [r for r in merged if r["t"] not in PARTIAL or len(r["ids"]) >= 64 or strong & set(range(max(0, r["ids"][0] - 50), r["ids"][-1] + 51))]
    res = []
    for r in keep:
        n = len(r["ids"])
        c = sum(by_id[i][4] for i in r["ids"]) / n + 0.1 * min(n / 512, 1) + 0.1 * (sum(by_id[i][5] for i in r["ids"]) / n - 0.5) + R.TYPE_ADJUST[r["t"]]
        res.append((r["ids"][0] * 512, (r["ids"][-1] + 1) * 512 - 1, r["t"], n, round(r["e"], 6), max(0.0, min(1.0, c))))
    return res


def image(name, seed, n=400):
    g, rows, k = random.Random(seed), [], 0
    while k < n:
        bad, size, t = g.random() < 0.6, g.choice([1, 2, 4, 5, 8, 9, 15, 16, 20, 50, 64]), g.choice(TYPES)
        for _ in range(size):
            label = (g.choice(TYPES) if g.random() < 0.05 else t) if bad else "NORMAL"
            rows.append((name, k, label, g.randrange(8000) / 1000, 0.5 + g.randrange(400) / 1000, bad))
            k += 1
    return rows


def test_regions_equal_a_plain_fold(spark):
    images = {f"i{s}": image(f"i{s}", s) for s in range(40)} | {"every other": [("every other", k, TYPES[k // 2 % 3 if k > 300 else 0], 1.0, 0.9, k % 2 == 0) if k % 2 == 0 else ("every other", k, "NORMAL", 2.0, 0.8, False) for k in range(600)]} | {"clean": [("clean", k, "NORMAL", 1.0, 0.9, False) for k in range(50)], "full": [("full", k, "ZERO_WIPE", 0.0, 1.0, True) for k in range(100)]}
    df = spark.createDataFrame([r for rows in images.values() for r in rows], SCHEMA).repartition(5)
    for bits in (16, 5, 3):  # stretches that cut runs, regions, chains and their neighbourhoods give the same
        got = R.aggregate(df, None, bits).collect()
        for name, rows in images.items():
            own = sorted((r for r in got if r.image_id == name), key=lambda r: r.id)
            want = fold(rows)
            assert [r.id for r in own] == list(range(1, len(want) + 1))
            assert [(r.start, r.end, r.type, r.block_count) for r in own] == [w[:4] for w in want], name
            assert all(abs(r.entropy - w[4]) < 2e-6 and abs(r.confidence - w[5]) <= 0.00051 for r, w in zip(own, want))


def test_boundary(spark):
    rows = [("a", 10, 29), ("a", 90, 109), ("a", 95, 114), ("a", 200, 220), ("b", 0, 20), ("c", 0, 20)]
    df = spark.createDataFrame([(i, a, z, "ZERO_WIPE", z - a + 1, z - a + 1, 0.0, 0.0, 0.0, 0.2) for i, a, z in rows], "image_id string, first_block long, last_block long, wipe_type string, block_count long, n_susp long, full_entropy double, full_confidence double, avg_entropy double, confidence double")
    maps = spark.createDataFrame([("a", "MBR", 100 * 512 - 1), ("b", "MBR", None), ("c", "UNKNOWN", 5)], "image_id string, scheme string, last_end long")
    got = {(r.image_id, r.first_block): (r.boundary_context, r.confidence) for r in R.with_boundary(df, maps).collect()}
    assert got["a", 10] == ("INSIDE_PARTITION", 0.24)
    assert got["a", 90][0] == "INSIDE_PARTITION"  # half of it is beyond, not more
    assert got["a", 95] == ("BEYOND_BOUNDARY", 0.1) and got["a", 200][0] == "BEYOND_BOUNDARY"
    assert got["b", 0][0] == got["c", 0][0] == "UNKNOWN"


def test_score_rules(spark):
    floors = [(0.31, 9, 3), (0.30, 9, 2), (0.10, 9, 1), (0.02, 2, 1), (0.02, 1, 0)]
    df = spark.createDataFrame(floors, "d double, n long, want int")
    assert all(r.got == r.want for r in df.withColumn("got", scoring.density_floor(F.col("d"), F.col("n"))).collect())
    p = scoring.penalties(F.col("n"), F.col("p"), F.col("s"), F.col("c"), F.col("b"), F.col("r"), F.col("m"))
    cases = [(5, 3, 2, 0.6, 0, 1, False, 10), (50, 30, 10, 0.549, 0, 1, False, 5), (5, 0, 5, 0.55, 3, 10, True, 0), (5, 0, 5, 0.6, 4, 10, True, 7), (5, 0, 5, 0.6, 7, 10, True, 15), (5, 0, 5, 0.6, 7, 10, False, 0)]
    df = spark.createDataFrame(cases, "n int, p int, s int, c double, b int, r int, m boolean, want int")
    assert all(r.got == r.want for r in df.withColumn("got", p).collect())
    assert [r.x for r in spark.createDataFrame([(72.5,), (73.5,)], "v double").select(F.bround("v", 0).alias("x")).collect()] == [72.0, 74.0]


def test_no_window_over_an_image(spark):
    """Windows of a scan have a stretch's rows or an image's summaries, one a stretch."""
    df = spark.createDataFrame([("i", k, "NORMAL" if k % 2 else "ZERO_WIPE", 1.0, 0.9, k % 2 == 0) for k in range(4096)], SCHEMA)
    one = segments.islands(df.selectExpr("image_id", "block_id AS first_block", "block_id AS last_block", "is_suspicious"), ["is_suspicious"], lambda a, b: a["is_suspicious"] == b["is_suspicious"], bits=6)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if " Window [" in line]
    assert over and all("stretch" in line.split("], [")[1] or "stretch" in line.split("], [")[2] for line in over)
    assert one.select("island").distinct().count() == 4096
    found = R.aggregate(df, None, 6).collect()
    assert [(r.start, r.end, r.type) for r in found] == [(0, 4095 * 512 - 1, "ZERO_WIPE")]
