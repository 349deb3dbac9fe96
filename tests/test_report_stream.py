"""Reports, sinks, model labels and streams on small tables."""

import datetime
import hashlib
import json
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import blocks, custody, ml, regions, report, scoring
from tessera.sources import sinks
from tessera.streaming import images

LABELLED = "image_id string, block_id long, offset long, wipe_type string, entropy double, confidence double, is_suspicious boolean"


def labelled(spark):
    rows = [("low", k, k * 512, "ZERO_WIPE" if k < 2 else "NORMAL", 1.0, 0.9, k < 2) for k in range(300)]
    for k in range(300):
        t = "NORMAL"
        for i, kind in enumerate(("ZERO_WIPE", "FF_WIPE", "RANDOM_WIPE")):
            if 50 + 42 * i <= k < 90 + 42 * i:
                t = kind
        rows.append(("high", k, k * 512, t, 7.5 if t == "RANDOM_WIPE" else 0.1, 0.8, t != "NORMAL"))
    return spark.createDataFrame(rows, LABELLED)


def test_scores_reports_and_files(spark, tmp_path):
    lab = labelled(spark)
    found = regions.aggregate(lab)
    s = scoring.score(lab, found)
    got = {r.image_id: r for r in s.collect()}
    assert got["low"].verdict == "LOW" and got["low"].regions_count == 0 and got["low"].intent_score == 3
    assert got["high"].verdict == "HIGH" and got["high"].dominant_type == "MULTI_PASS" and got["high"].multi_regions == 1
    docs = {r.image_id: json.loads(r.report) for r in report.documents(s, found).collect()}
    assert docs["high"]["pattern_analysis"]["basis"] == "random and zero" and docs["high"]["reliability"]["reliability_level"] == "MEDIUM"
    assert docs["high"]["recommended_actions"][0]["priority"] == "IMMEDIATE" and docs["low"]["recommended_actions"][-1]["action"] == "Evidence Hash Verification"
    log = custody.chained(spark.createDataFrame([("high", 0, "t", "SYSTEM_INIT", None, "d")], "session_id string, sequence int, timestamp_utc string, event_type string, sha256_evidence string, description string"))
    out = sinks.result_documents(s, found, report.documents(s, found), custody.summary(log))
    one = {r.image_id: json.loads(r.document) for r in out.collect()}
    assert one["high"]["chain_of_custody"]["total_entries"] == 1 and one["high"]["regions"][0]["type"] == "MULTI_PASS"
    sinks.write_results(str(tmp_path / "out"), lab, found, out)
    assert spark.read.parquet(str(tmp_path / "out/blocks")).count() == 600


def test_no_blocks(spark):
    lab = spark.createDataFrame([], LABELLED)
    found = regions.aggregate(lab)
    assert found.count() == 0 and scoring.score(lab, found).count() == 0 and blocks.candidates(lab).count() == 0


def test_model_labels(spark, tmp_path):
    sizes = {"n": 30, "trees": 5, "rounds": 2, "folds": 2}
    first = ml.cached(spark, str(tmp_path / "model"), **sizes)
    model = ml.cached(spark, str(tmp_path / "model"), **sizes)
    assert model.available and model.summary == first.summary and not ml.Ensemble(None, None, []).available
    assert model.summary["cv_scores"]["f1_macro_mean"] > 0.8 and model.summary["n_training_samples"] == 245
    assert model.summary["model_version"] .startswith("v2-")
    noise = lambda s: b"".join(hashlib.sha256(f"{s}:{i}".encode()).digest() for i in range(16))
    rows = [("i", 0, bytes(512)), ("i", 1, b"\xff" * 512), ("i", 2, noise(1)), ("i", 3, b"\x55\xaa" * 256)]
    got = {r.block_id: r for r in ml.predict(spark.createDataFrame(rows, "image_id string, block_id long, data binary"), model).collect()}
    assert [got[k].ml_label for k in range(4)] == ["ZERO_WIPE", "FF_WIPE", "RANDOM_WIPE", "MULTI_PASS"]
    assert all(0 < r.ml_confidence <= 1 and set(r.votes) == {"rf", "et", "gb"} for r in got.values())


def test_models_have_the_surveyed_settings(spark):
    model = ml.train(spark, n=6, trees=2, rounds=1, folds=0)
    m = model.forest
    assert (m.getMaxDepth(), m.getMinInstancesPerNode(), m.getWeightCol(), m.getSeed()) == (15, 2, "weight", 42)
    assert model.extra.trees == 2 and model.extra.value.shape[1] == 5
    assert all((m.getMaxDepth(), m.getStepSize(), m.getSubsamplingRate()) == (6, 0.08, 0.8) for m in model.boosted)


def test_training_set_is_the_same_each_time(spark):
    a, b = (sorted((r.label, tuple(r.features)) for r in ml.training_set(spark, 6).collect()) for _ in range(2))
    assert a == b and len({x[0] for x in a}) == 5


def test_stream_equals_batch(spark, tmp_path):
    """Images in many batches, out of order and of several stretches; each is closed once, by the later ones, and equals the batch result."""
    g, start = random.Random(6), datetime.datetime(2024, 1, 1)
    schema, rows = LABELLED + ", ts timestamp", []
    for i in range(4):
        blocks = [*range(300), *range(65_500, 65_700)] if i < 3 else [0]
        for k in blocks:
            kind = ("ZERO_WIPE", "FF_WIPE", "RANDOM_WIPE", "NORMAL")[k // 40 % 4] if i < 3 and k % 17 else "NORMAL"
            ts = start + datetime.timedelta(seconds=g.randrange(60)) if i < 3 else start + datetime.timedelta(hours=1)
            rows.append((f"i{i}", k, k * 512, kind, g.randrange(8000) / 1000, 0.5 + g.randrange(400) / 1000, kind != "NORMAL", ts))
    early, late = rows[:-1], rows[-1:]
    g.shuffle(early)
    for part in (*(early[k::6] for k in range(6)), late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = images.block_stream(spark, str(tmp_path / "in"), 1, schema)
    q = images.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), quiet_seconds=300, late_seconds=10)
    q.awaitTermination(300)
    assert q.exception() is None
    lab = spark.createDataFrame(early, schema)
    found = regions.aggregate(lab)
    shown = ["image_id", "id", "start", "end", "type", "block_count", "n_susp"]
    got = spark.read.parquet(str(tmp_path / "out/regions"))
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, found.select(shown).collect())) and got.select("image_id").distinct().count() == 3
    close = lambda df: sorted((r.image_id, r.total_blocks, r.suspicious_blocks, r.intent_score, r.verdict, r.regions_count, round(r.avg_entropy_flagged, 6), r.n_FF_WIPE) for r in df.collect())
    assert close(spark.read.parquet(str(tmp_path / "out/scores"))) == close(scoring.score(lab, found))


def test_runs_of_blocks_in_any_order(spark):
    """What the stream keeps of blocks in parts is what a batch has of them together."""
    g = random.Random(2)
    rows = [("i", k, k * 512, t := g.choice(["NORMAL", "ZERO_WIPE", "LIKELY_FF_WIPE"]), g.random(), g.random(), t != "NORMAL") for k in [*range(200), *range(65_536, 65_600)]]
    df = spark.createDataFrame(rows, LABELLED)
    table = df.toPandas().sample(frac=1, random_state=1)
    kept = np.zeros(0, images.ROW)
    for k in range(7):
        kept = images._joined(np.concatenate([kept, images._runs_of(table.iloc[k::7])]))
    want = regions.stretch_runs(df).orderBy("first_block").collect()
    assert [(bool(r["is_suspicious"]), int(r["first_block"]), int(r["last_block"]), int(r["n"]), int(r["c_ZERO_WIPE"])) for r in kept] == [(r.is_suspicious, r.first_block, r.last_block, r.n, r.c_ZERO_WIPE) for r in want]
    assert all(abs(r["sum_entropy"] - w.sum_entropy) < 1e-9 and (w.f_LIKELY_FF_WIPE or images.NEVER) == r["f_LIKELY_FF_WIPE"] for r, w in zip(kept, want))
