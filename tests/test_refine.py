"""The model's query judges all candidates of an image, however many."""

import collections

from pyspark.sql import functions as F

from tessera.operators import blocks, ml
from tessera.plans import catalogue, synthetic


def test_all_candidates_are_refined(spark, tmp_path, monkeypatch):
    """An image with more candidates than the cap, and a small one: every candidate gets the model's label, neighbours too."""
    found = []
    scanned = catalogue._scanned
    monkeypatch.setattr(synthetic, "IMAGE_BLOCKS", 128_000)
    monkeypatch.setattr(catalogue, "_scanned", lambda images: found.append(scanned(images)) or found[0])
    monkeypatch.setattr(ml, "train", lambda *a, **k: None)
    monkeypatch.setattr(ml, "predict", lambda b, m: b.select("image_id", "block_id", F.when(F.length("data") == 512, "RANDOM_WIPE").alias("ml_label"), F.lit(0.9).alias("ml_confidence")))
    events = spark.range(128_500).select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("user_id"), F.lit("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.base_label, r.wipe_type): r.blocks for r in catalogue.QUERIES["ml_refine"](spark, str(tmp_path)).collect()}
    kinds = {(r.image_id, r.block_id): (r.wipe_type, r.is_suspicious) for r in found[0].collect()}
    near = {(i, k) for i, k in kinds if any(kinds.get((i, k + d), (None, False))[1] for d in range(-2, 3))}
    assert len({i for i, _ in kinds}) == 2 and sum(i == "img0" for i, _ in near) > blocks.CANDIDATE_CAP
    assert got == collections.Counter((t, "RANDOM_WIPE" if at in near and t == "NORMAL" else t) for at, (t, _) in kinds.items())
