"""The cap on candidates, small enough to bind, against plain Python."""

import random

import pytest

from tessera.operators import blocks


@pytest.mark.parametrize("cap", [1, 5, 60, 10_000])
def test_cap(spark, cap):
    g = random.Random(cap)
    bad = {"a": {g.randrange(400_000) for _ in range(40)}, "b": set(range(65_500, 65_600)), "c": {3}, "none": set()}
    rows = [(i, k, k in s) for i, s in bad.items() for k in sorted({k + d for k in s for d in range(-4, 5)} | {1, 2, 3}) if k >= 0]
    want = set()
    for i, s in bad.items():
        near = {k for j, k, _ in rows if j == i and any(k + d in s for d in range(-2, 3))}
        want |= {(i, k) for k in (near if len(near) <= cap else sorted(near & s)[:cap])}
    got = blocks.capped_candidates(spark.createDataFrame(rows, "image_id string, block_id long, is_suspicious boolean"), cap)
    assert got.columns == ["image_id", "block_id", "is_suspicious"]
    assert sorted((r.image_id, r.block_id) for r in got.collect()) == sorted(want)
