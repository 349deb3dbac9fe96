"""Extremely random trees: as good as a forest, the same each time, and right about their own counts."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import extratrees, ml


@pytest.fixture(scope="module")
def data(spark):
    d = ml.training_set(spark, 250).withColumn("weight", F.lit(1.0)).withColumn("fold", F.pmod(F.xxhash64("features"), F.lit(4)))
    return d.repartition(3).persist()


def score(predicted):
    top = F.array_max("p")
    return ml.macro_f1(predicted.withColumn("prediction", (F.array_position("p", top) - 1).cast("double")))


def test_as_good_as_a_forest(spark, data):
    train, test = data.filter("fold <> 0"), data.filter("fold = 0")
    model = extratrees.fit(train, 5, trees=40, max_depth=12)
    forest = ml._forest(40, 42).fit(train.withColumn("vector", array_to_vector("features")))
    f = ml.macro_f1(forest.transform(test.withColumn("vector", array_to_vector("features"))))
    assert score(model.transform(test.select("features", "label"), "p")) >= f - 0.01
    again = extratrees.fit(train.repartition(7), 5, trees=40, max_depth=12)
    assert (again.feature == model.feature).all() and np.allclose(again.threshold, model.threshold)
    copy = extratrees.ExtraTrees.from_bytes(model.to_bytes())
    x = np.array([r.features for r in test.collect()])
    assert (copy.probabilities(x) == model.probabilities(x)).all() and np.allclose(model.probabilities(x).sum(1), 1)


def test_nodes_hold_what_comes_to_them(spark, data):
    rows = data.collect()
    x, y = np.array([r.features for r in rows]), np.array([int(r.label) for r in rows])
    model = extratrees.fit(data, 5, trees=3, max_depth=6, min_leaf=4)
    leaves = model.leaves(x)
    assert model.feature.shape == model.threshold.shape == model.left.shape == (len(model.value),)
    for t in range(3):
        for leaf in np.unique(leaves[:, t]):
            own = y[leaves[:, t] == leaf]
            assert len(own) >= 4 and np.allclose(np.bincount(own, minlength=5) / len(own), model.value[leaf])


def test_small_tables(spark):
    kind = "features array<double>, label double, weight double"
    one = spark.createDataFrame([([0.0, 1.0], 1.0, 1.0)] * 5, kind)  # nothing to split
    assert extratrees.fit(one, 2, trees=4).feature.tolist() == [-1] * 4
    two = spark.createDataFrame([([0.0, 1.0], 0.0, 1.0)] * 3 + [([2.0, 1.0], 1.0, 3.0)] * 3, kind)
    m = extratrees.fit(two, 2, trees=4, drawn=2)
    assert m.probabilities(np.array([[0.0, 1.0], [2.0, 1.0]])).round(6).tolist() == [[1, 0], [0, 1]]
