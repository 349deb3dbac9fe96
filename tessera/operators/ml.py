"""Model labels for blocks: training set, ensemble of tree models, mean vote."""

from __future__ import annotations

import bz2
import hashlib
import json
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blockstats import FEATURES, feature_batches, features
from .extratrees import ExtraTrees
from .extratrees import fit as fit_extra

# Label ids.
LABELS = ["RANDOM_WIPE", "NORMAL", "ZERO_WIPE", "FF_WIPE", "MULTI_PASS"]
BLOCK = 512
#: Tasks of a pass over the training set for the extremely random trees, whose number of rows is given; it comes as many partitions with a label each, or none.
TASKS = 4
#: Families of training blocks: name, label id, share of the base count n.
FAMILIES = [
    ("random", 0, 1.0), ("prng", 0, 1 / 3), ("zlib", 1, 1.0), ("bz2", 1, 0.5), ("cipher", 1, 0.5), ("picture", 1, 0.5), ("mixed", 1, 1 / 3), ("record", 1, 1.0),
    ("zero", 2, 1.0), ("ff", 3, 1.0), ("pattern", 4, 1.0),
]


def _block(kind: str, g: np.random.Generator) -> bytes:
    some = g.integers(0, 256, BLOCK, dtype=np.uint8)
    if kind in ("random", "prng", "cipher"):
        return some.tobytes()
    if kind in ("zlib", "bz2"):
        text = bytes(g.integers(97, 97 + int(g.integers(6, 26)), 6000, dtype=np.uint8))
        data = zlib.compress(text, 9) if kind == "zlib" else bz2.compress(text)
        return data[:BLOCK].ljust(BLOCK, b"\0")
    if kind == "picture":
        return b"\xff\xd8\xff\xe0" + np.clip(g.normal(128, 45, BLOCK - 4), 0, 255).astype(np.uint8).tobytes()
    if kind == "mixed":
        head = bytes(g.integers(32, 127, 128, dtype=np.uint8))
        return head + some[:384].tobytes()
    if kind == "record":
        out = np.zeros(BLOCK, np.uint8)
        out[:4] = (0x46, 0x49, 0x4C, 0x45)
        at = g.choice(np.arange(4, BLOCK), int(g.integers(60, 260)), replace=False)
        out[at] = some[: len(at)]
        return out.tobytes()
    if kind in ("zero", "ff"):
        out = np.full(BLOCK, 0 if kind == "zero" else 255, np.uint8)
        at = g.choice(BLOCK, int(g.integers(0, 12)), replace=False)
        out[at] = some[: len(at)]
        return out.tobytes()
    unit = bytes(g.integers(0, 256, int(g.integers(2, 4)), dtype=np.uint8))
    return (unit * BLOCK)[:BLOCK]


def training_set(spark: SparkSession, n: int = 1500, seed: int = 42) -> DataFrame:
    """label, features of seeded synthetic blocks: n per family times its share."""
    rows = [(kind, label, i) for kind, label, share in FAMILIES for i in range(round(n * share))]
    table = spark.createDataFrame(rows, "kind string, label int, i int")

    def make(batches):
        for b in batches:
            kinds, labels, at = (b.column(c).to_pylist() for c in range(3))
            blocks = [_block(k, np.random.default_rng([seed, i, sum(k.encode())])) for k, i in zip(kinds, at)]
            x = features(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, BLOCK)) if blocks else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], ["label", "features"])

    return table.mapInArrow(make, "label double, features array<double>")


class Ensemble:
    """A forest, extremely random trees and boosted trees per label.

    summary: the model's version, training rows, features, folds' scores, sizes and training time; available is
    whether the model can be used.
    """

    def __init__(self, forest, extra: ExtraTrees | None, boosted: list, summary: dict | None = None):
        self.forest, self.extra, self.boosted, self.summary = forest, extra, boosted, summary or {}

    @property
    def available(self) -> bool:
        return bool(self.forest and self.extra and self.boosted)

    def save(self, folder: str) -> None:
        """The summary is written last: a folder that has it is whole."""
        for name, m in (("forest", self.forest), *((f"boosted-{i}", m) for i, m in enumerate(self.boosted))):
            m.write().overwrite().save(f"{folder}/{name}")
        spark = SparkSession.active()
        spark.createDataFrame([(self.extra.to_bytes(),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/extra")
        spark.createDataFrame([(json.dumps(self.summary),)], "summary string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")

    @classmethod
    def load(cls, folder: str) -> Ensemble:
        spark = SparkSession.active()
        summary = json.loads(spark.read.text(f"{folder}/summary").first()[0])
        extra = ExtraTrees.from_bytes(spark.read.parquet(f"{folder}/extra").first().model)
        return cls(RandomForestClassificationModel.load(f"{folder}/forest"), extra, [GBTClassificationModel.load(f"{folder}/boosted-{i}") for i in range(len(LABELS))], summary)


def _forest(trees: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=15, minInstancesPerNode=2, seed=seed)


def cross_validated(data: DataFrame, trees: int = 200, folds: int = 5) -> tuple[float, float]:
    """Mean and deviation of the macro F of the forest over folds; each fold has the same share of every label.

    data: label, vector, weight, fold.
    """
    scores = []
    for k in range(folds):
        fitted = _forest(trees, 42).fit(data.filter(F.col("fold") != k))
        scores.append(macro_f1(fitted.transform(data.filter(F.col("fold") == k))))
    return float(np.mean(scores)), float(np.std(scores))


def version_of(rows: int, mean: float) -> str:
    return "v2-" + hashlib.sha256(f"{rows}:{mean:.6f}".encode()).hexdigest()[:12]


def train(spark: SparkSession, n: int = 1500, trees: int = 200, rounds: int = 150, folds: int = 5) -> Ensemble:
    """The ensemble, fitted on the training set with labels weighted alike; folds: for its scores, 0 for none."""
    started = time.monotonic()
    data = training_set(spark, n).withColumn("vector", array_to_vector("features"))
    size = {r.label: r.n for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}  # five rows
    weight = F.element_at(F.create_map(*(F.lit(x) for k, v in size.items() for x in (k, sum(size.values()) / len(size) / v))), F.col("label"))
    place = Window.partitionBy("label").orderBy(F.xxhash64("features"))  # a label has a few thousand rows
    data = data.withColumn("weight", weight).withColumn("fold", F.row_number().over(place) % F.lit(max(folds, 1))).persist()
    forest, extra = _forest(trees, 42).fit(data), fit_extra(data.coalesce(TASKS), len(LABELS), trees)
    boosted = []
    for k in range(len(LABELS)):
        own = data.withColumn("label", (F.col("label") == k).cast("double"))
        boosted.append(GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, stepSize=0.08, maxDepth=6, subsamplingRate=0.8, seed=42).fit(own))
    mean, deviation = cross_validated(data, trees, folds) if folds else (0.0, 0.0)
    data.unpersist()
    rows = sum(size.values())
    summary = {
        "model_version": version_of(rows, mean), "n_training_samples": rows, "n_features": FEATURES, "training_time_s": round(time.monotonic() - started, 2),
        "cv_scores": {"f1_macro_mean": round(mean, 4), "f1_macro_std": round(deviation, 4)} if folds else {}, "models": [f"RF-{trees}", f"ET-{trees}", f"GBT-{rounds}"], "available": True,
    }
    return Ensemble(forest, extra, boosted, summary)


def cached(spark: SparkSession, folder: str, **sizes) -> Ensemble:
    """The ensemble of these sizes (see train) that is saved below folder, trained and saved there first if it isn't.

    One that isn't whole is trained again; any other error is raised.
    """
    name = "-".join([f"{k}{v}" for k, v in sorted(sizes.items())]) or "full"
    try:
        spark.read.text(f"{folder}/{name}/summary")
        return Ensemble.load(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        model = train(spark, **sizes)
        model.save(f"{folder}/{name}")
        return model


def mean_vote(votes: list) -> F.Column:
    """The element-wise mean of arrays of probabilities."""
    out = votes[0]
    for v in votes[1:]:
        out = F.zip_with(out, v, lambda a, b: a + b)
    return F.transform(out, lambda x: x / len(votes))


def label_of(mean) -> tuple:
    """(label, confidence) of an array of probabilities: its largest, of equal ones the first."""
    top = F.array_max(mean)
    return F.element_at(F.array(*map(F.lit, LABELS)), F.array_position(mean, top).cast("int")), top


def predict(blocks: DataFrame, model: Ensemble) -> DataFrame:
    """image_id, block_id, ml_label, ml_confidence, votes of blocks (image_id, block_id, data)."""
    extra = model.extra.batches("p_et")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = f"image_id {kinds['image_id']}, block_id {kinds['block_id']}, features array<double>, p_et array<double>"
    y = blocks.select("image_id", "block_id", "data").mapInArrow(lambda batches: extra(feature_batches(batches)), schema)  # in one pass
    y = y.withColumn("vector", array_to_vector("features"))
    for name, m in (("rf", model.forest), *((f"gb{i}", m) for i, m in enumerate(model.boosted))):
        m = m.copy().setProbabilityCol(f"p_{name}").setRawPredictionCol(f"r_{name}").setPredictionCol(f"y_{name}")
        y = m.transform(y).drop(f"r_{name}", f"y_{name}").withColumn(f"p_{name}", vector_to_array(f"p_{name}"))
    alone = F.array(*(F.col(f"p_gb{i}")[1] for i in range(len(LABELS))))
    total = F.aggregate(alone, F.lit(1e-12), lambda a, b: a + b)
    y = y.withColumn("p_gb", F.transform(alone, lambda p: p / total))
    label, sure = label_of(mean_vote([F.col("p_rf"), F.col("p_et"), F.col("p_gb")]))
    votes = F.create_map(*(x for n in ("rf", "et", "gb") for x in (F.lit(n), label_of(F.col(f"p_{n}"))[0])))
    return y.select("image_id", "block_id", label.alias("ml_label"), sure.alias("ml_confidence"), votes.alias("votes"))


def macro_f1(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    """Mean of the labels' F scores, each label counting alike."""
    e = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="fMeasureByLabel")
    labels = [r[0] for r in predicted.select(label).distinct().collect()]
    return float(np.mean([e.evaluate(predicted, {e.metricLabel: x}) for x in labels]))
