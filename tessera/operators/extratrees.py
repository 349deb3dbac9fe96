"""Extremely random trees, grown level by level over a distributed table.

A node that is still open draws some features and, for each, a threshold anywhere between the least and the largest
value that its rows have. So a level takes two passes over the rows: one for those ranges, one for what lies on both
sides of each threshold. Tasks sum up their own rows and the sums meet in a shuffle, as a table of node, feature and
side; the best split of each node is chosen there. The driver holds the trees, never rows.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ExtraTrees:
    """Trees in flat arrays: feature (-1 in a leaf), threshold, left (the right child is left + 1), value (shares of the labels). The first nodes are the roots."""

    def __init__(self, trees: int, labels: int):
        self.trees = trees
        self.feature, self.threshold, self.left = np.full(trees, -1, np.int32), np.zeros(trees), np.zeros(trees, np.int32)
        self.value = np.zeros((trees, labels))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of x comes to in each tree."""
        at = np.tile(np.arange(self.trees, dtype=np.int32), (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return at
            right = x[row, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, self.left[at] + right).astype(np.int32)

    def probabilities(self, x: np.ndarray, part: int = 2000) -> np.ndarray:
        """The mean of the trees' shares for each row."""
        return np.concatenate([self.value[self.leaves(x[k : k + part])].mean(1) for k in range(0, len(x), part)] or [np.zeros((0, self.value.shape[1]))])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, trees=self.trees, feature=self.feature, threshold=self.threshold, left=self.left, value=self.value)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ExtraTrees:
        z = np.load(io.BytesIO(bytes(data)))
        m = cls(int(z["trees"]), z["value"].shape[1])
        m.feature, m.threshold, m.left, m.value = z["feature"], z["threshold"], z["left"], z["value"]
        return m

    def batches(self, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """What adds the array name of probabilities to batches with features, in a task."""

        def run(batches):
            for b in batches:
                p = self.probabilities(_matrix(b.column(b.schema.get_field_index("features"))))
                lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, name])

        return run

    def transform(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (features and others that Arrow has) with the array name of probabilities."""
        return rows.mapInArrow(self.batches(name), rows.withColumn(name, F.array().cast("array<double>")).schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length and without nulls, as rows, from its buffer."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch], model: ExtraTrees, slot_of: np.ndarray) -> Iterator[tuple]:
    """(features, labels, weights, rows, slots) of the pairs of a row and an open node that it is in, by slot."""
    for b in batches:
        x = _matrix(b.column(0))
        slot = slot_of[model.leaves(x)]
        row, tree = np.nonzero(slot >= 0)
        slot = slot[row, tree]
        order = np.argsort(slot, kind="stable")
        if len(order):
            yield x, b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy(), row[order], slot[order]


def fit(data: DataFrame, labels: int, trees: int = 200, max_depth: int = 15, min_leaf: int = 2, drawn: int | None = None, seed: int = 7) -> ExtraTrees:
    """Trees on all rows of data: features (array of double), label (0, 1, ...), weight. drawn: features a node draws, by default the root of their number.

    The same data and seed give the same trees, however data is partitioned, but for sums of weights in another order.
    """
    data = data.select("features", F.col("label").cast("long").alias("label"), F.col("weight").cast("double").alias("weight"))
    width = len(data.first().features)
    drawn = drawn or max(1, int(width**0.5))
    model = ExtraTrees(trees, labels)
    total = np.zeros(labels)
    for r in data.groupBy("label").agg(F.sum("weight").alias("w")).collect():  # a row a label
        total[r.label] = r.w
    model.value[:] = total / total.sum()
    open_ = np.arange(trees)
    for depth in range(max_depth):
        if not len(open_):
            break
        draw = np.random.default_rng([seed, depth])
        features = np.argsort(draw.random((len(open_), width)), 1)[:, :drawn]
        slot_of = np.full(len(model.feature), -1, np.int32)
        slot_of[open_] = np.arange(len(open_))
        low, high = _ranges(data, model, slot_of, features)
        thresholds = low + draw.random(low.shape) * (high - low)
        thresholds = np.where(thresholds < high, thresholds, low)  # both sides have a row, but for one value alone
        open_ = _split(data, model, slot_of, open_, features, thresholds, labels, min_leaf)
    return model


def _ranges(data: DataFrame, model: ExtraTrees, slot_of: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest value of each open node's features."""
    k = features.shape[1]
    names = [f"{x}_{i}" for x in ("low", "high") for i in range(k)]

    def run(batches):
        for x, _, _, row, slot in _batches(batches, model, slot_of):
            at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            values = [x[row, features[slot, i]] for i in range(k)]
            columns = [np.minimum.reduceat(v, at) for v in values] + [np.maximum.reduceat(v, at) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(slot[at], pa.int32()), *map(pa.array, columns)], ["slot", *names])

    parts = data.mapInArrow(run, "slot int, " + ", ".join(f"{n} double" for n in names))
    t = parts.groupBy("slot").agg(*((F.min if n.startswith("low") else F.max)(n).alias(n) for n in names)).toArrow()
    out = np.zeros((2 * k, len(features)))
    out[:, t.column("slot").to_numpy()] = [t.column(n).to_numpy() for n in names]
    return out[:k].T, out[k:].T


def _split(data, model: ExtraTrees, slot_of, open_, features, thresholds, labels: int, min_leaf: int) -> np.ndarray:
    """Splits the open nodes that can be, and gives those of their children that may be split further."""
    k, counts = features.shape[1], [f"c{i}" for i in range(labels)]

    def run(batches):
        for x, label, weight, row, slot in _batches(batches, model, slot_of):
            for i in range(k):
                side = x[row, features[slot, i]] > thresholds[slot, i]
                code = (slot.astype(np.int64) * 2 + side) * labels + label[row]
                kinds, at = np.unique(code, return_inverse=True)
                w, n = np.bincount(at, weight[row]), np.bincount(at)
                group = kinds // labels
                place = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                table = np.zeros((len(place), labels))
                table[np.cumsum(np.r_[False, group[1:] != group[:-1]]), kinds % labels] = w
                columns = [group[place] // 2, np.full(len(place), i), group[place] % 2, np.add.reduceat(n, place), *table.T]
                kinds_ = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * labels]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_)], ["slot", "k", "side", "n", *counts])

    parts = data.mapInArrow(run, "slot int, k int, side int, n long, " + ", ".join(f"{c} double" for c in counts))
    sides = parts.groupBy("slot", "k", "side").agg(*(F.sum(c).alias(c) for c in ("n", *counts)))
    on = lambda s: F.max(F.when(F.col("side") == s, F.struct("n", F.array(*counts).alias("c"))))
    splits = sides.groupBy("slot", "k").agg(on(0).alias("a"), on(1).alias("b")).filter((F.col("a.n") >= min_leaf) & (F.col("b.n") >= min_leaf))
    summed = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))
    gain = lambda s: summed(F.col(f"{s}.c"), lambda x: x * x) / summed(F.col(f"{s}.c"), lambda x: x)
    first = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc(F.round("gain", 9)), "k"))
    best = splits.withColumn("gain", gain("a") + gain("b")).withColumn("rank", first).filter("rank = 1").orderBy("slot").select("slot", "k", "a", "b").collect()
    if not best:
        return np.zeros(0, np.int64)
    slots, ks = np.array([r.slot for r in best]), np.array([r.k for r in best])
    nodes, base = open_[slots], len(model.feature)
    model.feature[nodes], model.threshold[nodes] = features[slots, ks], thresholds[slots, ks]
    model.left[nodes] = base + 2 * np.arange(len(best))
    weights = np.array([s.c for r in best for s in (r.a, r.b)])
    many = np.array([s.n for r in best for s in (r.a, r.b)])
    model.value = np.concatenate([model.value, weights / weights.sum(1, keepdims=True)])
    model.feature = np.concatenate([model.feature, np.full(len(many), -1, np.int32)])
    model.threshold, model.left = np.concatenate([model.threshold, np.zeros(len(many))]), np.concatenate([model.left, np.zeros(len(many), np.int32)])
    return base + np.flatnonzero((many >= 2 * min_leaf) & (weights > 0).sum(1).__gt__(1))
