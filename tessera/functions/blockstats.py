"""Statistics and features of blocks, computed in one Arrow pass over whole batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labels import BUCKET_SHARE, MAGIC, MAGIC_FEATURE, PRINTABLE_RUN

STATS = (
    "n long, entropy double, uniformity double, zero_ratio double, ff_ratio double, dominant_byte int,"
    " dominant_pct double, entropy_nonzero double, entropy_nonff double, magic boolean, max_bucket double,"
    " printable_run int, legit boolean"
)
FEATURES = 30


def _counts(x: np.ndarray) -> np.ndarray:
    """Byte counts of each row of a matrix of bytes."""
    m = len(x)
    return np.bincount((x.astype(np.int64) + 256 * np.arange(m)[:, None]).ravel(), minlength=256 * m).reshape(m, 256)


def _entropy(c: np.ndarray) -> np.ndarray:
    """Shannon entropy of each row of counts, with 0 for no bytes and never -0."""
    n = c.sum(1)
    k = np.arange(1, (int(n.max()) if len(n) else 0) + 1)
    parts = np.r_[0.0, k * np.log2(k)]  # of each count; counts are at most a block's bytes
    some = np.maximum(n, 1)
    return np.maximum(np.log2(some) - parts[c].sum(1) / some, 0.0) + 0.0


def _longest(on: np.ndarray) -> np.ndarray:
    """Longest run of true of each row, from the places where a run begins and ends."""
    m, k = on.shape
    edge = np.zeros((m, k + 2), np.int8)
    edge[:, 1:-1] = on
    step = np.diff(edge.ravel())
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    best = np.zeros(m, np.int64)
    np.maximum.at(best, begin // (k + 2), end - begin)
    return best


def statistics(x: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of STATS for blocks of one length, a row of bytes each."""
    m, n = x.shape
    if not n:
        zero = np.zeros(m)
        return {
            "n": np.zeros(m, np.int64), "entropy": zero, "uniformity": zero, "zero_ratio": zero, "ff_ratio": zero, "dominant_byte": np.zeros(m, np.int32),
            "dominant_pct": zero + 1, "entropy_nonzero": zero, "entropy_nonff": zero, "magic": zero > 0, "max_bucket": zero, "printable_run": np.zeros(m, np.int32), "legit": zero > 0,
        }
    c = _counts(x)
    f = c / n
    rest = []
    for b in (0, 255):
        own = c.copy()
        own[:, b] = 0
        rest.append(np.round(_entropy(own), 6))
    head = x[:, :16]
    printable = (x >= 0x20) & (x <= 0x7E)
    magic, bucket, run = np.isin(head, MAGIC).any(1), f.reshape(m, 8, 32).sum(2).max(1), _longest(printable)
    return {
        "n": np.full(m, n, np.int64),
        "entropy": _entropy(c),
        "uniformity": np.sqrt(((f - 1 / 256) ** 2).mean(1)),
        "zero_ratio": f[:, 0],
        "ff_ratio": f[:, 255],
        "dominant_byte": c.argmax(1).astype(np.int32),
        "dominant_pct": f.max(1),
        "entropy_nonzero": rest[0],
        "entropy_nonff": rest[1],
        "magic": magic,
        "max_bucket": bucket,
        "printable_run": run.astype(np.int32),
        "legit": magic | (bucket > BUCKET_SHARE) | (run >= PRINTABLE_RUN),
    }


def _correlation(x: np.ndarray, lag: int) -> np.ndarray:
    a, b = x[:, :-lag].astype(float), x[:, lag:].astype(float)
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    over, under = (a * b).sum(1), np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(under > 0, np.abs(over / np.where(under > 0, under, 1)), 0.0)


def features(x: np.ndarray, only: Sequence[int] = range(FEATURES)) -> np.ndarray:
    """The 30 features of blocks of one length, a row of bytes each; of those in only, the others are 0.

    only: numbers from 0. What no wanted feature needs isn't computed.
    """
    m, n = x.shape
    out = np.zeros((m, FEATURES))
    if not n:
        return out
    want, one = set(only), np.minimum
    c = _counts(x) if want & {0, 1, 2, 3, 4, 5, 6, 7, 21, 22, 23, 24} else None
    f = None if c is None else c / n
    few, long_ = x[:, :512], x[:, :1024]
    k = long_.shape[1]
    if want & {0, 3}:
        h = _entropy(c)
        out[:, 0], out[:, 3] = h / 8, one(np.abs(8 - h) / 8, 1)
    if want & {1, 2}:
        u = np.sqrt(((f - 1 / 256) ** 2).mean(1))
        out[:, 1], out[:, 2] = one(u / 0.06, 1), one(16384 * u**2, 1)
    if want & {4, 5}:
        ranked = np.partition(f, (7, 248), axis=1)
        out[:, 4], out[:, 5] = one(ranked[:, -8:].sum(1) / 0.25, 1), one(ranked[:, :8].sum(1) / 0.03, 1)
    if want & {6, 7}:
        out[:, 6], out[:, 7] = f.max(1), (c > 0).sum(1) / 256
    if 8 in want:
        out[:, 8] = (few.max(1).astype(float) - few.min(1)) / 255
    if k >= 4 and 9 in want:
        out[:, 9] = _correlation(long_, 1)
    if k >= 6 and 10 in want:
        out[:, 10] = _correlation(long_, 2)
    if want & {11, 12, 13, 14}:
        same = long_[:, 1:] == long_[:, :-1]
        if k >= 2:
            out[:, 11] = one(same.mean(1) / 0.05, 1)
        if k >= 3:
            out[:, 12] = one((same[:, 1:] & same[:, :-1]).mean(1) / 0.01, 1)
        out[:, 13] = one(k / (1 + (~same).sum(1)) / 8, 1)
        if 14 in want:
            out[:, 14] = one((_longest(same) + 1) / 50, 1)
    if want & {15, 16, 17, 18}:
        step = max(few.shape[1] // 16, 1)
        energy = np.full((m, 16), 1e-10)
        for i in range(16):
            part = few[:, i * step : (i + 1) * step] / 255.0
            energy[:, i] += (part**2).sum(1) / max(part.shape[1], 1)
        total = energy.sum(1) + 1e-10
        out[:, 15] = one(np.exp(np.log(energy).mean(1)) / energy.mean(1), 1)
        out[:, 16], out[:, 17], out[:, 18] = energy[:, :4].sum(1) / total, energy[:, 4:12].sum(1) / total, energy[:, 12:].sum(1) / total
    if 19 in want:
        out[:, 19] = one(_longest((few >= 0x20) & (few <= 0x7E)) / 128, 1)
    if 20 in want:
        out[:, 20] = np.isin(x[:, :16], MAGIC_FEATURE).any(1)
    if want & {21, 22, 23, 24}:
        out[:, 21], out[:, 22] = f[:, 0], f[:, 255]
        out[:, 23], out[:, 24] = one(f[:, :32].sum(1) / 0.375, 1), one(f[:, 128:160].sum(1) / 0.375, 1)
    if want & {25, 26, 27}:
        out[:, 25] = _entropy(_counts(x[:, :128])) / 8
        out[:, 26] = _entropy(_counts(x[:, -128:])) / 8 if n >= 128 else out[:, 25]
        out[:, 27] = np.abs(out[:, 25] - out[:, 26])
    if 28 in want:
        out[:, 28] = _entropy(_counts(x[:, ::2])) / 8
    if 29 in want:
        out[:, 29] = _entropy(_counts(x[:, 1::2])) / 8 if n > 1 else 0
    out[:, [i for i in range(FEATURES) if i not in want]] = 0
    return out


#: Blocks that are worked on together, so that their counts stay in the cache.
AT_ONCE = 512


def _by_length(column: pa.Array, compute):
    """(places, compute(matrix)) for the blocks of each length, AT_ONCE at a time, read from the column's buffer; null counts as empty."""
    column = column.cast(pa.binary())
    n = len(column)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.where(np.asarray(column.is_null()), 0, np.diff(ends)) if n else np.zeros(0, np.int64)
    for length in np.unique(size).tolist():
        all_ = np.flatnonzero(size == length)
        for i in range(0, len(all_), AT_ONCE):
            at = all_[i : i + AT_ONCE]
            first = ends[at]
            if length and (np.diff(first) == length).all():  # neighbours: a view
                yield at, compute(raw[first[0] : first[-1] + length].reshape(-1, length))
            else:
                yield at, compute(raw[first[:, None] + np.arange(length)] if length else np.zeros((len(at), 0), np.uint8))


def _stat_batches(batches):
    empty = statistics(np.zeros((0, 0), np.uint8))
    for b in batches:
        cols = {name: np.zeros(b.num_rows, v.dtype) for name, v in empty.items()}
        for at, s in _by_length(b.column("data"), statistics):
            for name, v in s.items():
                cols[name][at] = v
        kept = [i for i, name in enumerate(b.schema.names) if name != "data"]
        names = [x.split()[0] for x in STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *(pa.array(cols[c]) for c in names)], [*(b.schema.names[i] for i in kept), *names])


def _feature_batches(only: Sequence[int]):
    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, FEATURES))
            for at, v in _by_length(b.column("data"), lambda x: features(x, only)):
                out[at] = v
            kept = [i for i, name in enumerate(b.schema.names) if name != "data"]
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * FEATURES, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), lists], [*(b.schema.names[i] for i in kept), "features"])

    return run


feature_batches = _feature_batches(range(FEATURES))


def _histogram_batches(batches):
    for b in batches:
        who, byte, cnt = [], [], []
        for at, c in _by_length(b.column("data"), _counts):
            i, v = np.nonzero(c)
            who.append(at[i])
            byte.append(v)
            cnt.append(c[i, v])
        who, byte, cnt = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, byte, cnt))
        kept = [b.column(i).take(pa.array(who)) for i, name in enumerate(b.schema.names) if name != "data"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(byte.astype(np.int32)), pa.array(cnt.astype(np.int64))], [*(n for n in b.schema.names if n != "data"), "byte", "cnt"])


def histograms(blocks: DataFrame) -> DataFrame:
    """A row for each block and byte that occurs in it: the columns of blocks but data, byte, cnt."""
    return blocks.mapInArrow(_histogram_batches, _schema_with(blocks, "byte int, cnt long"))


def _schema_with(blocks: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name != "data"), extra])


def with_statistics(blocks: DataFrame) -> DataFrame:
    """blocks with the columns of STATS in place of data; a null block counts as empty."""
    return blocks.mapInArrow(_stat_batches, _schema_with(blocks, STATS))


def with_features(blocks: DataFrame, only: Sequence[int] = range(FEATURES)) -> DataFrame:
    """blocks with an array of 30 features in place of data; those that aren't in only (numbers from 0) are 0."""
    return blocks.mapInArrow(_feature_batches(list(only)), _schema_with(blocks, "features array<double>"))
