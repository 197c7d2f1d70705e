"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training reads the statistics of at most ``max_rows`` labelled rows (the documented bound; rows are taken by the hash of their id, so reruns agree),
bins every statistic at its quantiles and grows trees level by level from histograms of gradients and curvatures.  The trees are flattened into
arrays, feature, bin, left child and value, and a batch of documents walks all of them at once in numpy.

Edge cases: null and empty texts have the statistics 0 and get the score that the trees give there; labels that are null or of documents that are
missing are left out; of several labels for one id each counts; without labels, or with labels of one class, every score is that class's smoothed
share (0.5 without labels); ids need not be unique; extra columns pass through, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches
from .features import NAMES, statistics


@dataclass(frozen=True)
class Trees:
    """cuts: a row of ascending bin limits for each feature; the others: a row for each tree, children of node i at left and left + 1."""

    cuts: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.base)
        if len(x) and self.feature.size:
            binned = bins(x, self.cuts)
            rows = np.arange(len(x))
            for feature, limit, left, value in zip(self.feature, self.limit, self.left, self.value, strict=True):
                node = np.zeros(len(x), np.int32)
                while (inner := left[node] > 0).any():
                    node = np.where(inner, left[node] + (binned[rows, feature[node]] > limit[node]), node)
                total += value[node]
        return 1 / (1 + np.exp(-total))


def bins(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, n_bins: int = 64, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosting with the logistic loss; a split needs ``least`` rows on either side."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    none = np.zeros((0, 1))
    if len(y) == 0 or y.min() == y.max():
        return Trees(none, none.astype(np.int32), none, none.astype(np.int32), none, base)
    cuts = np.quantile(x, np.arange(1, n_bins) / n_bins, axis=0).T.astype(x.dtype)
    b = bins(x, cuts)
    d, nodes = x.shape[1], 2 ** (depth + 1) - 1
    made = [np.zeros((trees, nodes), k) for k in (np.int32, np.int32, np.int32, np.float64)]
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node, used = np.zeros(len(y), np.int32), 1
        level = [0]
        for step in range(depth + 1):
            following: list[int] = []
            place = np.full(nodes, -1)
            place[level] = np.arange(len(level))
            slot = place[node]
            inside = slot >= 0
            sums = [np.bincount(slot[inside], w[inside], len(level)) for w in (g, h)]
            for i, at in enumerate(level):
                made[3][t, at] = -rate * sums[0][i] / (sums[1][i] + ridge)
            if step == depth:
                break
            best = np.full(len(level), 1e-6)
            chosen = [None] * len(level)
            for j in range(d):
                key = slot[inside] * n_bins + b[inside, j]
                gs, hs, ns = (np.bincount(key, w, len(level) * n_bins).reshape(len(level), n_bins).cumsum(1) for w in (g[inside], h[inside], np.ones(inside.sum())))
                total_g, total_h, total_n = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain[(ns < least) | (total_n - ns < least)] = 0
                top = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(len(level)), top] > best):
                    best[i], chosen[i] = gain[i, top[i]], (j, top[i])
            for at, c in zip(level, chosen, strict=True):
                if c is not None:
                    made[0][t, at], made[1][t, at], made[2][t, at] = c[0], c[1], used
                    here = node == at
                    node[here] = used + (b[here, c[0]] > c[1])
                    following += [used, used + 1]
                    used += 2
            level = following
            if not level:
                break
        raw += made[3][t][node]
    return Trees(cuts, made[0], made[1].astype(np.float64), made[2], made[3], base)


def labelled(docs: DataFrame, labels: DataFrame, label: str, train, max_rows: int) -> DataFrame:
    """(y, text) of at most ``max_rows`` labelled training rows, the same ones in every run."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


def train(docs: DataFrame, labels: DataFrame, train_rows, label: str = "quality", max_rows: int = 12_000, **options) -> Trees:
    """Fit on the driver; what reaches it is ``max_rows`` rows of statistics."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            x = statistics(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    rows = labelled(docs, labels, label, train_rows, max_rows).mapInArrow(run, "doc_id long, y int, x array<float>").toArrow()
    x = np.asarray(rows["x"].combine_chunks().flatten(), np.float32).reshape(-1, len(NAMES)) if len(rows) else np.zeros((0, len(NAMES)), np.float32)
    y = np.asarray(rows["y"], np.float64)
    order = np.lexsort((y, np.asarray(rows["doc_id"])))
    return fit(x[order], y[order], **options)


def score(docs: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """docs without their text, with score and predicted."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "score", "predicted")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # some hundred kB, by the parameters of fit

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            p = shared.value.scores(statistics(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.select(*names, "text").mapInArrow(run, schema)
