"""Gradient boosting for several classes, by histograms that Spark sums.

A round grows one tree for each class, and all of them a level at a time: every partition counts the
gradients of its rows by (class, node, feature, bin), Spark adds the counts up, and the driver cuts each
node at its best gain. What travels depends on classes, nodes, features and bins only, never on rows.
Gradients are whole numbers, so sums and trees do not depend on how rows are dealt. Margins are written
to the shared folder every few rounds, and in between worked out from the trees since.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks.session import checkpoint

#: Gradients are kept in this fraction of one.
_UNIT = 1 << 24
_WRITE_EVERY = 5


@dataclass
class Trees:
    """The trees of one round, one for each class; node n has the children 2n + 1 and 2n + 2."""

    feature: np.ndarray  # (classes, nodes), -1 at a leaf
    cut: np.ndarray  # rows go left if the feature is at most this
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes) node of each row of feature values."""
        at = np.zeros((len(x), len(self.feature)), np.int64)
        klass = np.arange(len(self.feature))
        for _ in range(int(np.log2(self.feature.shape[1] + 1))):
            feature = self.feature[klass, at]
            right = x[np.arange(len(x))[:, None], np.maximum(feature, 0)] > self.cut[klass, at]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.feature)), self.leaves(x)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class BoostedClasses(Estimator):
    """Softmax boosting on a feature vector; labels are 0 to classes - 1 as doubles.

    Rounds stop early if no node of any class can be cut with a gain. A table of one class is fitted by its prior.
    """

    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol="label", featuresCol="features", rounds=20, depth=3, rate=0.1, ridge=1.0, bins=32, least_weight=1e-3):
        super().__init__()
        self._set(labelCol=labelCol, featuresCol=featuresCol)
        self.rounds, self.depth, self.rate, self.ridge, self.bins, self.least_weight = rounds, depth, rate, ridge, bins, least_weight

    def _fit(self, df: DataFrame) -> BoostedModel:
        rows = df.select(F.col(self.getOrDefault("labelCol")).cast("int").alias("y"), vector_to_array(self.getOrDefault("featuresCol")).alias("x")).where("y IS NOT NULL")
        counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one for each class
        if not counts:
            raise ValueError("no labelled rows")
        classes = max(counts) + 1
        prior = np.array([counts.get(k, 0) for k in range(classes)], float)
        prior = np.log(np.maximum(prior, 1e-3) / prior.sum())
        width = rows.select(F.size("x")).first()[0]
        edges = self._edges(rows, width)
        binned = rows.mapInArrow(_bin(edges), "y int, bins binary, margin binary")
        rounds: list[Trees] = []
        held, since = checkpoint(binned), 0
        for _ in range(self.rounds):
            trees = self._round(held, rounds[since:], prior, classes, width, edges)
            if trees is None:
                break
            rounds.append(trees)
            if len(rounds) - since == _WRITE_EVERY:
                held, since = checkpoint(held.mapInArrow(_advance(rounds[since:], classes, width), "y int, bins binary, margin binary")), len(rounds)
        return BoostedModel(prior, [_in_values(t, edges) for t in rounds], self.getOrDefault("featuresCol"))

    def _edges(self, rows: DataFrame, width: int) -> np.ndarray:
        """(features, bins - 1) upper ends of the bins, by a quantile sketch; constant features have none that cuts."""
        shares = [i / self.bins for i in range(1, self.bins)]
        found = rows.agg(*[F.percentile_approx(F.col("x")[j], shares, 1000).alias(f"q{j}") for j in range(width)]).first() if width else []
        return np.array([q if q is not None else [0.0] * len(shares) for q in found]).reshape(width, len(shares))

    def _round(self, rows: DataFrame, since: list[Trees], prior: np.ndarray, classes: int, width: int, edges: np.ndarray) -> Trees | None:
        size = 2 ** (self.depth + 1) - 1
        trees = Trees(np.full((classes, size), -1), np.zeros((classes, size)), np.zeros((classes, size)))
        grown = False
        for level in range(self.depth):
            first, nodes = 2**level - 1, 2**level
            live = [(k, n) for k in range(classes) for n in range(nodes) if level == 0 or trees.feature[k, (first + n - 1) // 2] >= 0]
            if not live:
                break
            counted = rows.mapInArrow(_count(since, trees, prior, level, classes, width, self.bins), "slot long, g long, h long")
            hist = np.zeros((classes * nodes * width * self.bins, 2))
            for slot, g, h in counted.groupBy("slot").agg(F.sum("g"), F.sum("h")).collect():  # classes x nodes x features x bins at most
                hist[slot] = g, h
            hist = hist.reshape(classes, nodes, width, self.bins, 2) / _UNIT
            for k, n in live:
                g, h = hist[k, n, 0].sum(axis=0)
                if level == 0:
                    trees.value[k, 0] = self._value(g, h)
                left = hist[k, n].cumsum(axis=1)[:, :-1]
                right = np.array([g, h]) - left
                gain = left[..., 0] ** 2 / (left[..., 1] + self.ridge) + right[..., 0] ** 2 / (right[..., 1] + self.ridge) - g * g / (h + self.ridge)
                gain = np.where((left[..., 1] >= self.least_weight) & (right[..., 1] >= self.least_weight), gain, 0.0)
                best = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[best] > 1e-9:
                    trees.feature[k, first + n], trees.cut[k, first + n] = best
                    child = 2 * (first + n) + 1
                    trees.value[k, child], trees.value[k, child + 1] = self._value(*left[best]), self._value(*right[best])
                    grown = True
        return trees if grown else None

    def _value(self, g: float, h: float) -> float:
        return -self.rate * g / (h + self.ridge)


def _in_values(trees: Trees, edges: np.ndarray) -> Trees:
    """Cuts as feature values instead of bins."""
    cut = np.where(trees.feature >= 0, edges[np.maximum(trees.feature, 0), trees.cut.astype(int)], 0.0)
    return Trees(trees.feature, cut, trees.value)


def _bin(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            bins = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8) if len(edges) else np.empty((len(x), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([b""] * len(x), pa.binary())], names=["y", "bins", "margin"])

    return run


def _held(batch: pa.RecordBatch, classes: int, width: int, since: list[Trees]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, bins and margins (less the prior) of a batch."""
    y = batch.column(0).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(y), width)
    margin = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64)
    margin = margin.reshape(len(y), classes).copy() if len(margin) else np.zeros((len(y), classes))
    for trees in since:
        margin += trees.margins(bins)
    return y, bins, margin


def _together(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``least`` rows, so that numpy works on more rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _advance(since: list[Trees], classes: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, margin = _held(batch, classes, width, since)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tobytes() for m in margin], pa.binary())], names=["y", "bins", "margin"])

    return run


def _count(since: list[Trees], trees: Trees, prior: np.ndarray, level: int, classes: int, width: int, n_bins: int):
    """Sums of gradients and curvatures by (class, node of the level, feature, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nodes = 2**level - 1, 2**level
        total = np.zeros((2, classes * nodes * width * n_bins))
        for batch in _together(batches):
            y, bins, margin = _held(batch, classes, width, since)
            p = softmax(margin + prior)
            at = trees.leaves(bins) - first  # rows that stopped above are below zero
            places = np.arange(width) * n_bins + bins  # of a node's features and bins
            for k in range(classes):
                (in_level,) = np.nonzero(at[:, k] >= 0)
                g = np.rint((p[in_level, k] - (y[in_level] == k)) * _UNIT)
                h = np.rint(p[in_level, k] * (1 - p[in_level, k]) * _UNIT)
                slot = (places[in_level] + (at[in_level, k] * (width * n_bins))[:, None]).ravel()
                lo, size = k * nodes * width * n_bins, nodes * width * n_bins
                total[0, lo : lo + size] += np.bincount(slot, np.repeat(g, width), size)
                total[1, lo : lo + size] += np.bincount(slot, np.repeat(h, width), size)
        (some,) = np.nonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some].astype(np.int64)) for t in total)], names=["slot", "g", "h"])

    return run


class BoostedModel(Model):
    """Adds ``probability``, a vector with a place for each class."""

    def __init__(self, prior: np.ndarray, rounds: list[Trees], features: str):
        super().__init__()
        self.prior, self.rounds, self.features = prior, rounds, features

    @property
    def numClasses(self) -> int:
        return len(self.prior)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.prior + sum((t.margins(x) for t in self.rounds), np.zeros((len(x), len(self.prior)))))

    def _transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.probabilities(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        return df.withColumn("probability", array_to_vector(scored(vector_to_array(self.features))))
