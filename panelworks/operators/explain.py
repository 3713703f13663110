"""Attributions of boosted trees: what each feature adds to a row's margin."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.schema import FEATURE_LABELS


def _leaves(node, path: tuple, whole: float) -> list[tuple[float, tuple]]:
    """(value, path) of each leaf; a path has (feature, threshold or categories, goes left, share of the rows)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return [(float(node.prediction()), path)]
    split, out = node.split(), []
    rule = float(split.threshold()) if split.getClass().getSimpleName() == "ContinuousSplit" else tuple(float(c) for c in split.leftCategories())
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        n = float(child.impurityStats().count())
        out += _leaves(child, (*path, (int(split.featureIndex()), rule, left, n / whole)), n)
    return out


def tree_paths(model: PipelineModel) -> tuple[list[list[tuple[float, tuple]]], list[float]]:
    """The leaves of each tree of the pipeline's boosted model, and the trees' weights. Trees are small and few."""
    gbt = model.stages[-1]
    trees = [gbt._java_obj.trees()[i] for i in range(gbt.getNumTrees)] if hasattr(gbt._java_obj.trees(), "__getitem__") else list(gbt._java_obj.trees())
    return [_leaves(t.rootNode(), (), float(t.rootNode().impurityStats().count())) for t in trees], [float(w) for w in gbt.treeWeights]


def attributions(x: np.ndarray, trees: list, weights: list[float]) -> tuple[np.ndarray, float]:
    """(values, base): path-dependent Shapley values of the weighted sum of trees for every row of ``x``.

    Of a leaf, only the features on its path share its value. A feature that is known keeps the row (or not), one
    that is unknown keeps the share of training rows that went the leaf's way. Each feature's part is the mean gain
    over all orders in which the path's features become known.
    """
    values, base = np.zeros(x.shape), 0.0
    for leaves, weight in zip(trees, weights):
        for value, path in leaves:
            known: dict[int, np.ndarray] = {}
            share: dict[int, float] = {}
            for feature, rule, left, part in path:
                goes = x[:, feature] <= rule if isinstance(rule, float) else np.isin(x[:, feature], rule)
                known[feature] = known.get(feature, True) & (goes if left else ~goes)
                share[feature] = share.get(feature, 1.0) * part
            features, k = list(known), len(known)
            base += weight * value * math.prod(share.values())
            for f in features:
                others = [g for g in features if g != f]
                gain = np.zeros(len(x))
                for size in range(k):
                    order = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                    for subset in itertools.combinations(others, size):
                        both = np.full(len(x), order)
                        for g in others:
                            both = both * (known[g] if g in subset else share[g])
                        gain += both
                values[:, f] += weight * value * gain * (known[f].astype(float) - share[f])
    return values, base


def _word(source: str) -> str:
    """The reader's word for a column, by which equal parts are ordered."""
    return FEATURE_LABELS.get(source, source.replace("_", " "))


def feature_sources(model: PipelineModel) -> list[str]:
    """The source column of each place of the feature vector."""
    return [source for _, source in model.stages[0].places()]


def tree_shap(model: PipelineModel, df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """(row_id, source, value, base): each source column's part of a row's margin; parts and base add up to the margin.

    With ``top``, only so many of a row's largest parts leave its task; of equal ones, the first by the reader's word.
    """
    trees, weights = tree_paths(model)
    sources = feature_sources(model)
    held = df.sparkSession.sparkContext.broadcast((trees, weights, sources))
    names = sorted(set(sources))
    words = [_word(c) for c in names]
    place = np.argsort(np.array(sorted(range(len(names)), key=words.__getitem__)))
    kept = len(names) if top is None else min(top, len(names))

    def run(batches):
        trees, weights, sources = held.value
        at = [names.index(s) for s in sources]
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(sources))
            values, base = attributions(x, trees, weights)
            summed = np.zeros((len(x), len(names)))
            np.add.at(summed, (slice(None), at), values)
            chosen = np.broadcast_to(np.arange(len(names)), summed.shape)
            if kept < len(names):
                chosen = np.lexsort((np.broadcast_to(place, summed.shape), -np.abs(summed)), axis=-1)[:, :kept]
            ids, said = np.repeat(batch.column(0).to_numpy(), kept), pa.array(names, pa.string()).take(pa.array(chosen.ravel()))
            summed = np.take_along_axis(summed, chosen, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), said, pa.array(summed.ravel()), pa.array(np.full(summed.size, base))], names=["row_id", "source", "value", "base"])

    rows = model.transform(df).select(F.col("row_id").cast("long").alias("row_id"), vector_to_array("features").alias("x"))
    return rows.mapInArrow(run, "row_id long, source string, value double, base double")


def linear_shap(model: PipelineModel, df: DataFrame, background: DataFrame, top: int | None = None) -> DataFrame:
    """(row_id, source, value, base): each source column's part of a row's log-odds under a fitted logistic regression.

    A place of the encoded vector adds its coefficient times its distance from the background's mean, and the places of a
    column are added up. base is the log-odds at the means; parts and base add up to the row's log-odds. ``top`` as in
    :func:`tree_shap`.
    """
    encode, fitted, sources = model.stages[0], model.stages[-1], feature_sources(model)
    coefs = [float(c) for c in fitted.coefficients]
    x = vector_to_array("features")
    means = encode.transform(background).select(x.alias("x")).agg(*[F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(len(coefs))]).first()
    means = [float(m or 0.0) for m in means]
    base = float(fitted.intercept) + float(np.dot(coefs, means))
    parts = F.zip_with(F.zip_with(x, F.array(*map(F.lit, means)), lambda v, m: v - m), F.array(*map(F.lit, coefs)), lambda d, c: d * c)
    cells, at = [], 0
    for source, run in itertools.groupby(sources):  # the places of a column lie side by side
        n = len(list(run))
        cells.append(F.struct(F.lit(source).alias("source"), F.aggregate(F.slice("_parts", at + 1, n), F.lit(0.0), lambda a, v: a + v).alias("value")))
        at += n
    rows = encode.transform(df).select("row_id", parts.alias("_parts")).select("row_id", F.array(*cells).alias("_cells"))
    if top is not None and top < len(cells):
        # Sorted as structs: the largest first, of equal ones the first by the reader's word.
        words = F.array(*[F.lit(_word(source)) for source, _ in itertools.groupby(sources)])
        ranked = F.sort_array(F.zip_with("_cells", words, lambda c, w: F.struct((-F.abs(c["value"])).alias("largest"), w.alias("word"), c.alias("cell"))))
        rows = rows.select("row_id", F.transform(F.slice(ranked, 1, top), lambda r: r["cell"]).alias("_cells"))
    return rows.select("row_id", F.explode("_cells").alias("c")).select("row_id", "c.*", F.lit(base).alias("base"))


def attributions_of(fitted, df: DataFrame, background: DataFrame, top: int | None = None) -> DataFrame:
    """Attributions of a fitted target's champion, whichever kind it is; of each row all, or the ``top`` largest."""
    return linear_shap(fitted.model, df, background, top) if fitted.champion == "baseline" else tree_shap(fitted.model, df, fitted.columns, top)
