"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. In how many toxic and other training texts each hashed n-gram occurs is counted on Spark; the
   counts fill two vectors of 2**BITS numbers, whatever the corpus.
2. The log-count ratio r of a bucket is the log of its share in toxic texts by that in others, each
   smoothed. The FEATURES buckets that tell the classes apart best (by log-likelihood ratio) stay.
3. A logistic regression is fitted on presence times r, and scores every whole text in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelworks.llm.names import unused
from panelworks.llm.textgrams import groups, hashed
from panelworks.session import checkpoint

SIZES = (3, 4, 5)
BITS = 18
FEATURES = 2048
#: At most so many labelled rows of each class are learned from, chosen by a hash of their id.
TRAIN_ROWS = 20_000
#: The sample is counted in so many partitions, so partial counts have a bound as well.
FIT_PARTITIONS = 12
#: Added to the count of each n-gram; log-count ratios of rare n-grams come out small.
SMOOTH = 1.0
REGULARISATION = 1e-4
#: Toxic rows weigh so much more than others, as a missed one costs more.
TOXIC_WEIGHT = 4.0


@dataclass
class Model:
    """score = sigmoid(bias + sum of the weights of the distinct buckets that a text has)."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for first, part in groups(texts):
            for owner, bucket in _features(part, self.weights != 0):
                np.add.at(total, owner + first, self.weights[bucket])
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _features(texts: list[str], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, bucket) pairs of wanted buckets."""
    found = []
    for owner, bucket in hashed(texts, SIZES, BITS):
        keep = wanted[bucket]
        found.append(owner[keep].astype(np.int64) << BITS | bucket[keep])
    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    yield both >> BITS, both & ((1 << BITS) - 1)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, bucket, n): in how many texts of the partition a bucket occurs."""
    counts, everything = np.zeros((2, 1 << BITS), np.int64), np.ones(1 << BITS, bool)
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), np.int64)
        for first, part in groups(batch.column(0).to_pylist()):
            for owner, bucket in _features(part, everything):
                for label in (0, 1):
                    counts[label] += np.bincount(bucket[labels[owner + first] == label], minlength=1 << BITS)
    for label in (0, 1):
        seen = np.flatnonzero(counts[label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(seen), label, np.int32)), pa.array(seen), pa.array(counts[label][seen])],
            names=["label", "bucket", "n"],
        )


def _log_likelihood(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Dunning's statistic of presence by class."""
    def term(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    p = (k1 + k0) / (n1 + n0)
    return 2 * (term(k1, n1, k1 / n1) + term(k0, n0, k0 / n0) - term(k1, n1, p) - term(k0, n0, p))


def fit(sample: DataFrame, n1: int, n0: int) -> Model:
    """``sample`` has text and label (0 or 1); ``n1`` and ``n0`` rows have these labels in all.

    With one class only, or none, the model scores every text alike: the smoothed share of label 1.
    """
    prior = math.log((n1 + 1) / (n0 + 1))
    rows = checkpoint(sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")))
    rows = rows.coalesce(FIT_PARTITIONS)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    m1, m0 = sizes.get(1, 0), sizes.get(0, 0)
    if not m1 or not m0:
        return Model(np.zeros(1 << BITS), prior)
    counted = (
        rows.mapInArrow(_occurrences, "label int, bucket long, n long").groupBy("bucket").agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("other"),
        )
    ).toPandas()  # one row for each bucket at most
    bucket, k1, k0 = (counted[c].to_numpy() for c in ("bucket", "toxic", "other"))
    ratio = np.log((k1 + SMOOTH) / (m1 + 2 * SMOOTH)) - np.log((k0 + SMOOTH) / (m0 + 2 * SMOOTH))
    best = np.argsort(-_log_likelihood(k1, k0, m1, m0), kind="stable")[:FEATURES]
    r = np.zeros(1 << BITS)
    r[bucket[best]] = ratio[best]
    place = np.full(1 << BITS, -1, np.int64)
    place[bucket[best]] = np.arange(len(best))

    by = ratio[best]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Presence times ratio as sparse vectors, in the storage form of Spark ML's vector type."""
        for batch in batches:
            at, labels = [], np.array(batch.column(1).to_pylist(), np.float64)
            for _, part in groups(batch.column(0).to_pylist()):
                owner, b = next(_features(part, r != 0))
                at += [np.sort(place[own]) for own in np.split(b, np.searchsorted(owner, np.arange(1, len(part))))]
            n = len(at)
            fields = [
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(best), np.int32)),
                pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([by[x] for x in at], pa.list_(pa.float64())),
            ]
            vector = pa.StructArray.from_arrays(fields, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([vector, pa.array(labels), pa.array(np.where(labels == 1, TOXIC_WEIGHT, 1.0))], names=["features", "label", "weight"])

    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("weight", DoubleType())])
    sparse = rows.select("text", "label").mapInArrow(vectors, schema)
    fitted = LogisticRegression(regParam=REGULARISATION, maxIter=60, standardization=False, weightCol="weight").fit(checkpoint(sparse))
    weights = np.zeros(1 << BITS)
    weights[bucket[best]] = np.asarray(fitted.coefficients) * ratio[best]
    # Sampling the classes by different shares moves the odds; the bias moves them back.
    bias = float(fitted.intercept) + prior - math.log((m1 + 1) / (m0 + 1))
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` (with text; other columns stay) with a score in [0, 1]. Null texts score as empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = held.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``train_rows`` documents of each label, none of them in the held-out fifth.

    Which ones is decided on the labels alone, by a hash of the id; as their number is bounded they
    are broadcast, and no text is shuffled. Repeated labels of a document count once, as toxic if any is.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first = lambda label: marks.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(train_rows)
    chosen = checkpoint(first(1).unionByName(first(0)))
    return fit(docs.join(F.broadcast(chosen), "doc_id").select("text", "label"), sizes.get(1, 0), sizes.get(0, 0))


def is_held_out():
    """crc32 of the id's decimal text modulo 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Labels of held-out documents are never looked at, and only texts are scored. Nulls and empty
    texts get the score of an empty text, repeated rows equal scores, an empty table no rows.
    """
    model = learn(docs.select("doc_id", "text"), labels)
    scored = score(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; rows and columns else stay."""
    (name,) = unused(docs, "score")
    return score(docs, learn(docs.select("doc_id", "text"), labels), name).where(F.col(name) < 0.5).drop(name)
