"""Language identification by nearest centroid.

A text is the L2-normalised TF-IDF vector of its hashed character n-grams. Every language has several
centroids, found by spherical k-means over a bounded sample of its texts; a text gets the language of
the centroid of the largest cosine. A text farther from it than nearly all texts that made that
centroid is rejected (column ``rejected``): it likely is in none of the learned languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelworks.llm.textgrams import groups, hashed
from panelworks.session import checkpoint

SIZES = (1, 2, 3)
BITS = 12
CENTROIDS = 4
ROUNDS = 5
#: At most about so many texts of each language are learned from, chosen by a hash of the row.
TRAIN_ROWS = 1500
#: Distinct values of lang that a model can hold.
MOST_LANGUAGES = 1000
#: A cluster with a smaller share of its language's texts is dropped: likely wrong labels.
LEAST_SHARE = 0.1
#: Cosine below this quantile of a centroid's own training texts means rejection.
REJECT_QUANTILE = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        langs, scores, far = [], np.zeros(len(texts)), []
        for first, part in groups(texts):
            cosine = vectors(part, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1) if self.languages else np.zeros(len(part), int)
            for i, (text, k) in enumerate(zip(part, best)):
                if not self.languages or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    far.append(True)
                    continue
                langs.append(self.languages[k])
                scores[first + i] = min(1.0, max(0.0, float(cosine[i, k])))
                far.append(bool(cosine[i, k] < self.least[k]))
        return langs, scores, far


def counts(texts: list[str]) -> np.ndarray:
    total = np.zeros((len(texts), 1 << BITS), np.float32)
    for owner, bucket in hashed(texts, SIZES, BITS):
        total += np.bincount(owner.astype(np.int64) << BITS | bucket, minlength=total.size).reshape(total.shape)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length; a text without n-grams is all zero."""
    v = np.log1p(counts(texts)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, part in groups(batch.column(1).to_pylist()):
            df += (counts(part) > 0).sum(axis=0)
            n += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << BITS)), pa.array(np.concatenate([[n], df]))], names=["bucket", "n"])


def _nearest(idf: np.ndarray, centroids: dict[str, np.ndarray]):
    """Rows (lang, text) -> for each language and cluster the sum of its vectors and its cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sums, cosines = {}, {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, part in groups(batch.column(1).to_pylist()):
                v = vectors(part, idf)
                for i in range(len(part)):
                    lang = langs[first + i]
                    c = centroids[lang] @ v[i]
                    k = int(c.argmax())
                    key = lang, k
                    sums[key] = sums.get(key, 0) + v[i].astype(np.float64)
                    cosines.setdefault(key, []).append(float(c[k]))
        for (lang, k), total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang], "k": pa.array([k], pa.int32()), "total": [total.tobytes()], "cosines": pa.array([cosines[lang, k]], pa.list_(pa.float64()))}
            )

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float64) for b in pdf["total"])
    return pd.DataFrame({"lang": pdf["lang"][:1], "k": pdf["k"][:1], "total": [total.tobytes()], "cosines": [np.concatenate(pdf["cosines"].tolist())]})


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """``docs`` has doc_id, text and lang; rows with a null in the last two, or without a letter, are left out.

    More than MOST_LANGUAGES distinct values of lang raise, as each is broadcast and gets centroids. The sample
    holds at most about ``train_rows`` rows of each language, whatever the input. It is chosen by
    a hash of doc_id and text, so of a text that comes often no more than its share is taken.
    """
    spark = docs.sparkSession
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    sizes = checkpoint(rows.groupBy("lang").agg(F.count("*").alias("size")))
    space = 1_000_000
    share = F.least(F.lit(1.0), F.lit(train_rows) / F.col("size")) * space
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: clean the column first")
    sample = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(space)) < share)
    parts = max(1, min(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sample = checkpoint(sample.repartition(parts, F.xxhash64("doc_id", "text")).select("lang", "text"))
    df = sample.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(df):
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.ones(1 << BITS, np.float32), np.zeros(0))
    table = np.zeros((1 << BITS) + 1)
    table[df["bucket"].to_numpy() + 1] = df["n"]
    idf = (np.log((1 + table[0]) / (1 + table[1:])) + 1).astype(np.float32)
    # Seeds are found by their hashes; only their texts, CENTROIDS of each language, come to the driver.
    ranked = sample.select("lang", "text", F.xxhash64("text", F.lit("seed")).alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    first = ranked.select("lang", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= CENTROIDS)
    texts: dict[str, list[str]] = {}
    for r in ranked.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", "r").agg(F.min("text").alias("text")).orderBy("lang", "r").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    centroids = {lang: vectors(own, idf) for lang, own in texts.items()}
    if not centroids:
        return Model([], np.zeros((0, 1 << BITS), np.float32), idf, np.zeros(0))
    for last in [False] * ROUNDS + [True]:
        moved = (
            sample.mapInArrow(_nearest(idf, centroids), "lang string, k int, total binary, cosines array<double>")
            .groupBy("lang", "k").applyInPandas(_add, "lang string, k int, total binary, cosines array<double>").collect()
        )
        if last:
            break
        for r in moved:
            total = np.frombuffer(r["total"], np.float64)
            centroids[r["lang"]][r["k"]] = total / max(np.linalg.norm(total), 1e-12)
    in_lang = {}
    for r in moved:
        in_lang[r["lang"]] = in_lang.get(r["lang"], 0) + len(r["cosines"])
    kept = sorted((r["lang"], r["k"], float(np.quantile(r["cosines"], REJECT_QUANTILE))) for r in moved if len(r["cosines"]) >= LEAST_SHARE * in_lang[r["lang"]])
    return Model([lang for lang, _, _ in kept], np.array([centroids[lang][k] for lang, k, _ in kept], np.float32), idf, np.array([q for _, _, q in kept]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text).

    score is the cosine to the nearest centroid. A text that is null or has no letter gets ``und``,
    score 0 and is rejected. Repeated rows stay; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores, far = held.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(far, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), learned from the three quarters not held out."""
    model = fit(docs.where(remainder() != 2).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
