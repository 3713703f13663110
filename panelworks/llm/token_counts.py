"""Token counts as delta-maintained rollups.

A batch of changes holds signed rows: +1 inserts a document's count, -1 takes one back, and a revised
count is both. A commit sums a batch by source, language and tokenizer version and writes those sums
as a Parquet folder of their own, ``batch=<id>``, which counts from when Spark has marked it whole
(``_SUCCESS``). A batch that is there already is left alone, so a retried or repeated commit changes
nothing. Totals are the sums over all batches: additive, in any order, without reading documents again.

``compact`` folds the batches into a base: their sums and their ids, so they still count as committed.
A fold removes what the fold before it had taken in, not what it takes in itself, so readers that began
before it find their files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.packing import token_ids

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def counted(docs: DataFrame, ranks_path: str, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens, chars) by the vocabulary at ``ranks_path``.

    ``docs`` has doc_id, text, source and lang; null and empty texts count 0 tokens and characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            tokens = np.fromiter((len(encode(t)) // 2 for t in texts), np.int64, len(texts))
            chars = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens), pa.array(chars)], names=["doc_id", "source", "lang", "tokens", "chars"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokens long, chars long")
    return done.withColumn("tokenizer", F.lit(tokenizer))


def words_counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As :func:`counted`, with runs of other than white space as tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))
    return docs.select("doc_id", "source", "lang", words.cast("long").alias("tokens"), F.length(text).cast("long").alias("chars"), F.lit(tokenizer).alias("tokenizer"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.withColumn("sign", F.lit(sign))


def inserts(counts: DataFrame) -> DataFrame:
    return signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    return signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put ``new`` counts in the place of ``old`` ones."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """The table of committed sums at ``path``. Commits of different ids may run at once, folds one at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _whole(self, kind: str) -> list[str]:
        """Names behind ``kind=`` of the folders that were written to their end, by one listing."""
        fs, at = self._fs(f"{self.path}/{kind}=*/_SUCCESS")
        return sorted(s.getPath().getParent().getName().removeprefix(f"{kind}=") for s in fs.globStatus(at) or [])

    def _base(self) -> int:
        """The number of the newest base; 0 if there is none."""
        return max(map(int, self._whole("base")), default=0)

    def _folded(self, base: int) -> DataFrame:
        """(batch) ids that a base has taken in."""
        return self.spark.read.schema("batch string").parquet(f"{self.path}/ids={base}") if base else self.spark.createDataFrame([], "batch string")

    def committed(self, batch_id: str) -> bool:
        fs, at = self._fs(f"{self.path}/batch={batch_id}/_SUCCESS")
        return fs.exists(at) or self._folded(self._base()).where(F.col("batch") == batch_id).limit(1).count() > 0

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already. A half-written folder is overwritten.

        ``changes`` has KEYS, tokens, chars and sign; null keys are keys of their own, and null counts
        count 0; no changes are a batch too. Sums are combined in each task before the shuffle, so a hot
        source is no hot task. An id is letters, digits, dots, dashes and underscores.
        """
        if not re.fullmatch(r"[\w.-]+", batch_id, re.A):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("docs"),
            F.coalesce(F.sum(F.col("sign") * F.col("tokens")), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.sum(F.col("sign") * F.col("chars")), F.lit(0)).cast("long").alias("chars"),
        )
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def _open(self, base: int) -> list[str]:
        """Batches that the base has not taken in: those of the fold before it are still there, so they are told by their ids."""
        batches = self._whole("batch")
        if not base or not batches:
            return batches
        here = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        return sorted(r["batch"] for r in here.join(self._folded(base), "batch", "left_anti").collect())

    def _rows(self, base: int, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batch={b}" for b in batches] + ([f"{self.path}/base={base}"] if base else [])
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")])

    def totals(self) -> DataFrame:
        """Sums by KEYS over all batches; keys whose documents were all taken back are left out."""
        base = self._base()
        return self._rows(base, self._open(base)).where("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def compact(self) -> int:
        """Folds the open batches into a new base; returns its number (the old one if there is nothing to fold)."""
        base = self._base()
        batches = self._open(base)
        if not batches:
            return base
        old = [b for b in self._whole("batch") if b not in set(batches)]
        ids = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        # The base counts from its own mark on, so the ids are written first.
        self._folded(base).unionByName(ids).write.mode("overwrite").parquet(f"{self.path}/ids={base + 1}")
        self._rows(base, batches).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base={base + 1}")
        for name in [f"batch={b}" for b in old] + [f"{kind}={base - 1}" for kind in ("base", "ids") if base > 1]:
            fs, at = self._fs(f"{self.path}/{name}")
            fs.delete(at, True)
        return base + 1
