"""The corpus pipeline: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Between stages the rows are written as Parquet to the shared folder and read again, so
a stage that passes over its input more than once does not run the stages before it again, and a lost
executor costs no more than its own tasks. A stage's folder is deleted once the next stage is written; the
last one stays, as the result reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.decontaminate import drop_contaminated
from panelworks.llm.packing import pack
from panelworks.llm.pii import replace_pii
from panelworks.llm.queries import PII_KEY, tokenizer_path
from panelworks.llm.simhash import keep_one
from panelworks.llm.toxicity import drop_toxic
from panelworks.session import prepare, remove, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic; it learns from this input's labels."""
    return drop_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    prepare(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, their lengths brought up to date."""
    prepare(spark)
    done = replace_pii(docs, PII_KEY).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    prepare(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Learned scores, fingerprints and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(prepare(spark), sf_dir, "documents")
    path, done = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if done:
            remove(spark, f"{path}/{done}")
        done = name
    return STAGES[-1][1](spark, docs, sf_dir)
