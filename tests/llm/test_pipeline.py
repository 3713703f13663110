"""The pipeline against decisions worked out by hand on a small corpus."""

import numpy as np
import pytest

import corpus_pipeline
from panelworks.llm import pii
from panelworks.llm.packing import token_ids
from panelworks.llm.queries import PII_KEY, tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def said(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + WORDS[j] for i, j in zip(r.integers(0, len(WORDS), n), r.integers(0, len(WORDS), n)))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts, toxic = {}, {}
    for i in range(200):
        toxic[i] = int(i % 5 == 1)
        texts[i] = said(100 + i, 40) + (" you worthless idiot and moron" if toxic[i] else "")
    item = said(9000, 45)
    texts |= {300: texts[0], 301: said(9001, 30) + " " + item, 302: "write to ann.1@mail.example.org " + said(9002, 1500), 303: None, 304: "", 305: said(9003, 20)}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = {i for i in texts if not toxic.get(i)} - {300, 301, 304}
    return path, texts, kept


def test_run(spark, corpus):
    path, texts, kept = corpus
    encode = token_ids(tokenizer_path())
    want = {}
    for i in kept:
        new, _ = pii.rewrite(texts[i], PII_KEY, lambda kind, value: None)
        want[i] = len(encode(new or "")) // 2 + 1
    pieces = corpus_pipeline.run(spark, path).collect()
    got, size = {}, {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
        size[p["doc_id"]] = p["doc_tokens"]
    assert got == want == size


def test_stages_keep_columns_and_take_other_ones(spark, corpus):
    path, texts, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    extra = docs.selectExpr("*", "1 AS score", "'x' AS pii", "2 AS fingerprint").where("doc_id < 20")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("doc_id < 20"), path).columns == docs.columns
        assert set(docs.columns) <= set(stage(spark, extra, path).columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
