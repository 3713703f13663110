"""Registered queries of the llm operators: thin calls over whole tables, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm.chat import conversation_digests, format_turns, text_part
from panelworks.llm.decontaminate import contaminated
from panelworks.llm.pii import replace_pii
from panelworks.llm.simhash import simhash_groups
from panelworks.llm.langid import language
from panelworks.llm.hard_negatives import hard_negatives
from panelworks.llm.licenses import scan_licenses
from panelworks.llm.linededup import drop_repeated_lines
from panelworks.llm.media import media_columns
from panelworks.llm.packing import pack
from panelworks.llm.quantize import vector_codes
from panelworks.llm.token_counts import Rollup, counted, deletes, inserts, revisions, words_counted
from panelworks.llm.toxicity import toxicity
from panelworks.session import checkpoint, prepare, shared_dir, table

TOKENIZER = "byte_bpe_50k.tiktoken"
#: For the registered queries; a real run reads its key from where secrets are kept.
PII_KEY = b"registered queries"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return simhash_groups(docs)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "item_id", "round(similarity, 6) AS similarity", "window_start")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = turns.unionByName(probe).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    return conversation_digests(format_turns(turns))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, PII_KEY).select("doc_id", "text", F.size("pii").alias("n_replaced"), F.array_join(F.transform("pii", lambda p: p["kind"]), ",").alias("kinds"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document in the order of its text, and how many sentences they took."""
    found = scan_licenses(table(prepare(spark), sf_dir, "documents"))
    return found.select(
        "doc_id", F.array_join(F.transform("hits", lambda h: h["license"]), ",").alias("licenses"),
        F.aggregate("hits", F.lit(0), lambda n, h: n + F.size(h["sentences"])).cast("long").alias("n_matched"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five commits: words of all documents, those of one source taken back, words revised
    to vocabulary tokens where the language is not null, and two commits again that change nothing."""
    docs = table(prepare(spark), sf_dir, "documents")
    words = words_counted(docs, "words-1")
    tokens = checkpoint(counted(docs, tokenizer_path(), "byte_bpe_50k-1"))
    rollup = Rollup(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    revised = F.col("lang").eqNullSafe("en") & ~F.col("source").eqNullSafe("src1")  # never null, so batches 3 and 4 cover all rows
    batches = [
        ("1", inserts(words)),
        ("2", deletes(words.where("source = 'src1'"))),
        ("3", revisions(words.where(revised), tokens.where(revised))),
        ("4", inserts(tokens.where(~revised))),
    ]
    for name, changes in [*batches, batches[1], batches[3]]:
        rollup.commit(name, changes)
    return rollup.totals()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(prepare(spark), sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(prepare(spark), sf_dir, "documents"), tokenizer_path())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(prepare(spark), sf_dir, "documents"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 part codebooks of 16 entries after 6 rounds over the components in 4096ths."""
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return vector_codes(vectors, parts=8, entries=16, rounds=6, scale=4096)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after every seventh got the next label (a fixed rule of this query)."""
    vectors = table(prepare(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), anchors=100, scale=256, positives=5, negatives=5, least=(80, 100))


QUERIES = {"op1_chat": op1_chat, "op2_pii": op2_pii, "op5_licenses": op5_licenses, "op6_token_counts": op6_token_counts, "op7_media": op7_media, "op4_toxicity": op4_toxicity, "op8_packing": op8_packing, "op9_language": op9_language, "op3_simhash": op3_simhash, "op10_decontaminate": op10_decontaminate, "op11_lines": op11_lines, "op12_codes": op12_codes, "op13_hard_negatives": op13_hard_negatives}

#: Every window of a document as long as the item, compared in full; items under five words are one shingle.
OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, text, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, hash(text) AS th, ws FROM doc_words WHERE ws <> ['']),
item_words AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM benchmark),
i AS (SELECT item_id, ws, len(ws) AS w, least(len(ws), 5) AS k, greatest(len(ws) - 4, 1) AS n FROM item_words WHERE ws <> ['']),
ish AS (SELECT item_id, k, array_to_string(ws[p:p+k-1], ' ') AS s, count(*) AS c
        FROM (SELECT item_id, ws, k, unnest(range(1, n + 1)) AS p FROM i) GROUP BY ALL),
dsh AS (SELECT doc_id, th, p, k, array_to_string(ws[p:p+k-1], ' ') AS s
        FROM (SELECT doc_id, th, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)),
pair AS (SELECT DISTINCT doc_id, th, item_id FROM dsh JOIN ish USING (k, s)),
win AS (SELECT p.doc_id, p.th, p.item_id, i.n, i.k, unnest(range(1, len(d.ws) + 1)) AS start, i.w, len(d.ws) AS nd
        FROM pair p JOIN d ON d.doc_id = p.doc_id AND d.th = p.th JOIN i ON i.item_id = p.item_id),
sized AS (SELECT *, least(w, nd - start + 1) AS nw FROM win),
have AS (SELECT z.doc_id, z.th, z.item_id, z.start, z.n, z.nw - z.k + 1 AS m, x.s, count(*) AS cw
         FROM sized z JOIN dsh x ON x.doc_id = z.doc_id AND x.th = z.th AND x.k = z.k AND x.p BETWEEN z.start AND z.start + z.nw - z.k
         WHERE z.nw >= z.k GROUP BY ALL),
score AS (SELECT h.doc_id, h.th, h.item_id, h.start, h.n, h.m, sum(least(h.cw, ish.c)) AS shared
          FROM have h JOIN ish ON ish.item_id = h.item_id AND ish.s = h.s GROUP BY ALL),
sim AS (SELECT doc_id, th, item_id, start, shared * 1.0 / (n + m - shared) AS j FROM score)
SELECT doc_id, item_id, round(max(j), 6) AS similarity, CAST(min(start) FILTER (WHERE j >= best - 1e-9) - 1 AS BIGINT) AS window_start
FROM (SELECT *, max(j) OVER (PARTITION BY doc_id, th, item_id) AS best FROM sim)
WHERE best >= 0.8 - 1e-12
GROUP BY doc_id, th, item_id
"""

#: Escapes add one character for each backslash and each place where a control string begins.
OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, role AS r0, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT unnest(['<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<start_of_turn>', '<end_of_turn>']) AS mark),
u AS (SELECT row_number() OVER () AS k, * FROM t),
e AS (SELECT k, sum((length(text) - length(replace(text, mark, ''))) // length(mark) + (length(role) - length(replace(role, mark, ''))) // length(mark)) AS marks
      FROM u, c GROUP BY k)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r0 NULLS FIRST, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, r0 NULLS FIRST, text), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 24 + marks + length(text) - length(replace(text, chr(92), '')) + length(role) - length(replace(role, chr(92), ''))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS media_tokens
FROM u JOIN e USING (k) GROUP BY conv_id
"""

#: Lines by the text of their key; a row is a group, so any_value is its id.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, ls[p] AS line, p, translate(trim(ls[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
s AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM l LEFT JOIN s ON l.k = s.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round in full: all parts against all entries of their codebook, then the floored means."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS part FROM v, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, part AS entry FROM x WHERE r <= {entries})"""]
    near = """a{0} AS MATERIALIZED (SELECT r, p, part, k, d FROM (
    SELECT r, x.p, part, k, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{0} b ON b.p = x.p)
  QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1)"""
    for i in range(rounds):
        steps += [
            near.format(i),
            f"m{i} AS (SELECT p, k, j, sum(part[j]) AS s, count(*) AS c FROM (SELECT p, k, part, unnest(range(1, len(part) + 1)) AS j FROM a{i}) GROUP BY ALL)",
            f"""b{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.entry, o.entry) AS entry FROM b{i} o LEFT JOIN
  (SELECT p, k, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY j) AS entry FROM m{i} GROUP BY p, k) n USING (p, k))""",
        ]
    steps += [near.format(rounds), f"w AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)"]
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, k)) FROM b{rounds}) AS codebooks_sha256
FROM w JOIN v USING (r)"""


#: All rows against all anchors.
OP13_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

SQL = {"op1_chat": OP1_SQL, "op10_decontaminate": OP10_SQL, "op11_lines": OP11_SQL, "op12_codes": _op12_sql(), "op13_hard_negatives": OP13_SQL}
