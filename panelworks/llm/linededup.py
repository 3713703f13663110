"""Repeated lines across documents: exploded, counted by hash, dropped, put together by position.

Lines travel as two 64-bit hashes with their document and position, never as text. How many documents
hold a hash is a grouped count that combines before the shuffle, so a line of every third document
is one row a task. The repeated hashes go back to their lines by an ordinary equi-join, whose hot keys
adaptive execution splits, and only the positions to drop travel on to the documents. DataFrame
functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.names import unused
from panelworks.session import checkpoint

#: Stripped from both ends of a line before it is compared.
SPACES = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What lines are compared by: white space off both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # lower() is many times as fast there, and the same
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hashes(x: Column) -> list[Column]:
    """128 bits, so that no two of 10**12 lines are taken for one; the second hash begins with another seed."""
    return [F.xxhash64(x), F.xxhash64(F.lit(1), x)]


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the hashes in at least ``min_docs`` documents; ``lines`` has doc, h1 and h2.

    keeper is the smallest doc. Lines without a doc belong to one document that comes last. Two documents need no distinct count: the least and
    the largest doc tell them apart in one pass.
    """
    unnamed = F.max(F.col("doc").isNull().cast("int"))
    if min_docs == 2:
        n_docs = F.when(F.min("doc") == F.max("doc"), 1).when(F.min("doc").isNotNull(), 2).otherwise(0)
    else:
        n_docs = F.count_distinct("doc")
    found = lines.groupBy("h1", "h2").agg((n_docs + unnamed).cast("long").alias("n_docs"), F.min("doc").alias("keeper"))
    return found.where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with its columns, the text without repeated lines, and n_lines and n_dropped (long).

    A line whose key has at least ``min_chars`` code points and lies in at least ``min_docs`` documents goes
    from all documents but that of the smallest id, which keeps each of its copies. The other lines
    stay as they are, in their order, joined by a line feed. Documents are told apart by their id; rows
    of one id are one document, rows without an id are one document too, which comes last. Null and
    empty texts are one empty line and become the empty text. Repeated rows stay, an empty table gives
    an empty result, and a column n_lines or n_dropped of ``docs`` gives way to the new one.
    """
    text, lines = F.col(text_col).cast("string"), lines_of(F.col(text_col).cast("string"))
    t1, t2 = _hashes(text)
    exploded = (
        docs.select(F.col(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"), lines.alias("lines"))  # a text is hashed before it is exploded
        .select("doc", "t1", "t2", F.posexplode("lines").alias("pos", "line"))
        .where(F.char_length(F.btrim(F.col("line"), F.lit(SPACES))) >= min_chars)
    )
    h1, h2 = _hashes(line_key(F.col("line")))
    hashed = exploded.select("doc", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))
    # Written, so that both sides of the join are plain shuffles, of which adaptive execution can split a hot hash.
    repeated = checkpoint(repeated_lines(hashed.select("doc", "h1", "h2"), min_docs).drop("n_docs"))
    # Rows that share id and text lose the same lines, so that pair names a text, whatever repeats.
    gone = (
        hashed.join(repeated, ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    )
    key_1, key_2, doc, k1, k2, went, split = unused(docs, "_t1", "_t2", "_doc", "_k1", "_k2", "_gone", "_lines")
    gone = gone.select(F.col("doc").alias(doc), F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("gone").alias(went))
    here = F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(key_1) == F.col(k1)) & (F.col(key_2) == F.col(k2))
    joined = docs.withColumns({key_1: t1, key_2: t2}).join(gone, here, "left").withColumn(split, lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(went))  # linear: by hash set
    kept = F.when(F.col(went).isNull(), F.coalesce(text, F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda p: F.get(F.col(split), p)), "\n")
    )
    counts = {"n_lines": F.size(split).cast("long"), "n_dropped": F.coalesce(F.size(went), F.lit(0)).cast("long")}
    return joined.select(
        *[(kept.alias(c) if c == text_col else F.col(c)) for c in docs.columns if c.lower() not in counts],
        *[c.alias(name) for name, c in counts.items()],
    )
