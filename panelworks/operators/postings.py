"""Bags of hashed terms, counted in numpy inside tasks; ``df`` everywhere has a key and ``h``, its sorted term hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.session import checkpoint

#: Buckets of the sketch of document frequencies, and of the filter of terms that are asked for; both bound what is broadcast.
BUCKETS, SLOTS = 2**20, 2**23


def _bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of a batch, once for each row and term."""
    lists = batch.column("h")
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    term = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])][: len(term)])
    return row[first], term[first], np.diff(np.r_[first, len(term)])


def slots(terms: DataFrame) -> Broadcast:
    """A filter that lets every one of ``terms`` pass, and few others."""
    held = np.zeros(SLOTS, bool)
    at = terms.selectExpr(f"CAST(term & {SLOTS - 1} AS INT) AS s").distinct().toArrow().column("s").to_numpy()
    held[at] = True
    return terms.sparkSession.sparkContext.broadcast(held)


def sketch(df: DataFrame, held: Broadcast) -> tuple[DataFrame, np.ndarray, int]:
    """In one pass: (term, df) as :func:`document_frequencies`; for each bucket of terms how many (row, term) it has, which is no less than the
    rows that have any one of its terms; and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(BUCKETS, np.int64), 0
        out = lambda kind, at, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(n)], ["kind", "at", "n"])
        for batch in batches:
            term = _bags(batch)[1]
            n += np.bincount(term & (BUCKETS - 1), minlength=BUCKETS)
            rows += batch.num_rows
            yield out(0, *_asked(term, held))
        some = np.flatnonzero(n)
        yield out(1, some, n[some])
        yield out(2, np.zeros(1, np.int64), np.full(1, rows))

    counted = checkpoint(df.select("h").mapInArrow(count, "kind int, at long, n long").groupBy("kind", "at").agg({"n": "sum"}).toDF("kind", "at", "n"))
    rest = counted.where("kind > 0").toArrow()
    kind, at, n = (rest.column(c).to_numpy() for c in ("kind", "at", "n"))
    buckets = np.zeros(BUCKETS, np.int64)
    buckets[at[kind == 1]] = n[kind == 1]
    return counted.where("kind = 0").selectExpr("at AS term", "n AS df"), buckets, int(n[kind == 2].sum())


def _asked(term: np.ndarray, held: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Terms that ``held`` lets pass, and how many rows of a batch have them."""
    return np.unique(term[held.value[term & (SLOTS - 1)]], return_counts=True)


def document_frequencies(df: DataFrame, held: Broadcast) -> DataFrame:
    """(term, df): in how many rows each term of :func:`slots` is, exactly, and few others; a term in no row is left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = _asked(_bags(batch)[1], held)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["term", "n"])

    return df.select("h").mapInArrow(count, "term long, n long").groupBy("term").agg({"n": "sum"}).toDF("term", "df")


def counts(df: DataFrame, key: str, held: Broadcast) -> DataFrame:
    """(key, term, c): how often each term is in a row, for the rows whose key's hash passes ``held``, a filter of :func:`slots`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held.value[batch.column("_k").to_numpy() & (SLOTS - 1)]))
            row, term, c = _bags(batch)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(term), pa.array(c)], [key, "term", "c"])

    return df.select(key, "h", F.xxhash64(key).alias("_k")).mapInArrow(count, f"{key} {df.schema[key].dataType.simpleString()}, term long, c long")


def shares(df: DataFrame, key: str, held: Broadcast, buckets: np.ndarray, n: int) -> DataFrame:
    """(key, term, tf, low, high) for the terms of :func:`slots` and few others: sublinear tf, and the row's length between two bounds.

    ``buckets`` is of :func:`sketch`; as it never counts too few rows, weights by it are never too high.
    """
    least = np.log((1 + n) / (1 + np.minimum(buckets, n))) + 1
    most = np.log((1 + n) / 2) + 1
    least = df.sparkSession.sparkContext.broadcast(least)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, c = _bags(batch)
            tf = 1 + np.log(c)
            total = lambda x: np.sqrt(np.bincount(row, x * x, batch.num_rows))
            low, high = total(tf * least.value[term & (BUCKETS - 1)]), total(tf * most)
            at = np.flatnonzero(held.value[term & (SLOTS - 1)])
            r = row[at]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(r)), pa.array(term[at]), pa.array(tf[at]), pa.array(low[r]), pa.array(high[r])], [key, "term", "tf", "low", "high"])

    return df.select(key, "h").mapInArrow(weigh, f"{key} {df.schema[key].dataType.simpleString()}, term long, tf double, low double, high double")


#: Postings that a slice of a batch is met with at once; bounds what a task holds.
SLICE = 2**21


def bounds(df: DataFrame, key: str, makes: DataFrame, buckets: np.ndarray, n: int, least: float) -> DataFrame:
    """(asked_id, key, at_least, at_most) where the cosine of a row and a question may reach ``least``.

    ``makes`` (asked_id, term, light, _w) comes whole to every task, so its rows must be counted and few. A row's terms are in
    one place, so its sums are done there and only pairs that may reach ``least`` leave the task. ``df`` and ``buckets`` as in
    :func:`shares`.
    """
    sc = df.sparkSession.sparkContext
    rows = makes.select("asked_id", "term", "light", "_w").toArrow()
    asked, at = np.unique(rows.column("asked_id").to_numpy(), return_inverse=True)
    light = np.zeros(len(asked))
    light[at] = rows.column("light").to_numpy()
    terms = rows.column("term").to_numpy()
    order = np.argsort(terms, kind="stable")
    terms, starts = np.unique(terms[order], return_index=True)
    smallest = np.log((1 + n) / (1 + np.minimum(buckets, n))) + 1
    most = np.log((1 + n) / 2) + 1
    slots = np.zeros(SLOTS, bool)
    slots[terms & (SLOTS - 1)] = True
    held = sc.broadcast((slots, smallest, asked, light, terms, np.r_[starts, len(order)], at[order].astype(np.int64), rows.column("_w").to_numpy()[order]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, smallest, asked, light, terms, starts, who, weight = held.value
        for batch in batches:
            row, term, c = _bags(batch)
            tf = 1 + np.log(c)
            total = lambda x: np.sqrt(np.bincount(row, x * x, batch.num_rows))
            low, high = total(tf * smallest[term & (BUCKETS - 1)]), total(tf * most)
            some = np.flatnonzero(slots[term & (SLOTS - 1)])
            place = np.searchsorted(terms, term[some])
            right = place < len(terms)
            right[right] = terms[place[right]] == term[some][right]
            some, place = some[right], place[right]
            row, tf, first, many = row[some], tf[some], starts[place], starts[place + 1] - starts[place]
            # Slices end where a row does, so that no pair is in two of them.
            ends = np.flatnonzero(np.r_[row[1:] != row[:-1], True][: len(row)]) + 1
            upto, lo = np.cumsum(many), 0
            while lo < len(row):
                before = upto[lo - 1] if lo else 0
                fits = ends[(ends > lo) & (upto[ends - 1] - before <= SLICE)]
                hi = fits[-1] if len(fits) else ends[ends > lo][0]
                m = many[lo:hi]
                posting = np.repeat(first[lo:hi] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
                pair, inverse = np.unique(np.repeat(row[lo:hi], m) * len(asked) + who[posting], return_inverse=True)
                dot = np.bincount(inverse, np.repeat(tf[lo:hi], m) * weight[posting], len(pair))
                r, q = pair // len(asked), pair % len(asked)
                above = dot / low[r] + light[q]
                kept = np.flatnonzero(above >= least)
                r, q = r[kept], q[kept]
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), batch.column(key).take(pa.array(r)), pa.array(dot[kept] / high[r]), pa.array(above[kept])], ["asked_id", key, "at_least", "at_most"])
                lo = hi

    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    return df.select(key, "h").mapInArrow(meet, f"asked_id {kind(makes, 'asked_id')}, {key} {kind(df, key)}, at_least double, at_most double")
