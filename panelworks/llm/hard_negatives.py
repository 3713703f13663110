"""Hard negatives by a secondary-sort shuffle.

Rows are put into blocks; anchors meet the rows block by block, as integer inner products. A first pass
keeps each block's best rows of an anchor's own label, of which the anchor's positives come. In a second
pass a block passes on, for each positive, only the first rows of its window, as no others of that block can
be among the first overall. Each pair is one packed key of (anchor, descending score, positives first, id).
repartitionAndSortWithinPartitions brings an anchor's keys together in that order, and one walk over them
opens a window at each positive and hands out negatives until the window is full: a few open windows
are all that is held, however many rows an anchor meets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelworks.llm.vectors import integers, whole
from panelworks.session import checkpoint

#: Numbers of a block; blocks of a group, whose blocks all anchors meet in one place; anchors of a block.
BLOCK_VALUES = 1 << 19
GROUP_BLOCKS = 16
ANCHOR_ROWS = 1024
_STEP = 1 << 22
_KEY = struct.Struct(">QQBBQ")
_SIGN = 1 << 63
_BLOCK = "keys binary, ids binary, named binary, labels binary, vectors binary"
_ANCHOR = "anchor long, anchor_id long, label long, vector binary"
_ASKED = "a_keys binary, a_ids binary, a_labels binary, a_vectors binary, wanted array<array<long>>"
_PAIR = "anchor long, anchor_id long, score long, id long"


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.Array]]:
    """The columns of every ``size`` rows, and of what is left."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            held.append(part)
            rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
            if rows == size:
                yield [pa.chunked_array(c).combine_chunks() for c in zip(*(b.columns for b in held))]
                held, rows = [], 0
    if rows:
        yield [pa.chunked_array(c).combine_chunks() for c in zip(*(b.columns for b in held))]


def _deal(scale: float, width: int):
    """Rows of id, label and vector -> blocks; a row's key is unique within the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for ids, labels, vectors in _runs(batches, max(1, BLOCK_VALUES // width)):
            keys, named = np.arange(first, first + len(ids)), ids.is_valid().to_numpy(zero_copy_only=False)
            first += len(ids)
            columns = keys, ids.fill_null(0).to_numpy(), named, labels.to_numpy(), integers(vectors, scale, width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["keys", "ids", "named", "labels", "vectors"])

    return run


def _numbers(batch: pa.RecordBatch, i: int, name: str, kind=np.int64) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.names.index(name))[i].as_buffer(), kind)


def _block(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    keys, ids, labels = (_numbers(batch, i, name) for name in ("keys", "ids", "labels"))
    return keys, ids, _numbers(batch, i, "named", np.bool_), labels, _numbers(batch, i, "vectors", np.int32).reshape(len(keys), -1)


def _anchors(every: int):
    """The rows of blocks whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ids, named, labels, vectors = _block(batch, i)
                (at,) = np.nonzero(named & (ids % every == 0))
                columns = [pa.array(c[at]) for c in (keys, ids, labels)] + [pa.array([v.tobytes() for v in vectors[at]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "anchor_id", "label", "vector"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their wanted scores -> blocks of them."""
    for keys, ids, labels, vectors, wanted in _runs(batches, ANCHOR_ROWS):
        binary = [c.to_numpy().tobytes() for c in (keys, ids, labels)] + [b"".join(vectors.to_pylist())]
        columns = [pa.array([c], pa.binary()) for c in binary] + [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), wanted)]
        yield pa.RecordBatch.from_arrays(columns, names=["a_keys", "a_ids", "a_labels", "a_vectors", "wanted"])


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of every anchor with every row."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if most < 1 << 53:  # every sum is a whole number that a double holds
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(anchor, its id, label, wanted scores, its scores with the block's rows, block), one anchor at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, ids, labels = (_numbers(batch, i, name) for name in ("a_keys", "a_ids", "a_labels"))
            vectors = _numbers(batch, i, "a_vectors", np.int32).reshape(len(keys), -1)
            wanted, block = batch.column(batch.schema.names.index("wanted"))[i].as_py(), _block(batch, i)
            step = max(1, _STEP // max(1, len(block[0])))
            for lo in range(0, len(keys), step):
                scores = _products(vectors[lo : lo + step], block[4])
                for k, row in enumerate(scores, lo):
                    yield int(keys[k]), int(ids[k]), labels[k], wanted[k], row, block


def _pairs(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """(anchor, its id, scores, ids, which have an id) -> batches of pairs."""
    held, rows = [], 0

    def batch():
        anchor, anchor_id, score, ids, named = (np.concatenate(c) for c in zip(*held))
        columns = [pa.array(anchor), pa.array(anchor_id), pa.array(score), pa.array(ids, mask=~named)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "anchor_id", "score", "id"])

    for anchor, anchor_id, scores, ids, named in found:
        held.append((np.full(len(ids), anchor), np.full(len(ids), anchor_id), scores, ids, named))
        rows += len(ids)
        if rows > 4096:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def _first(scores: np.ndarray, named: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` best scores; ties by smaller id, rows without one last."""
    if len(scores) > n:
        floor = np.partition(scores, len(scores) - n)[len(scores) - n]
        (some,) = np.nonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], ~named[some], -scores[some]))[:n]]


def _own_label(n: int):
    """The ``n`` best rows of the anchor's label in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best():
            for anchor, anchor_id, label, _, scores, (keys, ids, named, labels, _) in _meetings(batches):
                (same,) = np.nonzero((labels == label) & (keys != anchor))
                at = same[_first(scores[same], named[same], ids[same], n)]
                yield anchor, anchor_id, scores[at], ids[at], named[at]

        yield from _pairs(best())

    return run


def _window(score: int, least: tuple[int, int]) -> int:
    """The smallest negative score that ``least[0] * score <= least[1] * negative`` admits."""
    return -((-least[0] * score) // least[1])


def _other_labels(n: int, least: tuple[int, int]):
    """For each positive of an anchor, the first ``n`` rows of other labels in each block's window.

    Windows of one anchor overlap; a row that is among the first of several is passed on once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def inside():
            for anchor, anchor_id, label, wanted, scores, (_, ids, named, labels, _) in _meetings(batches):
                if not wanted:
                    continue
                low = min(_window(p, least) for p in wanted)
                (other,) = np.nonzero((labels != label) & (scores <= max(wanted)) & (scores >= low))
                score, chosen = scores[other], set()
                for p in set(wanted):
                    (open_,) = np.nonzero((score <= p) & (score >= _window(p, least)))
                    chosen.update(open_[_first(score[open_], named[other[open_]], ids[other[open_]], n)].tolist())
                at = other[sorted(chosen)]
                yield anchor, anchor_id, scores[at], ids[at], named[at]

        yield from _pairs(inside())

    return run


def _key(anchor: int, score: int, negative: int, id_: int | None) -> bytes:
    """Bytes that sort by anchor, falling score, positives first, ids with null ones last."""
    return _KEY.pack(anchor, _SIGN - 1 - score, negative, id_ is None, (id_ or 0) + _SIGN)


def _unkey(key: bytes) -> tuple[int, int, int, int | None]:
    anchor, score, negative, unnamed, id_ = _KEY.unpack(key)
    return anchor, _SIGN - 1 - score, negative, None if unnamed else id_ - _SIGN


def _keyed(row) -> tuple[bytes, int]:
    return _key(row.anchor, row.score, row.negative, row.id), row.anchor_id


def _dealt_to(key: bytes) -> int:
    return zlib.crc32(key[:8])


def walk(keys: Iterator[tuple[bytes, int]], positives: int, negatives: int, least: tuple[int, int]) -> Iterator[tuple]:
    """(anchor id, positive, rank, negative, positive score, negative score) from (key, anchor id) in the order of keys.

    A positive opens a window; scores only fall from there, so a window ends when it is full or the
    score has left it, and at most ``positives`` windows are open.
    """
    at, opened, windows = None, 0, []
    for key, anchor_id in keys:
        anchor, score, negative, id_ = _unkey(key)
        if anchor != at:
            at, opened, windows = anchor, 0, []
        if negative:
            windows = [w for w in windows if w[2] < negatives and least[0] * w[1] <= least[1] * score <= least[1] * w[1]]
            for w in windows:
                w[2] += 1
                yield anchor_id, w[0], w[2], id_, w[1], score
        elif opened < positives:
            opened += 1
            windows.append([id_, score, 0])


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: int = 100, scale: float = 256,
    positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchors``. Scores are inner products of the components
    floor(scale * x); higher ones come first, ties by smaller id. An anchor's positives are its first
    ``positives`` other rows of its label. Each gets the first ``negatives`` rows of other labels whose score s
    has least[0] * positive <= least[1] * s and s <= positive.

    Rows with a null label or a vector that is null or holds null or non-finite components take no part.
    Ids and labels are whole numbers. A row without an id is no anchor, and comes last among equal scores.
    Rows of one id are rows of their own, as anchors too. Vectors shorter than the longest count as ended by
    zeros, components saturate at 2**24. A table without anchors gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & whole(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], schema)
    blocks = checkpoint(rows.mapInArrow(_deal(scale, max(1, longest)), _BLOCK))
    asked = checkpoint(blocks.mapInArrow(_anchors(anchors), _ANCHOR))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-blocks.count() // GROUP_BLOCKS))
    asked_blocks = max(1, -(-asked.count() // ANCHOR_ROWS))
    dealt = blocks.withColumn("group", F.pmod(F.xxhash64("keys"), F.lit(groups)).cast("int"))
    held = checkpoint(dealt.select("group").distinct())

    def met(anchors: DataFrame, score, *more: str) -> DataFrame:
        """Every anchor with every block: a block goes to one group, the few anchors to all groups that have a block.

        Sizes of binary columns are not known before a run; the hint keeps Spark from taking the anchors of all groups for
        a table that it may bring to the driver and broadcast.
        """
        sent = anchors.select("anchor", "anchor_id", "label", "vector", *more).repartition(asked_blocks).mapInArrow(_together, _ASKED)
        sent = sent.crossJoin(F.broadcast(held))
        return sent.hint("merge").join(dealt, "group").drop("group").mapInArrow(score, _PAIR)

    found = met(asked.withColumn("wanted", F.array().cast("array<long>")), _own_label(positives), "wanted")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    chosen = checkpoint(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"))
    scores = chosen.groupBy("anchor").agg(F.collect_list("score").alias("wanted"))  # ``positives`` numbers at most
    others = met(asked.hint("merge").join(scores, "anchor"), _other_labels(negatives, least), "wanted")

    pairs = chosen.withColumn("negative", F.lit(0)).unionByName(others.withColumn("negative", F.lit(1)))
    ordered = pairs.rdd.map(_keyed).repartitionAndSortWithinPartitions(parts, _dealt_to)
    return spark.createDataFrame(ordered.mapPartitions(lambda keys: walk(keys, positives, negatives, least)), schema)
