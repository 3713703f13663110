"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are cut into tiles by their population counts: the bits set in each of four 16-bit
words. Two fingerprints within the radius have counts whose differences add up to the radius at
most, so only tiles that close are paired; within a pair numpy compares all fingerprints with
exclusive-or and bit counts. The result is exact. Equal fingerprints are compared once.

A tile pair is one row of an ordinary join, so Spark deals pairs out and splits hot tiles. Links
leave a tile pair as a spanning forest, never as all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.components import connected_components
from panelworks.llm.names import unused
from panelworks.session import checkpoint

SEED = 42
RADIUS = 3
TILE_ROWS = 4096
_STEP = 1 << 16
_BASE = 32


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of ``width``-word shingles with repeats; 0 for null or no words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words is one
    shingle. A bit is set if more than half of the shingles' XXH64 values (seed 42) have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if width > 1 else iter(words)
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    while len(part := list(itertools.islice(shingles, _STEP))):
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(prints.view(np.int64))], names=["id", "text_hash", "fp"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell -> one row for each run of at most TILE_ROWS fingerprints of a cell."""
    cell, held, number = None, [], 0

    def tile():
        return pa.RecordBatch.from_arrays(
            [pa.array([cell], pa.int32()), pa.array([number], pa.int32()), pa.array([np.concatenate(held).tobytes()], pa.binary())],
            names=["cell", "tile", "fps"],
        )

    for batch in batches:
        cells, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if cells[lo] != cell:
                if held:
                    yield tile()
                cell, held, number = int(cells[lo]), [], 0
            while lo < hi:
                room = TILE_ROWS - sum(map(len, held))
                held.append(prints[lo : min(hi, lo + room)])
                lo += room
                if sum(map(len, held)) == TILE_ROWS:
                    yield tile()
                    held, number = [], number + 1
    if held:
        yield tile()


def _forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join up the same rows and columns as the true cells of ``near`` do."""
    rows, cols = near.any(axis=1), near.any(axis=0)
    while (left := np.flatnonzero(rows)).size:
        todo, reached = [int(left[0])], np.zeros(near.shape[1], bool)
        rows[todo[0]] = False
        while todo:
            i = todo.pop()
            new = near[i] & ~reached & cols
            reached |= new
            for j in np.flatnonzero(new):
                yield i, int(j)
                more = np.flatnonzero(near[:, j] & rows)
                rows[more] = False
                for k in more:
                    yield int(k), int(j)
                todo.extend(map(int, more))
        cols &= ~reached


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of links enough to connect all that lie within ``radius``."""
    found = [(np.empty(0, np.int64),) * 2]
    step = max(1, (1 << 21) // max(1, len(b)))
    for lo in range(0, len(a), step):
        near = np.bitwise_count(a[lo : lo + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i) > near.shape[0] + near.shape[1]:
            i, j = np.array(list(_forest(near)), np.int64).T
        found.append((i + lo, j))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                i, j = near_pairs(a, b, radius)
                if len(i):
                    left.append(a[i])
                    right.append(b[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(s).view(np.int64)) for s in (left, right)], names=["x", "y"]
            )

    return run


def _word_bits(fp: str, word: int):
    return F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * word).bitwiseAND(F.lit(0xFFFF)))


def _offsets(radius: int) -> list[int]:
    """Differences of cell numbers to tiles that can hold neighbours; one of each opposite pair."""
    near = (o for o in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius)
    return sorted({sum(x * _BASE**i for i, x in enumerate(o)) for o in near if o >= (0, 0, 0, 0)})


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(x, y) links between distinct fingerprints of ``prints`` (column fp) that connect the same
    fingerprints as all pairs within ``radius`` bits do. 0 <= radius <= 7."""
    cell = sum((_word_bits("fp", i) + 8) * F.lit(_BASE**i) for i in range(4)).cast("int")
    tiles = checkpoint(
        prints.select(cell.alias("cell"), "fp")
        .repartition("cell")
        .sortWithinPartitions("cell", "fp")
        .mapInArrow(_tiles, "cell int, tile int, fps binary")
    )
    sent = tiles.select(
        F.col("fps").alias("a"), F.col("cell").alias("home"), F.col("tile").alias("home_tile"),
        F.explode(F.array(*[F.col("cell") + F.lit(o) for o in _offsets(radius)])).alias("cell"),
    )
    pairs = sent.join(tiles, "cell").where((F.col("home") != F.col("cell")) | (F.col("home_tile") <= F.col("tile")))
    return pairs.select("a", "fps").mapInArrow(_compare(radius), "x long, y long").where("x != y").distinct()


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, fp) for every row."""
    text = F.col(text_col).cast("string")
    return checkpoint(
        docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
            _fingerprints, "id long, text_hash long, fp long"
        )
    )


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes``, one row for each distinct fp, with root: a fingerprint of its group.

    Fingerprints are the nodes, so ids may be any number, null or repeated, and rows never meet by group.
    """
    nodes = checkpoint(nodes)
    roots = connected_components(near_links(nodes, radius))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id that can be reached over links of ``radius`` bits or fewer.
    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take
    part; a group in which no row has an id gets a null component_id. Repeated rows stay.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = _fingerprinted(docs, id_col, text_col)
    nodes = checkpoint(_rooted(rows.groupBy("fp").agg(F.min("id").alias("least")), radius))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near duplicates: of each group the row of the smallest doc_id stays.

    Rows that share a doc_id are told apart by their texts, of which that of the smallest hash stays; of
    equal (doc_id, text) rows one stays. A row with a null doc_id stays only if its group has no row with
    an id. All columns are kept as they are.
    """
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("head_id"), F.col("text_hash").alias("head_hash"))
    rows = _fingerprinted(docs, "doc_id", "text").groupBy("fp", "id", "text_hash").agg(F.count("*").alias("n"))
    # The first row of each fingerprint, combined before the shuffle, then that of each group.
    nodes = rows.groupBy("fp").agg(F.min(F.struct(rank.alias("rank"), "n")).alias("head"))
    heads = _rooted(nodes, radius).groupBy("root").agg(F.min("head").alias("head"))
    id_of, hash_of, own, many = unused(docs, "_head_id", "_head_hash", "_text_hash", "_many")
    heads = checkpoint(heads.select(F.col("head.rank.head_id").alias(id_of), F.col("head.rank.head_hash").alias(hash_of), (F.col("head.n") > 1).alias(many)))
    hashed = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    here = lambda heads: F.col("doc_id").cast("long").eqNullSafe(heads[id_of]) & (F.col(own) == heads[hash_of])
    # Texts are dealt a second time only for heads that come as several equal rows.
    once, repeated = heads.where(~F.col(many)), heads.where(many)
    kept = hashed.join(once, here(once), "left_semi")
    if repeated.limit(1).count():
        kept = kept.unionByName(hashed.join(repeated, here(repeated), "left_semi").dropDuplicates(["doc_id", own]))
    return kept.drop(own)
