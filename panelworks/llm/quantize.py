"""Product quantisation by Lloyd rounds over partition-local cover trees.

Every partition puts its vectors into blocks, and every block holds one cover tree for each part of
the vectors, over points in tree order. A node is a run of that order with a centre and a radius, so
the sum of a subtree is a difference of cumulative sums. In a round a node goes to the nearest entry
as a whole if the triangle inequality shows that no other entry can be as near to any of its points;
only ambiguous nodes descend, and points of ambiguous leaves are compared exactly, in integers. A
task returns sums and counts of its entries, so what a round gathers has the size of the codebooks.
Blocks are written once to the shared folder, which is where a lost executor's tasks begin again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.vectors import integers, whole
from panelworks.session import checkpoint

BLOCK_ROWS = 4096
LEAF_ROWS = 16
#: A child's radius is at most its parent's, divided by this.
SHRINK = 1.5
_STEP = 1 << 14


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, nodes as (start, end, first child, end of children), radii.

    The first point of a node's run is its centre; a node without children is a leaf.
    """
    order, x = np.arange(len(points)), points.astype(np.float64)
    nodes, radii, at = [[0, len(points), 0, 0]], [], 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        run = order[start:end].copy()
        far = np.sqrt(((x[run] - x[run[0]]) ** 2).sum(axis=1))
        radius = float(far.max())
        radii.append(radius)
        if end - start > LEAF_ROWS and radius > 0:
            nodes[at][2], place = len(nodes), start
            while len(run):
                near = far <= radius / SHRINK
                near[0] = True
                group = run[near]
                order[place : place + len(group)] = group
                nodes.append([place, place + len(group), 0, 0])
                place += len(group)
                run = run[~near]
                if len(run):
                    far = np.sqrt(((x[run] - x[run[0]]) ** 2).sum(axis=1))
            nodes[at][3] = len(nodes)
        at += 1
    return order, np.array(nodes, np.int32), np.array(radii)


def _planted(block: np.ndarray, parts: int) -> dict[str, bytes]:
    """The trees of all parts of a block, one after the other: points of part p stand from p * rows on."""
    rows, width = len(block), block.shape[1] // parts
    points, orders, nodes, radii, owner, before = [], [], [], [], [], 0
    for p in range(parts):
        part = block[:, p * width : (p + 1) * width]
        order, tree, radius = cover_tree(part)
        points.append(part[order].astype(np.int32))
        orders.append(order.astype(np.int32))
        inner = tree[:, 3] > 0
        tree[:, :2] += p * rows
        tree[inner, 2:] += before
        nodes.append(tree)
        radii.append(radius)
        owner.append(np.full(len(tree), p, np.int32))
        before += len(tree)
    packed = {"points": points, "orders": orders, "nodes": nodes, "radii": radii, "owner": owner}
    return {k: np.concatenate(v).tobytes() for k, v in packed.items()}


_TREES = "points binary, orders binary, nodes binary, radii binary, owner binary"


def _plant(scale: float, parts: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def block():
            ids, labels, vectors = (pa.chunked_array(c).combine_chunks() for c in zip(*(b.columns for b in held)))
            trees = _planted(integers(vectors, scale, parts * width), parts)
            whole_run = pa.array([0, len(ids)], pa.int32())
            columns = [pa.ListArray.from_arrays(whole_run, c) for c in (ids, labels)]
            return pa.RecordBatch.from_arrays(columns + [pa.array([v], pa.binary()) for v in trees.values()], names=["ids", "labels", *trees])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == BLOCK_ROWS:
                    yield block()
                    held, rows = [], 0
        if rows:
            yield block()

    return run


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of (n, width) points to (n, entries, width) or (entries, width) entries."""
    return ((points[:, None, :] - entries) ** 2).sum(axis=2)


class Forest:
    """The trees of one block."""

    def __init__(self, row: dict[str, bytes], parts: int, width: int):
        self.points = np.frombuffer(row["points"], np.int32).reshape(-1, width).astype(np.int64)
        self.orders = np.frombuffer(row["orders"], np.int32)
        self.nodes = np.frombuffer(row["nodes"], np.int32).reshape(-1, 4)
        self.radii = np.frombuffer(row["radii"], np.float64)
        self.owner = np.frombuffer(row["owner"], np.int32)
        self.rows, self.parts = len(self.points) // parts, parts

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes assigned whole and their entries, single points and theirs."""
        nodes, entries, points, chosen = [], [], [], []
        front = np.searchsorted(self.owner, np.arange(self.parts))
        while len(front):
            sure, best = np.empty(len(front), bool), np.empty(len(front), np.int64)
            for lo in range(0, len(front), _STEP):
                part = front[lo : lo + _STEP]
                far = np.sqrt(_squares(self.points[self.nodes[part, 0]], books[self.owner[part]]).astype(np.float64))
                best[lo : lo + _STEP] = far.argmin(axis=1)
                if books.shape[1] == 1:
                    sure[lo : lo + _STEP] = True
                    continue
                first, second = np.partition(far, 1, axis=1)[:, :2].T
                # No point of the node is as near to another entry; the slack is far above rounding errors.
                sure[lo : lo + _STEP] = second - first > 2 * self.radii[part] + 1e-9 * (first + second) + 1e-6
            nodes.append(front[sure])
            entries.append(best[sure])
            left = front[~sure]
            leaf = self.nodes[left, 3] == 0
            rows = _ranges(self.nodes[left[leaf], 0], self.nodes[left[leaf], 1])
            for lo in range(0, len(rows), _STEP):
                part = rows[lo : lo + _STEP]
                points.append(part)
                chosen.append(_squares(self.points[part], books[part // self.rows]).argmin(axis=1))
            front = _ranges(self.nodes[left[~leaf], 2], self.nodes[left[~leaf], 3])
        join = lambda x: np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)
        return join(nodes), join(entries), join(points), join(chosen)

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, entries, width) sums and (parts, entries) counts of what each entry gets."""
        nodes, entries, points, chosen = self.assign(books)
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        running = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        start, end = self.nodes[nodes, 0], self.nodes[nodes, 1]
        np.add.at(total, (self.owner[nodes], entries), running[end] - running[start])
        np.add.at(count, (self.owner[nodes], entries), end - start)
        np.add.at(total, (points // self.rows, chosen), self.points[points])
        np.add.at(count, (points // self.rows, chosen), 1)
        return total, count

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entries, and the exact squared distance of each row."""
        nodes, entries, points, chosen = self.assign(books)
        found = np.empty(len(self.points), np.int64)
        start, end = self.nodes[nodes, 0], self.nodes[nodes, 1]
        found[_ranges(start, end)] = np.repeat(entries, end - start)
        found[points] = chosen
        part = np.arange(len(found)) // self.rows
        error = ((self.points - books[part, found]) ** 2).sum(axis=1)
        codes, errors = np.empty((self.rows, self.parts), np.uint8), np.zeros(self.rows, np.int64)
        codes[self.orders, part] = found
        np.add.at(errors, self.orders, error)
        return codes, errors


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    start, size = start.astype(np.int64), (end - start).astype(np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.empty(0, np.int64)


def _forests(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[Forest]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield Forest({k: batch.column(names.index(k))[i].as_buffer() for k in ("points", "orders", "nodes", "radii", "owner")}, parts, width)


def _gather(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for forest in _forests(batch, parts, width):
                more, n = forest.sums(books)
                total, count = total + more, count + n
        place, of = np.nonzero(count)
        values = np.concatenate([count[place, of][:, None], total[place, of]], axis=1)  # the count stands before the sums
        slot = (np.arange(width + 1) + (place * entries + of)[:, None] * (width + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(values.ravel(), pa.int64())], names=["slot", "value"])

    return run


def _coded(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, forest in enumerate(_forests(batch, parts, width)):
                codes, errors = forest.codes(books)
                text = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(text), pa.array(errors)], names=["id", "label", "code", "error"])

    return run


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each row whose vector is null-free and finite.

    Components are floor(scale * x), a vector is ``parts`` equal parts, and each part position has
    ``entries`` (256 at most) codebook entries: at first those parts of the smallest ids, then ``rounds``
    times the floored means of what is nearest, ties to the lower index. error is the squared distance
    over all parts, label_error its sum over equal labels, those without a label together.

    Null ids sort last, rows of one id by their vectors; repeated rows count and stay. With fewer rows
    than entries the codebooks are as short. Vectors shorter than the longest, or than the next multiple of
    ``parts``, count as ended by zeros. Integer components saturate at 2**24. label_error stops at the
    largest long. A table without a whole vector gives an empty result; other columns are ignored.
    """
    spark, kinds = vectors.sparkSession, {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(whole(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"{id_col} {kinds[id_col]}, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, -(-longest // parts))
    blocks = checkpoint(rows.mapInArrow(_plant(scale, parts, width), f"ids array<{kinds[id_col]}>, labels array<{kinds[label_col]}>, {_TREES}"))
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()  # ``entries`` vectors
    first = integers(pa.array([list(r[0]) for r in seeds], pa.list_(pa.float64())), scale, parts * width)
    books = np.ascontiguousarray(first.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        gathered = np.zeros(books.size + books.shape[0] * books.shape[1], object)
        sums = blocks.mapInArrow(_gather(books), "slot int, value long").groupBy("slot").agg(F.sum("value"))
        for slot, value in sums.collect():  # one number for each component of the codebooks, and the counts
            gathered[slot] = value
        gathered = gathered.reshape(*books.shape[:2], width + 1)
        used = gathered[:, :, 0] > 0
        after = books.copy()
        after[used] = (gathered[used][:, 1:] // gathered[used][:, :1]).astype(np.int64)
        if (after == books).all():  # further rounds change nothing
            break
        books = after
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    done = checkpoint(blocks.mapInArrow(_coded(books), f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    totals = done.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long").alias("label_error"))
    totals = totals.select(F.col("label").alias("of"), "label_error")
    joined = done.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
