"""Line dedup, vector codes and hard negatives against brute force, with edge cases."""

import hashlib
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import hard_negatives as hn
from panelworks.llm import linededup, quantize
from panelworks.llm.vectors import LIMIT, integers

UPPER, SPACE = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}), " \t\n\x0b\x0c\r"
VECTORS = "vec_id long, embedding array<double>, label int, extra string"


# Line dedup.
def slow_lines(rows, min_docs=2):
    key = lambda line: line.strip(SPACE).translate(UPPER)
    last = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < min_docs or min(holders[key(x)], key=last) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.fixture(scope="module")
def line_rows():
    common, wide = "The same line for ALL of us", "Ähnliche Zeile für ALLE "
    rows = [(5, f"{common}\nshort\nonly here, five\n"), (3, f"  {common.lower()} \t\nshort\r\nwith {wide}"), (None, f"{common}\nno id here at all"), (None, "no id here at all")]
    rows += [(7, None), (8, ""), (9, "\n\n"), (10, wide), (11, wide.replace("A", "a")), (11, f"x\n{wide}"), (12, f"{common}\n{common}"), (12, f"{common}\n{common}")]
    rows += [(2, "abcdefghi\nabcdefghij\nABCDEFGHIJ"), (4, "abcdefghi\n ABCDEFGHIJ"), (13, "日本語の行です十文字だ\nx"), (14, "日本語の行です十文字だ"), (15, "\n".join(["very long", common] * 20000 + ["end of the text"]))]
    rng = np.random.default_rng(4)
    return rows + [(20 + i, "\n".join(f"line number {n}" for n in rng.integers(0, 60, 8))) for i in range(40)]


@pytest.mark.parametrize("min_docs", [2, 4])
def test_lines_against_brute_force(spark, line_rows, min_docs):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in line_rows], "doc_id long, text string, N_lines int, _gone string").repartition(5)
    got = linededup.drop_repeated_lines(docs, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "_gone", "n_lines", "n_dropped"]
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == slow_lines(line_rows, min_docs)


def test_lines_of_an_empty_table(spark):
    assert linededup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Vector codes.
def slow_codes(rows, rounds, parts=8, entries=16, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(r[1]) for r in kept) // parts))
    x = np.zeros((len(kept), parts * width), object)
    for i, r in enumerate(kept):
        x[i, : len(r[1])] = [int(min(max(np.floor(v * scale), -LIMIT), LIMIT)) for v in r[1]]
    x = x.reshape(len(kept), parts, width)
    books = [[list(x[e, p]) for e in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((int(u) - int(v)) ** 2 for u, v in zip(a, b))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (far(row[p], books[p][e]), e)) for p in range(parts)] for row in x]
    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[i, p] for i in range(len(x)) if codes[i][p] == e]
                if mine:
                    books[p][e] = [int(sum(col)) // len(mine) for col in zip(*mine)]
    codes = nearest()
    errors = [sum(far(row[p], books[p][code[p]]) for p in range(parts)) for row, code in zip(x, codes)]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return Counter((r[0], bytes(c).hex(), e, by_label[r[2]], digest) for r, c, e in zip(kept, codes, errors))


def some_vectors(seed, n, dims, clusters=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (clusters, dims))
    at = rng.integers(0, clusters, n)
    return [[float(v) for v in row] for row in np.float32(middle[at] + rng.normal(0, 0.05, (n, dims)))], at


@pytest.fixture(scope="module")
def vector_rows():
    vectors, at = some_vectors(1, 300, 16)
    rows = [(1000 - i, v, int(k) if k else None) for i, (v, k) in enumerate(zip(vectors, at))]
    rows += [(1, None, 1), (2, [1.0] * 15 + [None], 1), (3, [float("nan")] * 16, 2), (4, [float("inf")] * 16, 2), (5, [], 3), (6, [0.5] * 3, 3), (None, [0.25] * 16, 4), (7, [-1e30] + [0.0] * 15, 4)]
    return rows + [rows[0], rows[0], (8, rows[5][1], 1), (8, rows[6][1], 1), *[(9, [0.125] * 16, 5)] * 40]


def test_codes_against_brute_force(spark, vector_rows, monkeypatch):
    frame = spark.createDataFrame([(*r, "x") for r in vector_rows], VECTORS).repartition(3)
    for rounds in (0, 6):
        got = quantize.vector_codes(frame, rounds=rounds)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(map(tuple, got.collect())) == slow_codes(vector_rows, rounds)


def test_codes_of_few_rows(spark):
    none = [(1, None, 1, "x"), (2, [None], 1, "x")]
    assert quantize.vector_codes(spark.createDataFrame(none, VECTORS)).count() == 0
    assert quantize.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(3, [1.0, 2.0, 3.0], None), (2, [-1.0, 0.5, 2.0], None)]
    got = quantize.vector_codes(spark.createDataFrame([(*r, "x") for r in few], VECTORS))
    assert Counter(map(tuple, got.collect())) == slow_codes(few, 6)


def test_cover_trees_cover_and_save_comparisons():
    vectors, _ = some_vectors(3, 2000, 8, clusters=4)
    x = np.floor(np.array(vectors) * 4096).astype(np.int64)
    order, nodes, radii = quantize.cover_tree(x)
    assert sorted(order) == list(range(len(x)))
    for (start, end, first, last), radius in zip(nodes, radii):
        assert np.sqrt(((x[order[start:end]] - x[order[start]]) ** 2).sum(axis=1)).max() <= radius * (1 + 1e-12)
        if last:
            assert [nodes[first, 0], nodes[last - 1, 1]] == [start, end]
            assert (nodes[first : last - 1, 1] == nodes[first + 1 : last, 0]).all()
    forest = quantize.Forest(quantize._planted(x, 1), 1, 8)
    books = x[[np.argmin(((x - np.floor(np.array(c) * 4096)) ** 2).sum(axis=1)) for c in np.random.default_rng(3).normal(0, 1, (4, 8))]][None]
    whole, entries, points, _ = forest.assign(books)
    assert len(points) < 0.05 * len(x)  # four clusters: nearly all points go with their subtree
    codes, errors = forest.codes(books)
    far = ((x[:, None] - books[0]) ** 2).sum(axis=2)
    assert (codes[:, 0] == far.argmin(axis=1)).all() and (errors == far.min(axis=1)).all()


# Hard negatives.
def slow_negatives(rows, every=100, positives=5, negatives=5):
    kept = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = [[int(min(max(np.floor(x * 256), -LIMIT), LIMIT)) for x in r[1]] for r in kept]
    out = Counter()
    for a, row in enumerate(kept):
        if row[0] is None or row[0] % every:
            continue
        scored = [(sum(u * v for u, v in zip(ints[a], ints[b])), o[0], o[2]) for b, o in enumerate(kept) if b != a]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, pid, _ in [s for s in scored if s[2] == row[2]][:positives]:
            hard = [s for s in scored if s[2] != row[2] and 80 * ps <= 100 * s[0] <= 100 * ps][:negatives]
            out.update((row[0], pid, k, s[1], ps, s[0]) for k, s in enumerate(hard, 1))
    return out


def negative_rows():
    vectors, at = some_vectors(7, 600, 8, clusters=3)
    rng = np.random.default_rng(8)
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    rows += [(700, [0.5] * 8, 1), (700, [0.5] * 8, 1), (700, [0.5] * 7, 2), (800, [0.0] * 8, 3), (-100, [-1.0] * 8, 0), (None, [0.5] * 8, 1), (None, [0.5] * 8, 2)]
    rows += [(900, None, 1), (901, [0.5] * 8, None), (1000, [float("nan")] * 8, 1), (1100, [None] * 8, 1), (1200, [], 2), (1300, [1e30] * 8, 2), (1301, [1e30] * 8, 1)]
    return rows + [(2000 + i, [0.5] * 8, i % 2 + 1) for i in range(30)]  # ties of score


def test_negatives_against_brute_force(spark, monkeypatch):
    rows = negative_rows()
    want = slow_negatives(rows)
    assert len(want) > 60
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3)
    got = hn.hard_negatives(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == want
    monkeypatch.setattr(hn, "BLOCK_VALUES", 400)  # many blocks and groups
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 3)
    assert Counter(map(tuple, hn.hard_negatives(frame).collect())) == want


def test_negatives_bring_no_anchors_to_the_driver(spark, monkeypatch, tmp_path):
    frames = type(spark.range(0))
    plans, run = [], frames.mapInArrow

    def seen(self, func, schema, *rest, **more):
        if schema == hn._PAIR:
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return run(self, func, schema, *rest, **more)

    monkeypatch.setattr(frames, "mapInArrow", seen)
    spark.createDataFrame([(*r, "x") for r in negative_rows()], VECTORS).write.parquet(f"{tmp_path}/v")
    hn.hard_negatives(spark.read.parquet(f"{tmp_path}/v"))  # a file's size is known, and those of what follows are guessed by it
    assert len(plans) == 2
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans), plans


def test_negatives_without_anchors(spark):
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1, "x"), (2, [1.0], 2, "x")], VECTORS)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_keys_sort_as_the_walk_needs():
    rows = [(a, s, n, i) for a in (0, 5) for s in (-(1 << 40), -1, 0, 7) for n in (0, 1) for i in (-3, 0, 9, None)]
    ordered = sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3] is None, r[3] or 0))
    assert [hn._unkey(k) for k in sorted(hn._key(*r) for r in rows)] == ordered
    assert struct.calcsize(hn._KEY.format) == len(hn._key(0, 0, 0, None))


def test_walk_holds_no_more_than_its_windows():
    keys = iter([(hn._key(1, 100, 0, 1), 50), *((hn._key(1, 99 - k // 1000, 1, k), 50) for k in range(50_000))])
    assert list(hn.walk(keys, 5, 3, (80, 100))) == [(50, 1, r + 1, r, 100, 99) for r in range(3)]


def test_integer_components(spark):
    import pyarrow as pa

    column = pa.array([[0.5, -0.0001], [], [1e300, -1e300]], pa.list_(pa.float64()))[0:]
    assert integers(column, 256, 2).tolist() == [[128, -1], [0, 0], [LIMIT, -LIMIT]]
