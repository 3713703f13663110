"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

1. Every text is tokenised once; its ids are kept as a blob and checkpointed. Document frequencies of
   all token ids are counted over all documents (one number for each id of the vocabulary).
2. Documents are dealt by range of a lexical key, so documents of like words meet: the most frequent
   token with a letter (which mostly tells the language), then a weighted min-hash of the token set
   (which tells copies and near copies). Equal keys are told apart by doc_id, so a large group of
   copies is split.
3. A task streams its documents in blocks. A block is one shard of the inverted index: for each seed
   the shard returns unused documents by BM25, best first, which fill the seed's window of tokens. A
   document that does not fit is cut, and its rest seeds the next window. What a partition has left
   at its end is cut into windows of powers of two, so no window is padded.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.session import checkpoint

WINDOW = 1024
#: A shard of the index holds so many documents at most.
SHARD_DOCS = 2048
#: and so many tokens, unless a single document is longer.
SHARD_TOKENS = 4_000_000
#: Terms of more documents of a shard than this (or a 32nd of them) are summed as matrices.
HEAVY_DF = 8
K1, B = 1.2, 0.75
# Fixed value: the vocabulary's special token.
SPECIAL = {"<|endoftext|>": 50256}
#: A task packs so many tokens at most on average.
TASK_TOKENS = 32_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Ids of byte_bpe_50k as little-endian 16-bit blobs, equal to those of the tokenizers library.

    The same vocabulary is read as ranks, which encodes a text in a third of the time. The vocabulary's
    special token is one id wherever its string occurs, as in that library.
    """

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        letters = [i for token, i in ranks.items() if any(c.isalpha() for c in token.decode("utf-8", "ignore"))]
        #: Which ids have a letter in them.
        self.words = np.zeros(1 << 16, bool)
        self.words[letters] = True

    def __call__(self, text: str) -> bytes:
        return self._encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u2").tobytes()


_ids: dict[str, Ids] = {}


def token_ids(ranks_path: str) -> Ids:
    """One tokenizer for each worker process."""
    if ranks_path not in _ids:
        _ids[ranks_path] = Ids(ranks_path)
    return _ids[ranks_path]


def _ranks() -> np.ndarray:
    """The order of ids by a weighted hash: a rarer id, which has a higher number here, tends to come first."""
    x = np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    drawn = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 1
    order = np.argsort(-np.log(drawn / 2.0**53) / np.log(2.0 + np.arange(1 << 16)), kind="stable")
    ranks = np.empty(1 << 16, np.int64)
    ranks[order] = np.arange(1 << 16)
    return ranks


RANKS = _ranks()


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of all documents at once, by document and term; the closing id is left out."""
    owner = np.repeat(np.arange(len(docs), dtype=np.int64), [len(d) - 1 for d in docs])
    both, count = np.unique(owner << 16 | np.concatenate([d[:-1] for d in docs]).astype(np.int64), return_counts=True)
    return both >> 16, both & 0xFFFF, count


def lexical_keys(n: int, owner: np.ndarray, term: np.ndarray, count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The most frequent id with a letter (ties: the smallest) and the min-hash of the ids; 0 for no ids.

    The min-hash is scrambled, as long documents have small ones and would all come together.
    """
    keys = np.zeros(n, np.int64)
    if len(owner):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        most = np.maximum.reduceat(np.where(words[term], count << 16 | 0xFFFF - term, 0), starts)
        first = np.minimum.reduceat(RANKS[term], starts)
        keys[owner[starts]] = np.where(most > 0, 0xFFFF - (most & 0xFFFF), 0) << 16 | first * 40503 & 0xFFFF
    return keys


def _tokenise(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, df = token_ids(ranks_path), np.zeros(1 << 16, np.int64)

        def keyed(doc_ids: list, blobs: list[bytes]) -> pa.RecordBatch:
            counts = term_counts([np.frombuffer(blob, "<u2") for blob in blobs])
            np.add.at(df, counts[1], 1)
            keys = lexical_keys(len(blobs), *counts, encode.words)
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(keys), pa.array(blobs, pa.binary())], names=["doc_id", "key", "ids"])

        for batch in batches:
            doc_ids, blobs, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                blobs.append(encode(text or "") + b"\0\0")
                size += len(blobs[-1])
                if size >= 2 * SHARD_TOKENS:
                    yield keyed(doc_ids, blobs)
                    doc_ids, blobs, size = [], [], 0
            if blobs:
                yield keyed(doc_ids, blobs)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([np.array([seen, df[seen]], "<i8").tobytes()], pa.binary())],
            names=["doc_id", "key", "ids"],
        )

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for blob in batch.column(0):
            ids, n = np.frombuffer(blob.as_buffer(), "<i8").reshape(2, -1)
            total[ids] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])


class _Shard:
    """A BM25 index of a block of documents, with the unused ones marked.

    Every document may become a seed, so the scores of all are summed over the postings at once: the
    terms of most documents as a product of matrices, the others by pairs of their postings.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = len(docs)
        self.unused = np.ones(n, bool)
        self._score = np.zeros((n, n), np.float32)
        owner, term, tf = term_counts(docs)
        length = np.array([len(d) for d in docs], np.float64)[owner]
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))).astype(np.float32)
        df = np.bincount(term, minlength=1 << 16)
        heavy = np.flatnonzero(df > max(HEAVY_DF, n // 32))
        for lo in range(0, len(heavy), n):
            column = np.full(1 << 16, -1, np.int64)
            column[heavy[lo : lo + n]] = np.arange(len(heavy[lo : lo + n]))
            at = column[term] >= 0
            postings = np.zeros((n, min(n, len(heavy) - lo)), np.float32)
            postings[owner[at], column[term[at]]] = weight[at]
            self._score += (postings > 0).astype(np.float32) @ postings.T
        light = df[term] <= max(HEAVY_DF, n // 32)
        order = np.flatnonzero(light)[np.argsort(term[light], kind="stable")]
        owner, weight, size = owner[order], weight[order], df[term[order]]
        first = np.cumsum(size) - size
        # Each posting meets all postings of its term, which begin at ``begin``.
        begin = np.flatnonzero(np.diff(term[order], prepend=-1))
        begin = np.repeat(begin, np.diff(np.append(begin, len(order))))
        for lo, hi in _runs(first, size, 1 << 21):
            pairs = np.repeat(np.arange(lo, hi), size[lo:hi])
            other = begin[pairs] + np.arange(len(pairs)) - (first[pairs] - first[lo])
            self._score += np.bincount(owner[pairs] * n + owner[other], weight[other], n * n).astype(np.float32).reshape(n, n)

    def neighbours(self, seed: int) -> np.ndarray:
        """All unused documents of the shard that share a term with the seed, by score, ties by position."""
        found = np.flatnonzero((self._score[seed] > 0) & self.unused)
        return found[np.argsort(-self._score[seed][found], kind="stable")]


def _runs(first: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of postings of at most ``most`` pairs each, but one posting at least."""
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first + size, first[lo] + most, side="right")))
        yield lo, hi
        lo = hi


class _Packer:
    """Cuts documents into pieces of windows; holds the open window between blocks."""

    def __init__(self, window: int, base: int):
        self.window, self.base, self.number, self.filled = window, base, 0, 0
        self.open: list[list] = []
        self.done: list[list] = []

    def room(self) -> int:
        return self.window - self.filled

    def put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Puts what fits of the document from ``start`` on; returns where it stopped."""
        take = min(self.room(), len(ids) - start)
        piece = ids[start : start + take]
        self.open.append([doc_id, start, take, piece, len(ids), self.filled])
        self.filled += take
        if self.filled == self.window:
            self._close(self.open)
            self.open, self.filled = [], 0
        return start + take

    def _close(self, pieces: list[list]) -> None:
        for doc_id, start, take, piece, total, offset in pieces:
            self.done.append([doc_id, start, take, zlib.crc32(piece.astype("<u4").tobytes()), total, self.base + self.number, offset])
        self.number += 1

    def finish(self) -> None:
        """The last window, cut into windows of powers of two."""
        left, self.open = self.open, []
        total, self.filled = self.filled, 0
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            size, used, part = 1 << bit, 0, []
            while used < size:
                doc_id, start, take, piece, n, _ = left.pop(0)
                fit = min(take, size - used)
                part.append([doc_id, start, fit, piece[:fit], n, used])
                used += fit
                if fit < take:
                    left.insert(0, [doc_id, start + fit, take - fit, piece[fit:], n, 0])
            self._close(part)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [()] * 7
        self.done = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def _fill(packer: _Packer, ids_of: list[np.ndarray], doc_ids: list, idf: np.ndarray, mean_length: float) -> None:
    """Packs a block: each seed's window takes the shard's unused neighbours of the seed, best first."""
    shard, n, nxt = _Shard(ids_of, idf, mean_length), len(ids_of), 0
    seed, at = None, 0
    while True:
        if seed is None:
            while nxt < n and not shard.unused[nxt]:
                nxt += 1
            if nxt == n:
                return
            seed, at = nxt, 0
            shard.unused[seed] = False
        while at < len(ids_of[seed]):
            at = packer.put(doc_ids[seed], ids_of[seed], at)
        follower = None
        if packer.filled:
            for j in map(int, shard.neighbours(seed)):
                shard.unused[j] = False
                stop = packer.put(doc_ids[j], ids_of[j], 0)
                if stop < len(ids_of[j]):
                    follower = j, stop
                if not packer.filled:
                    break
        seed, at = follower or (None, 0)


def _pack(window: int, idf, mean_length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, TaskContext.get().partitionId() << 40)
        doc_ids, ids_of, tokens = [], [], 0
        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(blob.as_py(), "<u2")
                if ids_of and (len(ids_of) == SHARD_DOCS or tokens + len(ids) > SHARD_TOKENS):
                    _fill(packer, ids_of, doc_ids, idf.value, mean_length)
                    yield packer.take()
                    doc_ids, ids_of, tokens = [], [], 0
                doc_ids.append(doc_id)
                ids_of.append(ids)
                tokens += len(ids)
        if ids_of:
            _fill(packer, ids_of, doc_ids, idf.value, mean_length)
        packer.finish()
        yield packer.take()

    return run


def pack(docs: DataFrame, ranks_path: str, window: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored. A document is its token ids and then id 0,
    so a null or empty text is one token. Each id lies in one piece; null and repeated doc_ids are
    packed like others. Every sequence is full or its length is a power of two. An empty table gives
    no pieces. ``window`` is a power of two.
    """
    spark = docs.sparkSession
    rows = checkpoint(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _tokenise(ranks_path), "doc_id long, key long, ids binary"
        )
    )
    # At most one row for each id of the vocabulary comes to the driver.
    df = rows.where("key < 0").select("ids").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = df.toPandas()
    kept = rows.where("key >= 0")
    n, length = kept.agg(F.count("*"), F.avg(F.length("ids") / 2)).first()
    idf = np.zeros(1 << 16, np.float32)
    freq = counted["n"].to_numpy(np.float64)
    idf[counted["token"].to_numpy(np.int64)] = np.log1p((n - freq + 0.5) / (freq + 0.5))
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * (length or 1) / TASK_TOKENS))
    dealt = kept.repartitionByRange(partitions, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(_pack(window, spark.sparkContext.broadcast(idf), float(length or 1)), PIECES)
