"""Media columns with content-defined chunks.

A payload is stored as an 8-bit grey image of 64 columns (binary PGM). A rolling gear hash cuts the
stored bytes into chunks at places that depend on content only, so equal passages give equal chunks.

1. Chunk digests of all rows are counted; the digests that come more than once fill a bitmap of fixed
   size (false hits only make a chunk travel that need not).
2. One pass writes the store: a media row with its ordered chunk list and the bytes of the chunks that
   are its own, and rows with the chunks that it shares with others. Those are deduplicated by digest.
3. Reading back, every medium is put together from its ordered chunk list: its own chunks are cut out
   of its row, the others come from the chunk table by a join on the digest (once for each distinct
   medium). Each chunk is verified against its digest, and the medium against its SHA-256.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.session import checkpoint, shared_dir

COLUMNS = 64
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
BITMAP_BITS = 23
_BUCKET = 32768  # bits in a piece of Spark's bitmap functions
_SEEN = 200_000

STORED = "kind int, row long, doc_id long, n_bytes long, sha binary, digests array<binary>, lengths array<int>, own array<boolean>, bytes binary"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def _gear() -> np.ndarray:
    """256 numbers by the splitmix64 rule, lower 32 bits."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last one included.

    The hash at a byte is the sum of the gear numbers of the last 32 bytes, each shifted by its age;
    it is built for all bytes at once by doubling the span.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    for age in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[age:] += h[:-age] << np.uint32(age)
        h = longer
    marks = (np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist()
    ends, start, total = [], 0, len(data)
    while total - start > MIN_CHUNK:
        i = bisect_left(marks, start + MIN_CHUNK)
        end = min(marks[i] if i < len(marks) else total, start + MAX_CHUNK, total)
        ends.append(end)
        start = end
    if start < total or not ends:
        ends.append(total)
    return ends


def to_media(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, stored form): zero bytes fill up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(data) // COLUMNS))
    return len(data), b"P5\n%d %d\n255\n" % (COLUMNS, rows) + data.ljust(rows * COLUMNS, b"\0")


def from_media(media: bytes) -> np.ndarray:
    """The samples of a stored image, rows by columns."""
    magic, size, depth, samples = media.split(b"\n", 3)
    columns, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != columns * rows:
        raise ValueError("not a whole 8-bit image")
    return np.frombuffer(samples, np.uint8).reshape(rows, columns)


def features(media: bytes, n_chunks: int) -> tuple:
    image = from_media(media)
    payload = image.tobytes()
    share = np.bincount(image.ravel(), minlength=256) / image.size
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    feature = f"{image.shape[1]}x{image.shape[0]} mean={float(share @ np.arange(256)):.4f} entropy={abs(entropy):.4f}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, n_chunks,
    )


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_key(_digest(c)) for text in batch.column(0).to_pylist() for c in _chunks(to_media(text)[1])]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])


def _store(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, sent, bits = TaskContext.get().partitionId() << 40, set(), shared.value
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary()]
        names = [f.split()[0] for f in STORED.split(", ")]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, media = to_media(text)
                chunks = _chunks(media)
                digests = [_digest(c) for c in chunks]
                at = [_key(d) & ((1 << BITMAP_BITS) - 1) for d in digests]
                own = [not bits[b >> 3] >> (b & 7) & 1 for b in at]
                out.append((0, row, doc_id, n, hashlib.sha256(media).digest(), digests, [len(c) for c in chunks], own, b"".join(c for c, o in zip(chunks, own) if o)))
                row += 1
                for d, c, o in zip(digests, chunks, own):
                    if not o and d not in sent:
                        if len(sent) >= _SEEN:
                            sent.clear()
                        sent.add(d)
                        out.append((1, None, None, None, d, None, None, None, c))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 9, kinds)], names=names)

    return run


def _in_order(row: dict, fetched: dict[int, bytes]) -> bytes:
    """The chunks of a medium's list, each verified: its own ones from its row, the others by place."""
    parts, at = [], 0
    for place, (digest, size, own) in enumerate(zip(row["digests"], row["lengths"], row["own"])):
        chunk = row["bytes"][at : at + size] if own else fetched[place]
        at += size if own else 0
        if len(chunk) != size or _digest(chunk) != digest:
            raise ValueError("a stored chunk does not match its digest")
        parts.append(chunk)
    return b"".join(parts)


def _own_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media rows all of whose chunks are their own."""
    for batch in batches:
        out = [(r["doc_id"], r["n_bytes"], *_verified(_in_order(r, {}), r["sha"], len(r["digests"]))) for r in batch.to_pylist()]
        yield _feature_batch(out, ("doc_id", "n_bytes"), (pa.int64(),) * 2)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Media with chunks that were fetched by place."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            media = _in_order(r, {p["place"]: p["chunk"] for p in r["parts"]})
            out.append((r["sha"], *_verified(media, r["sha"], len(r["digests"]))))
        yield _feature_batch(out, ("sha",), (pa.binary(),))


def _verified(media: bytes, sha: bytes, n_chunks: int) -> tuple:
    if hashlib.sha256(media).digest() != sha:
        raise ValueError("a stored medium does not match its digest")
    return features(media, n_chunks)


def _feature_batch(rows: list[tuple], keys: tuple, kinds: tuple) -> pa.RecordBatch:
    names = [*keys, *(f.split()[0] for f in FEATURES.split(", "))]
    types = [*kinds, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)


def repeated_digests(docs: DataFrame) -> bytes:
    """A bitmap of 2**BITMAP_BITS bits, set where a chunk digest comes more than once."""
    keys = docs.select("text").mapInArrow(_digest_rows, "key long")
    bit = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    again = keys.groupBy("key").count().where("count > 1").select((bit + 1).alias("bit"))
    maps = again.groupBy(F.expr("bitmap_bucket_number(bit)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    whole = bytearray(1 << (BITMAP_BITS - 3))
    for r in maps.collect():  # 2**BITMAP_BITS / 32768 rows of 4 KB at most
        at = (r["n"] - 1) * _BUCKET // 8
        whole[at : at + len(r["bits"])] = r["bits"]
    return bytes(whole)


def store(docs: DataFrame, path: str) -> None:
    """Writes ``path``/media (rows and their own bytes, and shared chunks) and ``path``/chunks."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(repeated_digests(docs))
    docs.mapInArrow(_store(shared), STORED).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/media")
    chunks = spark.read.schema(STORED).parquet(f"{path}/media").where("kind = 1").select(F.col("sha").alias("digest"), F.col("bytes").alias("chunk"))
    chunks.groupBy("digest").agg(F.first("chunk").alias("chunk")).write.option("compression", "zstd").parquet(f"{path}/chunks")


def read(spark, path: str) -> DataFrame:
    """Every stored row, read back, verified and described: doc_id, n_bytes and FEATURES."""
    rows = spark.read.schema(STORED).parquet(f"{path}/media").where("kind = 0")
    chunks = spark.read.parquet(f"{path}/chunks")
    alone = F.forall("own", lambda o: o)
    direct = rows.where(alone).select("doc_id", "n_bytes", "sha", "digests", "lengths", "own", "bytes").mapInArrow(_own_only, f"doc_id long, n_bytes long, {FEATURES}")
    sharing = rows.where(~alone)
    media = sharing.groupBy("sha").agg(*[F.first(c).alias(c) for c in ("digests", "lengths", "own", "bytes")])
    places = media.select("sha", "own", F.posexplode("digests").alias("place", "digest")).where(~F.get("own", F.col("place")))
    parts = places.join(chunks, "digest").groupBy("sha").agg(F.collect_list(F.struct("place", "chunk")).alias("parts"))
    described = checkpoint(media.join(parts, "sha").select("sha", "digests", "lengths", "own", "bytes", "parts").mapInArrow(_put_together, f"sha binary, {FEATURES}"))
    return direct.unionByName(sharing.select("doc_id", "n_bytes", "sha").join(described, "sha").drop("sha"))


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs`` (doc_id, text) and returns what ``read`` finds, one row for each.

    Null texts are empty; null and repeated doc_ids stay as they are; an empty table gives no rows;
    other columns are ignored. Equal texts give equal values. The store lies in the shared folder.
    """
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"
    store(docs, path)
    return read(docs.sparkSession, path)
