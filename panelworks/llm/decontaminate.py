"""Benchmark decontamination with DataFrame functions only.

Both sides are split to lower-case words of letters and digits. A window of a document as long as a
benchmark item is contaminated by it if their five-word shingles, weighted by how often they occur,
have a weighted Jaccard similarity of 0.8 or more.

1. Windows. Similarity t needs more than (1 - t) of an item's shingles to be found in the window, so
   a few anchor words of each item that together lie in more than that share of its shingles must
   occur there, with one neighbour in place. Windows without that cannot reach t. One pass over the
   documents' words finds them. Bags ignore order, so an item-sized window begins at every place from
   which it holds the anchor word.
2. SimHash. Each distinct window and each item gets a 64-bit SimHash of its shingles.
3. Multi-index Hamming. The 64 bits are cut into BLOCKS blocks. Two fingerprints within the radius
   differ in at most radius // BLOCKS bits of one block at least, so an item is filed under all values
   that near of each of its blocks, and a window asks with its own: joins on (item key, block, value)
   find every pair within the radius. The key is that of the item whose anchors placed the window, so
   a window meets the items it may hold and no others, however many items there are. Only
   fingerprints travel; texts are fetched for the windows that are within the radius.
4. Exact weighted-shingle similarity decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.names import unused
from panelworks.session import checkpoint

WIDTH = 5
SIMILARITY = 0.8
#: Sets of similarity 0.8 differ by 10 bits on average, with a deviation of 2.9.
RADIUS = 20
#: Blocks of about nine bits, of which a pair within the radius differs in two at most in one of them.
BLOCKS = 7
#: Anchor words are broadcast up to this many rows (some 100 bytes each), else Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; an empty array for null or no words."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def shingles_of(words: Column, width: int = WIDTH) -> Column:
    """All shingles with repeats; fewer words than ``width`` are one shingle."""
    n = F.size(words)
    joined = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, width)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(joined)


def simhashes(df: DataFrame, keys: list[str], shingles: Column) -> DataFrame:
    """(*keys, fp): a bit of fp is 1 if it is set in over half of the hashes of the keys' shingles.

    Each of 32 sums counts two bits side by side, in generated code. Rows without shingles give none.
    """
    hashes = df.select(*keys, F.explode(shingles).alias("_s")).select(*keys, F.xxhash64("_s").alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(1 << 32 | 1))).alias(f"_c{j}") for j in range(32)]
    fp = F.lit(0).cast("long")
    for b in range(64):
        ones = F.shiftrightunsigned(f"_c{b % 32}", b - b % 32).bitwiseAND(F.lit((1 << 32) - 1))
        fp = fp.bitwiseOR(F.when(ones * 2 > F.col("_n"), F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return hashes.groupBy(*keys).agg(F.count("*").alias("_n"), *sums).select(*keys, fp.alias("fp"))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as bags: the sum of the smaller counts by the sum of the larger counts."""
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    both = F.array_intersect(a, b)
    # Where one side repeats nothing, each shared shingle counts once.
    once = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(once, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s))))
    return shared / (F.size(a) + F.size(b) - shared)


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return items.select("*", F.size("words").alias("w"), shingles_of(F.col("words")).alias("shingles"), F.xxhash64("words").alias("key"))


def _anchors(items: DataFrame, similarity: float) -> DataFrame:
    """(word, before, after, key, w): words, each with its neighbours, of which any similar window has one.

    A word inside an item lies in five of its n shingles. Of (1 - similarity) * n / 5 + 1 words, each
    five positions from the next, at least one is left in every window of that similarity. Longer
    words are taken, as they are rarer.
    """
    miss = 1 - similarity
    n = F.greatest(F.col("w") - (WIDTH - 1), F.lit(1))
    cut = items.select("*", n.alias("n"), (F.floor(n * miss / WIDTH + 1e-9) + 1).cast("int").alias("k"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    # One stretch of the inner positions for each anchor, with a gap of WIDTH - 1 to the next.
    inner, length = F.lit(WIDTH - 1), F.col("w") - 2 * (WIDTH - 1)
    first = inner + F.floor(length * F.col("j") / F.col("k"))
    last = inner + F.floor(length * (F.col("j") + 1) / F.col("k")) - 1 - F.when(F.col("j") < F.col("k") - 1, WIDTH - 1).otherwise(0)
    short = F.col("w") < 2 * WIDTH - 1
    cut = cut.select(
        "*",
        F.when(short, F.floor(F.col("w") / 2)).otherwise(first).cast("int").alias("lo"),
        F.when(short, F.floor(F.col("w") / 2)).otherwise(F.greatest(first, last)).cast("int").alias("hi"),
    )
    longest = F.array_max(
        F.transform(F.sequence("lo", "hi"), lambda p: F.struct(F.length(F.get("words", p)).alias("size"), (-p).alias("back")))
    )
    cut = cut.select("*", (-longest["back"]).alias("at"))
    return cut.select(
        F.get("words", F.col("at")).alias("word"),
        F.when(F.col("at") > 0, F.get("words", F.col("at") - 1)).alias("before"),
        F.get("words", F.col("at") + 1).alias("after"),
        "key", "w",
    ).distinct()


def _hits(said: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, text_hash, words, p, key, w): where an anchor with one of its neighbours stands in a document.

    Beyond BROADCAST_ROWS anchors the words are joined without the document, which is fetched for the hits.
    """
    few = anchors.count() <= BROADCAST_ROWS
    at = lambda p: F.when((p >= 0) & (p < F.size("words")), F.get("words", p))
    words = said.select("doc_id", "text_hash", "words", F.posexplode("words").alias("p", "word"))
    words = words.select("doc_id", "text_hash", *(["words"] if few else []), "p", "word", at(F.col("p") - 1).alias("left"), at(F.col("p") + 1).alias("right"))
    hits = words.join(F.broadcast(anchors) if few else anchors, "word")
    hits = hits.where(F.col("left").eqNullSafe(F.col("before")) | F.col("right").eqNullSafe(F.col("after")) | (F.col("w") < WIDTH)).drop("left", "right", "before", "after", "word")
    if few:
        return hits
    hits = hits.distinct().select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "p", "key", "w")
    said = said.dropDuplicates(["doc_id", "text_hash"])
    return said.join(hits, said["doc_id"].eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).drop("d", "h")


def _windows(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, text_hash, start, key, w, win): all item-sized windows with an anchor, cut at the document's end.

    Bags of n and m shingles reach the similarity m / n at most, so windows cut shorter than that are left out.
    """
    said = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    hits = _hits(said, _anchors(items.select("words", "w", "key").dropDuplicates(["words"]), similarity))
    # The words that windows with the hit can hold: w - 1 on either side of it.
    first = F.greatest(F.col("p") - F.col("w") + 1, F.lit(0))
    near = hits.select("doc_id", "text_hash", "key", "w", "p", first.alias("first"), F.slice("words", first + 1, F.col("p") + F.col("w") - first).alias("near"))
    placed = near.select("*", F.explode(F.sequence(F.lit(0), F.col("p") - F.col("first"))).alias("o"))
    width = F.least("w", F.lit(WIDTH))
    n, m = F.col("w") - width + 1, F.least("w", F.size("near") - F.col("o")) - width + 1
    placed = placed.where((m > 0) & (m >= n * similarity - 1e-9))
    return placed.select(
        "doc_id", "text_hash", (F.col("first") + F.col("o")).alias("start"), "key", "w", F.concat_ws(" ", F.slice("near", F.col("o") + 1, F.col("w"))).alias("win")
    ).distinct()


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """First bit and end of each of the blocks of 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(edges, edges[1:]))


def _bits(x: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))


def _blocks(prints: DataFrame, blocks: int, flips: int = 0) -> DataFrame:
    """One row for each block of the fingerprint ``fp`` and each value that differs from it in ``flips`` bits at most."""
    near = prints.select("*", F.posexplode(F.array(*[_bits(F.col("fp"), *cut) for cut in _cuts(blocks)])).alias("block", "own"))
    size = max(hi - lo for lo, hi in _cuts(blocks))
    masks = [sum(1 << i for i in bits) for k in range(flips + 1) for bits in combinations(range(size), k)]
    return near.select("*", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(mask)) for mask in masks])).alias("value")).drop("own")


def within_radius(windows: DataFrame, items: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """(key, w, fp, item_fp): the pairs of fingerprints of one key and length that differ in ``radius`` bits at most.

    Both sides have key, w and fp. None is lost: of radius differing bits one block holds radius // blocks at most.
    """
    blocks = min(blocks, radius + 1)
    asked = _blocks(windows.select("key", "w", "fp").distinct(), blocks)
    filed = _blocks(items.select("key", "w", "fp").distinct(), blocks, radius // blocks).withColumnRenamed("fp", "item_fp")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # A pair that is near in several blocks counts at the first of them.
    first = F.coalesce(*[F.when(F.bit_count(_bits(apart, *cut)) <= radius // blocks, i) for i, cut in enumerate(_cuts(blocks))])
    return asked.join(filed, ["key", "w", "block", "value"]).where((F.bit_count(apart) <= radius) & (F.col("block") == first)).select("key", "w", "fp", "item_fp")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, window_start), one row for each document and item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. The row
    holds the highest similarity of a window and the first window that has it. Null or empty texts on
    either side match nothing, null ids are kept as they are, repeated rows give one result, and
    either table may be empty. Items under five words are one shingle and match exactly.
    """
    items = checkpoint(_items(benchmark))
    windows = checkpoint(_windows(docs, items, similarity))
    # Fingerprints are stored, else each use below would work them out anew. So many partitions are not merged into few,
    # as the work on a window is much for its bytes.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = windows.select("key", "w", "win").repartition(partitions, "win").distinct()
    prints = checkpoint(simhashes(texts.withColumn("words", F.split("win", " ")), ["key", "w", "win"], shingles_of(F.col("words"))))
    sides = checkpoint(simhashes(items, ["item_id", "key", "w", "shingles"], F.col("shingles")))
    pairs = prints.join(within_radius(prints, sides, radius), ["key", "w", "fp"])
    pairs = pairs.join(sides.withColumnRenamed("fp", "item_fp"), ["key", "w", "item_fp"])
    said = pairs.withColumn("words", F.split("win", " ")).withColumn("said", shingles_of(F.col("words")))
    scored = checkpoint(
        said.select("key", "w", "win", "item_id", weighted_jaccard(F.col("said"), F.col("shingles")).alias("similarity"))
        .where(F.col("similarity") >= similarity - 1e-12)
    )
    return (
        windows.join(scored, ["key", "w", "win"])
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
        .select("doc_id", "text_hash", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("window_start"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. All other rows and columns stay."""
    leak_id, leak_hash = unused(docs, "_leak_id", "_leak_hash")
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash)).distinct()
    here = docs["doc_id"].eqNullSafe(F.col(leak_id)) & (F.xxhash64(docs["text"]) == F.col(leak_hash))
    return docs.join(found, here, "left_anti")
