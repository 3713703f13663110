"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.session import checkpoint


def _canonical(links: DataFrame) -> DataFrame:
    a, b = links.columns
    return (
        links.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has two bigint columns. Returns (node, root) for every linked node that is not
    itself a root; root is the smallest node that can be reached.

    Self links, repeated links and both directions are fine. Links with a null end are ignored.
    Every step is a grouped minimum (combined before the shuffle) and a join whose two sides are
    shuffled for the join, so adaptive execution can split a node with very many neighbours.
    The number of steps grows with the logarithm of the longest chain.
    """
    links = checkpoint(_canonical(links.dropna()))
    before = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m")))
        large = checkpoint(_canonical(links.join(least, "a").select("b", "m")))
        least = checkpoint(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(least, "b")
        links = checkpoint(_canonical(small.select("a", "m").unionAll(small.select("b", "m"))))
        after = _state(links)
        if after == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after
