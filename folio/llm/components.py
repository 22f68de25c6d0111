"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import discard, stored


def _sums(edges: DataFrame) -> tuple:
    """Number of edges and sums of their hashes: two rounds with the same are taken to be equal."""
    a, b = F.xxhash64("u", "v"), F.xxhash64("v", F.lit(1), "u")
    return tuple(edges.agg(F.count("*"), F.bit_xor(a), F.sum(F.shiftright(b, 16))).first())


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge: the least node of its component.

    Alternates the large-star and small-star steps of Kiveris et al., which
    reach stars in a number of rounds that grows with the logarithm of the
    size. Each round is written to the shared folder. In each step a node's
    neighbours are counted and joined by key, never gathered.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now, "edges")
    seen = _sums(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        last, now = now, stored(small, "edges")
        discard(last)
        before, seen = seen, _sums(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
    labels._folio_path = now._folio_path  # discarded with the labels
    return labels
