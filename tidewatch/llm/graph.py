"""Connected components of links between 64-bit nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import release, written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node in ``edges`` (a, b), roots left out: root is the smallest node reachable.

    Alternating large and small stars: first every larger neighbour of a node is
    linked to the smallest node around it, then every smaller one, until only
    stars around the roots remain. Each round is two joins of the links with one
    row per node, written to the shared folder; the driver sees a count and a checksum.
    """
    # Both columns are turned into (larger, smaller) once; links are few against the documents.
    current = written(_oriented(edges), "links")
    seen = _digest(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "links-low")
        large = written(
            _oriented(both.filter("b > a").join(around, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))), "links-large"
        )
        low = written(large.groupBy("a").agg(F.min("b").alias("low")), "links-low")
        # Each node goes to its smallest neighbour, and so do its other smaller neighbours.
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = written(_oriented(small.unionByName(low.select("a", F.col("low").alias("b")))), "links")
        now = _digest(after)
        release(current, around, large, low)
        current = after
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
