"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), root the smallest node that it reaches.

    Each step keeps components as they are and moves links towards their smallest node; when a round changes nothing every
    link goes from a node to its root.  A node's links are never gathered: minima are pre-aggregated before they are
    shuffled, and the joins can be split where one node has many links.  Rounds grow with the logarithm of the longest path.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = _mark(now)
    while True:
        now = cut(_step(_step(now, True), False))
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links have a > b.  large: every node links its larger neighbours to the smallest one; else its smaller ones and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    joined = both.join(lowest, "u")
    moved = joined.filter(F.col("v") > F.col("u")) if large else joined
    out = moved.select(F.col("v").alias("a"), F.col("low").alias("b"))
    if not large:
        out = out.union(lowest.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return out.filter("a != b").distinct()


def _mark(links: DataFrame) -> tuple:
    """A fingerprint of the set of links."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.shiftrightunsigned(h, 33))).first())
