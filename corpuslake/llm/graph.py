"""Connected components of a link table, never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: each node's neighbours move to its least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    small = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(small, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) that isn't its component's least node.

    Alternating stars converge in a number of rounds that grows with the logarithm of the
    longest chain; each round is written to the shared folder.  Self links and repeated
    links are allowed; an empty table gives an empty result.
    """
    now = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        now = spool(_stars(now), "edges")
