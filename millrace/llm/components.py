"""Connected components of a graph by alternating large-star and small-star steps. Nodes are of any type that has an order.

All joins and sums are distributed; each round is written to the shared folder, and a digest of its links, by which the end is
known, is taken while it is written. A hub's links meet in joins, which Spark can split, and in pre-aggregated minima, never
as one list in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.common import cut

MAX_ROUNDS = 60


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its least neighbour (or itself)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    # the link to the least neighbour stays, the others are moved
    return down.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (in any order). One row per node of a link: node, root (the least node of its component)."""
    links = cut(links.where("a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        seen = Observation()
        links = cut(_small(_large(links)).observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a") % 1_000_003).alias("s")))
        now = tuple(sorted(seen.get.items()))
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't converge")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
