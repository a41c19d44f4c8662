"""Connected components of an edge table, all in joins and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import settle

MAX_ROUNDS = 60


def _spread(both: DataFrame, smaller_only: bool) -> DataFrame:
    """Tie the neighbours of every node u to the least of them and u.

    ``both``: (u, v) with u's neighbours v.  With ``smaller_only`` the
    neighbours are those below u and u itself is tied too (small star),
    otherwise only larger neighbours move (large star).
    """
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = both.join(least, "u")
    moved = met.where("v != low" if smaller_only else "v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    if smaller_only:
        moved = moved.unionByName(least.select("u", F.col("low").alias("v")))
    return moved.where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large-star and small-star until the edges are stars around the
    smallest node of each component; the number of rounds grows with the
    logarithm of the longest path.  Nodes are bigints; nulls and loops are
    left out.  Each round is cut with a checkpoint, and only a count and a
    checksum reach the driver.
    """
    pairs = edges.where("a is not null and b is not null and a != b")
    pairs = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(pairs)
    for _ in range(MAX_ROUNDS):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = settle(_spread(_spread(both, smaller_only=False), smaller_only=True))
        after = _state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
