"""Connected components of a graph of edges, by alternating large and small stars, all in DataFrames.

Each half round is an aggregation by node (partial sums first, so a hub is one row per task) and a join with
its result, one row per node, so that skew is on the side that may be split. Rounds are written to the
checkpoint folder; about log2 of the longest path of them are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable


def _star(links: DataFrame) -> DataFrame:
    """links (u, v), v < u for all: every v and u is tied to the least neighbour of u."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    tied = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour of u greater than u is tied to the least of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("v") == F.col("w")).select("u", F.col("m").alias("v"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most_rounds=60) -> DataFrame:
    """edges (u, v) of any ordered type -> (node, component): each node that has an edge to another, and the least node
    that it reaches. Null ends, loops and repeated edges count for nothing; no edges give no rows."""
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u != v")
    links = durable(links.where(F.col("u") != F.col("v")).distinct())
    before, rounds = _state(links), 0
    while before[0]:
        links = durable(_star(_large_star(links)).distinct())
        after, rounds = _state(links), rounds + 1
        if after == before:
            break
        if rounds == most_rounds:
            raise RuntimeError(f"components didn't settle in {rounds} rounds")
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
