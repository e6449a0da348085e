"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import shared_dir


#: Edges a partition: a short list is kept in few partitions, whatever the session's number of them.
ROWS_A_PART = 250_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row.n, row.h


def merging(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both are sorted and merged, and neither is gathered in the driver to be broadcast, however small Spark takes it for."""
    return side.hint("merge")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; the component is the smallest node id reachable.

    ``edges`` has columns u and v. Minima are aggregated before they are joined back, so a node with
    very many edges never has them gathered in one task. Each round is checkpointed in the shared folder.
    Edges never grow in number, so the partitions they need are known from the first count.
    """
    shared_dir(edges.sparkSession)
    edges = (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    mark = _mark(edges)
    if mark[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    parts = 1 + mark[0] // ROWS_A_PART
    packed = lambda df: df.coalesce(parts)
    edges = packed(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = packed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = packed(both.where(F.col("v") > F.col("u")).join(merging(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        root = packed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(merging(root), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = packed(packed(small.unionByName(root.select("u", F.col("m").alias("v")))).distinct()).checkpoint()
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
