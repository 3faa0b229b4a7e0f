"""Connected components over a link table, without collecting links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import cut_lineage

MAX_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` for every node of ``links``; component is the smallest node id.

    Distributed union-find: rounds of large-star and small-star, each an aggregation of minima and an
    equality join. Nulls and self-links are dropped; no links give no rows. Each round's table is cut with a
    checkpoint. Raises if the rounds don't settle, rather than return half-joined components.
    """
    edges = cut_lineage(
        links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    before = _state(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"connected components did not settle in {MAX_ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
