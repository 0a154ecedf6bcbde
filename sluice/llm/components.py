"""Connected components of an edge table as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Columns (node, label): label is the smallest node that can be reached from node.

    ``edges`` has columns (a, b) of one orderable type, in any direction and with repeats; nulls are left out. Nodes without an
    edge to another node are absent. Alternating large-star and small-star rounds (Kiveris et al., 2014) need a number of
    rounds logarithmic in the size of a component, whatever its diameter. The state between rounds is a table in
    the shared folder, never the driver. Minima are combined before the shuffle, so a hub costs one row per input partition.
    """
    first = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stage(first, "edges")
    before = _mark(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        current = stage(_small_star(_large_star(current)), "edges")
        after = _mark(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them; one pass over narrow rows."""
    return tuple(edges.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or the node itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
