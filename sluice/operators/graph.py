"""Flow graphs as tables: ``nodes(design, id, type, properties)`` and ``edges(design, source, target, order)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage

DESIGN = (
    "nodes array<struct<id: string, type: string, properties: string>>,"
    "edges array<struct<id: string, sourceNodeId: string, targetNodeId: string, properties: struct<order: int>>>"
)

# Node types, and those that are useless without a successor.
NODE_TYPES = (
    "job", "filter", "map", "eventDebezium", "queryMySQL", "writeMySQL", "kafkaSend", "kafkaReceive", "printLog",
)
# rows that doubled jumps may take, in those of edges and reached nodes
GROWTH = 4
NEEDS_SUCCESSOR = ("job", "queryMySQL", "kafkaReceive", "eventDebezium")


def parse_design(df: DataFrame, design: str = "design", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Graph documents to nodes (properties as JSON text) and edges (order 0 if not given)."""
    parsed = df.select(F.col(design).alias("design"), F.from_json(text, DESIGN).alias("_d"))
    nodes = parsed.select("design", F.inline("_d.nodes"))
    edges = parsed.select("design", F.explode("_d.edges").alias("_e")).select(
        "design",
        F.col("_e.sourceNodeId").alias("source"),
        F.col("_e.targetNodeId").alias("target"),
        F.coalesce("_e.properties.order", F.lit(0)).alias("order"),
    )
    return nodes, edges


def graph_roots(edges: DataFrame) -> DataFrame:
    """Source nodes that are no edge's target; nodes without edges are not roots."""
    ends = edges.select("design", F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(False).alias("is_target")),
        F.struct(F.col("target").alias("id"), F.lit(True).alias("is_target")),
    )).alias("_n"))
    return (
        ends.groupBy("design", "_n.id").agg(F.max("_n.is_target").alias("is_target"))
        .filter(~F.col("is_target")).select("design", "id")
    )


def successor_groups(edges: DataFrame) -> DataFrame:
    """Per node its successors as a list of groups, by edge order; targets sorted within a group.

    Targets are made distinct before the shuffle; a list is as long as the fan-out of its node.
    """
    groups = edges.groupBy("design", "source", "order").agg(F.sort_array(F.collect_set("target")).alias("targets"))
    return groups.groupBy("design", "source").agg(
        F.sort_array(F.collect_list(F.struct("order", "targets"))).alias("successors")
    )


def reachable(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from each root with their smallest depth (the root itself is depth 0), up to ``max_depth`` if given.

    Path doubling: jumps of exactly ``length`` edges extend everything reached so far at once, then jumps are joined with themselves, so
    a walk of any depth takes a logarithmic number of rounds. Cycles end: a round that reaches no new node is the last, as nodes of every depth below
    what is covered are known. Jumps are only doubled where that makes no more than ``GROWTH`` times the rows of edges and
    reached nodes (counted by node before the join); beyond, as behind a node with many edges in and out, the same jumps are taken again.
    Each round's tables are staged, which cuts the lineage.
    """
    links = stage(edges.select("design", F.col("source").alias("node"), F.col("target").alias("next")).distinct(), "links")
    roots = graph_roots(links.select("design", F.col("node").alias("source"), F.col("next").alias("target")))
    visited = stage(roots.select("design", F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth")), "reach")
    jumps, length, covered, n_links, n_visited = links, 1, 1, links.count(), visited.count()
    while max_depth is None or covered <= max_depth:
        further = visited.join(jumps, ["design", "node"]).select(
            "design", "root", F.col("next").alias("node"), (F.col("depth") + length).alias("depth"))
        if max_depth is not None:
            further = further.filter(F.col("depth") <= max_depth)
        visited = stage(visited.unionByName(further).groupBy("design", "root", "node").agg(F.min("depth").alias("depth")), "reach")
        before, n_visited = n_visited, visited.count()
        covered += length
        if n_visited == before:
            break
        ends = jumps.select("design", F.explode(F.array(
            F.struct(F.col("node").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            F.struct(F.col("next").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
        ways = ends.groupBy("design", "e.n").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
        joined = ways.agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0))).first()[0]
        if joined == 0:  # no walk is twice as long, and all shorter ones are taken
            break
        if joined <= GROWTH * (n_links + n_visited):
            second = jumps.select("design", F.col("node").alias("next"), F.col("next").alias("_end"))
            jumps = stage(jumps.join(second, ["design", "next"]).select("design", "node", F.col("_end").alias("next")).distinct(), "jumps")
            length *= 2
    return visited


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What makes a graph useless: a source or listener without successor, a node of unknown type, or (without node) a design without any edge."""
    starts = edges.select("design", F.col("source").alias("id")).distinct()
    lonely = (
        nodes.filter(F.col("type").isin(*NEEDS_SUCCESSOR)).join(starts, ["design", "id"], "left_anti")
        .select("design", "id", "type", F.lit("NO_SUCCESSOR").alias("problem"))
    )
    unknown = nodes.filter(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))).select(
        "design", "id", "type", F.lit("UNKNOWN_TYPE").alias("problem")
    )
    nothing = F.lit(None).cast("string")
    loose = nodes.select("design").distinct().join(edges.select("design").distinct(), "design", "left_anti").select(
        "design", nothing.alias("id"), nothing.alias("type"), F.lit("NO_EDGES").alias("problem"))
    return lonely.unionByName(unknown).unionByName(loose)
