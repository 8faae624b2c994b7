"""One-hop relations of nodes, node details, breakdowns and the overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph


def related(graph: CodeGraph, target: DataFrame, kind: str, inverse: bool, limit: int = 100) -> DataFrame:
    """Entities at the other end of the edges of one kind: id, node_key, relation, direction, rank.

    ``target`` holds node ids (column id); it is a handful of nodes, so the edges are filtered in the scan.
    Edges without an indexed end are dropped, and each entity counts once.
    """
    here, there = ("to_id", "from_id") if inverse else ("from_id", "to_id")
    edges = graph.edges.filter(F.col("type") == kind).join(target.select(F.col("id").alias(here)), here, "left_semi")
    found = edges.select(F.col(there).alias("id")).distinct().join(graph.symbols.select("id", "node_key"), "id").orderBy("node_key").limit(max(0, limit))
    return found.select("id", "node_key", F.lit(kind).alias("relation"), F.lit("inverse" if inverse else "forward").alias("direction"), F.row_number().over(Window.orderBy("node_key")).cast("long").alias("rank"))


def one(graph: CodeGraph, node_id: str) -> DataFrame:
    return graph.symbols.filter(F.col("id") == node_id).select("id", "file")


def file_node(graph: CodeGraph, node_id: str) -> DataFrame:
    """The file node of a node's file."""
    node = one(graph, node_id)
    return graph.symbols.filter("type = 'file'").join(node.select("file"), "file", "left_semi").select("id", "file")


def callers(graph: CodeGraph, node_id: str, limit: int = 100) -> DataFrame:
    return related(graph, one(graph, node_id), "calls", True, limit)


def callees(graph: CodeGraph, node_id: str, limit: int = 100) -> DataFrame:
    return related(graph, one(graph, node_id), "calls", False, limit)


def imports(graph: CodeGraph, node_id: str, limit: int = 100) -> DataFrame:
    """What the node's file imports."""
    return related(graph, file_node(graph, node_id), "imports", False, limit)


def imported_by(graph: CodeGraph, node_id: str, limit: int = 100) -> DataFrame:
    return related(graph, file_node(graph, node_id), "imports", True, limit)


#: Relation lists of a node's details: edge type and whether the node is the target.
DETAILS = {"callers": ("calls", True), "callees": ("calls", False), "imports": ("imports", False), "imported_by": ("imports", True), "extends": ("extends", False), "extended_by": ("extends", True)}


def node_details(graph: CodeGraph, node_id: str) -> DataFrame:
    """(role, id, node_key) over the six lists, with repeats, in one pass over the edges."""
    mine = graph.edges.filter((F.col("from_id") == node_id) | (F.col("to_id") == node_id))
    roles = F.array_compact(F.array(*[F.when((F.col("type") == kind) & (F.col("to_id" if inverse else "from_id") == node_id), F.struct(F.lit(role).alias("role"), F.col("from_id" if inverse else "to_id").alias("id"))) for role, (kind, inverse) in DETAILS.items()]))
    return mine.select(F.explode(roles).alias("r")).select("r.role", "r.id").join(graph.symbols.select("id", "node_key"), "id").select("role", "id", "node_key").orderBy("role", "node_key")


def edge_breakdown(graph: CodeGraph) -> DataFrame:
    return graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("edges"))


def symbols_per_file(graph: CodeGraph) -> DataFrame:
    """Files and how many symbols other than the file itself they hold."""
    return graph.symbols.groupBy("file").agg(F.count_if(F.col("type") != "file").alias("symbols"))


def overview(graph: CodeGraph, max_nodes: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The first nodes by node_key and the edges among them."""
    nodes = graph.symbols.orderBy("node_key").limit(max(1, max_nodes)).select("id", "name", "type", "file", "node_key")
    return nodes, induced(graph.edges, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "type")


def known_collection(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """total, returned, omitted, truncated of a collection cut to a limit."""
    total = F.count(F.lit(1))
    shown = F.least(total, F.lit(limit))
    return rows.agg(total.alias("total"), shown.alias("returned"), (total - shown).alias("omitted"), (total > limit).alias("truncated"))
