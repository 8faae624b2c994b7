"""Bounded breadth-first traversals, level by level.

A level joins the frontier with the edges, drops what is known, and keeps for each new node
the discovery that a queue would make first: by the parent's ordinal, then by the order of
its edges. Ordinals continue that order, so limits cut exactly where a queue would stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators.resolve import directory_of
from weftgraph.session import Scratch

# Relation priorities and limits.
IMPACT_PRIORITY = {"calls": 0, "extends": 1, "implements": 1, "imports": 2, "references": 3, "contains": 4}
IMPACT_TYPES = ("calls", "imports", "extends", "implements", "references")
RISK = {"high": {"direct": 10, "total": 50, "cross_directory": 5}, "medium": {"direct": 3, "total": 10, "cross_file": 3}}


def clamp(value: int | None, default: int, most: int, least: int = 0) -> int:
    return max(least, min(most, int(default if value is None else value)))


def priority(column: str, table: dict[str, int]) -> Column:
    out = F.lit(len(table))
    for kind, rank in table.items():
        out = F.when(F.col(column) == kind, rank).otherwise(out)
    return out


def steps(graph: CodeGraph, types: tuple[str, ...] | None, directions: tuple[str, ...]) -> DataFrame:
    """(src, dst, type, direction, from_id, to_id): ways to walk edges with both ends indexed."""
    edges = graph.edges if types is None else graph.edges.filter(F.col("type").isin(*types))
    ids = graph.symbols.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    out = None
    for direction in directions:
        src, dst = ("from_id", "to_id") if direction == "forward" else ("to_id", "from_id")
        part = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "type", F.lit(direction).alias("direction"), "from_id", "to_id")
        out = part if out is None else out.union(part)
    return out


def breadth_first(graph: CodeGraph, seeds: DataFrame, ways: DataFrame, order: list[Column], max_depth: int, max_new: int, scratch: Scratch) -> DataFrame:
    """id, depth, ord, parent, type, direction, path of the seeds (depth 0) and of at most ``max_new`` nodes found from them.

    seeds: (id, ord). ``order`` sorts the edges of one parent; it may use the step's columns and the
    found node's node_key. The frontier is at most ``max_new`` rows after the seeds (a result limit of some hundreds), so each
    level's ordinals are assigned over few rows. `levels` is for searches without such a limit.
    """
    keyed = scratch.save(ways.join(graph.symbols.select(F.col("id").alias("dst"), "node_key"), "dst"))
    none = F.lit(None).cast("string")
    known = scratch.save(seeds.select("id", F.lit(0).alias("depth"), F.col("ord").cast("long").alias("ord"), none.alias("parent"), none.alias("type"), none.alias("direction"), F.array("id").alias("path")))
    frontier, found, base = known, 0, known.count()
    for depth in range(1, max_depth + 1):
        if found >= max_new:
            break
        front = frontier.select(F.col("id").alias("src"), F.col("ord").alias("parent_ord"), F.col("path").alias("parent_path"))
        reached = keyed.join(front, "src").join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
        first = Window.partitionBy("dst").orderBy("parent_ord", *order, "from_id", "to_id")
        new = reached.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
        new = new.orderBy("parent_ord", *order, "from_id", "to_id").limit(max_new - found)
        placed = F.row_number().over(Window.orderBy("parent_ord", *order, "from_id", "to_id"))
        level = scratch.save(new.select(F.col("dst").alias("id"), F.lit(depth).alias("depth"), (placed + base + found).cast("long").alias("ord"), F.col("src").alias("parent"), "type", "direction", F.concat("parent_path", F.array("dst")).alias("path")))
        size = level.count()
        if not size:
            break
        found += size
        known = known.union(level)
        frontier = level
    return known


def levels(graph: CodeGraph, seeds: DataFrame, ways: DataFrame, order: list[Column], max_depth: int, scratch: Scratch, arrived: Callable[[DataFrame], bool]) -> list[DataFrame]:
    """The levels of an unlimited search, each a table (id, ord, parent, type, direction), until one has arrived or nothing is new.

    A row holds its parent only. Ordinals are the places of a sort by ranges, so no level is numbered in one task:
    they rise in the order in which a queue would find the nodes, with gaps.
    """
    keyed = scratch.save(ways.join(graph.symbols.select(F.col("id").alias("dst"), "node_key"), "dst"))
    none = F.lit(None).cast("string")
    out = [scratch.save(seeds.select("id", F.col("ord").cast("long").alias("ord"), none.alias("parent"), none.alias("type"), none.alias("direction")))]
    known = out[0].select("id")
    for _ in range(max_depth):
        front = out[-1].select(F.col("id").alias("src"), F.col("ord").alias("parent_ord"))
        reached = keyed.join(front, "src").join(known.withColumnRenamed("id", "dst"), "dst", "left_anti")
        keys = [*[c.alias(f"o{i}") for i, c in enumerate(order)], "from_id", "to_id"]
        place = F.struct("parent_ord", *keys).alias("place")
        # The first discovery of a node is an argmin, which is combined before the shuffle.
        new = reached.select("dst", place, "src", "type", "direction").groupBy("dst").agg(F.min_by(F.struct("place", "src", "type", "direction"), "place").alias("x")).select(F.col("dst").alias("id"), "x.*")
        level = scratch.save(new.orderBy("place").select("id", F.monotonically_increasing_id().alias("ord"), F.col("src").alias("parent"), "type", "direction"))
        if level.isEmpty():
            break
        out.append(level)
        known = known.union(level.select("id"))
        if arrived(level):
            break
    return out


def way_back(found: list[DataFrame], node_id: str) -> list[tuple]:
    """(parent, type, direction, id) of the hops from a seed to a node of the last level; one row is read for each."""
    hops = []
    for level in reversed(found[1:]):
        row = level.filter(F.col("id") == node_id).first()
        hops.append((row.parent, row.type, row.direction, row.id))
        node_id = row.parent
    return hops[::-1]


def ordered_seeds(rows: DataFrame) -> DataFrame:
    """(id, ord) in the order of node_key."""
    return rows.select("id", F.row_number().over(Window.orderBy("node_key")).alias("ord"))


def impact(graph: CodeGraph, node_id: str, max_depth: int | None = None, max_results: int | None = None) -> DataFrame:
    """What depends on a node: id, depth, relation, path, reason. A file stands for all nodes of its file."""
    depth, results = clamp(max_depth, 3, 10), clamp(max_results, 100, 1000)
    node = graph.symbols.filter(F.col("id") == node_id)
    same = graph.symbols.join(node.filter("type = 'file'").select("file"), "file", "left_semi").union(node.select(*["file", *[c for c in graph.symbols.columns if c != "file"]]).filter("type <> 'file'"))
    found = breadth_first(graph, ordered_seeds(same), steps(graph, IMPACT_TYPES, ("inverse",)), [priority("type", IMPACT_PRIORITY), F.col("node_key")], depth, results, Scratch(graph.edges.sparkSession, "impact"))
    reason = F.when(F.col("type") == "calls", "caller").when(F.col("type") == "imports", "imported-by").when(F.col("type") == "extends", "inheritance-dependent").otherwise("dependent")
    return found.filter("depth > 0").select("id", F.col("depth").cast("long").alias("depth"), F.col("type").alias("relation"), "path", reason.alias("reason"))


def impact_summary(graph: CodeGraph, node_id: str, items: DataFrame, incomplete: bool = False, max_results: int | None = None) -> DataFrame:
    """One row: direct, transitive, total, cross_file, cross_directory, risk, truncated.

    truncated is set as soon as the results reach the limit, whether or not anything was left out.
    """
    target = graph.symbols.filter(F.col("id") == node_id).select(F.col("file").alias("target_file"))
    rows = items.join(graph.symbols.select("id", "file"), "id").crossJoin(F.broadcast(target.limit(1)))
    away = F.col("file") != F.col("target_file")
    far = directory_of(F.col("file")) != directory_of(F.col("target_file"))
    out = rows.agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.count(F.lit(1)).alias("total"),
        F.count_distinct(F.when(away, F.col("file"))).alias("cross_file"), F.count_distinct(F.when(far, directory_of(F.col("file")))).alias("cross_directory"),
    )
    at = lambda level: F.greatest(*[F.col(k) >= v for k, v in RISK[level].items()])
    risk = F.when(F.lit(incomplete), "unknown").when(at("high"), "high").when(at("medium"), "medium").otherwise("low")
    return out.withColumn("risk", risk).withColumn("truncated", F.col("total") >= clamp(max_results, 100, 1000))


TRACE_TYPES = ("calls", "imports", "extends", "implements", "references", "contains")
TRACE_PRIORITY = {"calls": 0, "imports": 1, "extends": 2, "implements": 2, "references": 3, "contains": 4}


def trace(graph: CodeGraph, source: str, target: str, max_depth: int | None = None, mode: str = "directed", types: tuple[str, ...] = TRACE_TYPES) -> DataFrame:
    """The shortest path: hop, from_id, relation, direction, to_id. Empty: no path, or source is target.

    `explanatory` walks edges backwards too. Nodes found are not limited, only the depth is.
    """
    spark = graph.edges.sparkSession
    hops = "hop long, from_id string, relation string, direction string, to_id string"
    if source == target:
        return spark.createDataFrame([], hops)
    ways = steps(graph, types, ("forward",) if mode == "directed" else ("forward", "inverse"))
    seeds = graph.symbols.filter(F.col("id") == source).select("id", F.lit(1).alias("ord"))
    order = [priority("type", TRACE_PRIORITY), F.col("node_key"), F.col("direction")]
    there = lambda level: not level.filter(F.col("id") == target).isEmpty()
    found = levels(graph, seeds, ways, order, clamp(max_depth, 8, 32), Scratch(spark, "trace"), there)
    if len(found) < 2 or not there(found[-1]):
        return spark.createDataFrame([], hops)
    return spark.createDataFrame([(i, parent, kind, direction, node) for i, (parent, kind, direction, node) in enumerate(way_back(found, target), 1)], hops)


def expand(graph: CodeGraph, seeds: DataFrame, max_depth: int = 2, max_nodes: int = 8) -> DataFrame:
    """Context around search hits: id, depth, relation, path, nth. seeds: file, name, type and start_line (null: any)."""
    wanted = seeds.select(F.col("file").alias("s_file"), F.col("name").alias("s_name"), F.col("type").alias("s_type"), F.col("start_line").alias("s_line"))
    s = graph.symbols
    match = (s.file == wanted.s_file) & (s.name == wanted.s_name) & (s.type == wanted.s_type) & (wanted.s_line.isNull() | (s.start_line == wanted.s_line))
    starts = ordered_seeds(s.join(wanted, match, "left_semi"))
    order = [F.when(F.col("type") == "calls", 0).otherwise(1), F.col("type"), F.col("node_key")]
    found = breadth_first(graph, starts, steps(graph, None, ("forward", "inverse")), order, max(0, max_depth), max(0, max_nodes), Scratch(s.sparkSession, "expand"))
    return found.filter("depth > 0").select("id", F.col("depth").cast("long").alias("depth"), F.col("type").alias("relation"), "path", F.row_number().over(Window.orderBy("ord")).cast("long").alias("nth"))


def neighborhood(graph: CodeGraph, node_id: str, depth: int = 1, max_nodes: int = 80, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes around a node, itself included, and the edges among them."""
    depth, most = clamp(depth, 1, 3), clamp(max_nodes, 80, 500, 1)
    seeds = graph.symbols.filter(F.col("id") == node_id).select("id", F.lit(1).alias("ord"))
    found = breadth_first(graph, seeds, steps(graph, types, ("forward", "inverse")), [F.col("node_key"), F.col("type")], depth, most - 1, Scratch(graph.edges.sparkSession, "neighborhood"))
    nodes = found.select("id").join(graph.symbols, "id").select("id", "name", "type", "file", "node_key")
    edges = graph.edges if types is None else graph.edges.filter(F.col("type").isin(*types))
    from weftgraph.operators.relations import induced

    return nodes, induced(edges, nodes)


def execution_flow(graph: CodeGraph, node_id: str, max_depth: int | None = None, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Calls from a function or method: nodes (id, depth, ord, terminal) and edges (from_id, to_id, calls) among the expanded ones.

    A node without calls is terminal. Only nodes above the depth limit are expanded; repeated calls are one edge.
    """
    scratch = Scratch(graph.edges.sparkSession, "flow")
    depth, most = clamp(max_depth, 8, 32), clamp(max_nodes, 100, 1000, 1)
    seeds = graph.symbols.filter((F.col("id") == node_id)).select("id", F.lit(1).alias("ord"), "type")
    callable_ = seeds.filter("type in ('function', 'method')")
    ways = steps(graph, ("calls",), ("forward",))
    found = scratch.save(breadth_first(graph, callable_, ways, [F.col("node_key")], depth, most - 1, scratch).unionByName(
        seeds.filter("type not in ('function', 'method')").select("id", F.lit(0).alias("depth"), F.col("ord").cast("long").alias("ord")), allowMissingColumns=True))
    calls = graph.edges.filter("type = 'calls'").select("from_id", "to_id")
    sources = calls.join(found.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("from_id").alias("id")).distinct().withColumn("calls_on", F.lit(True))
    nodes = found.join(sources, "id", "left").select("id", F.col("depth").cast("long").alias("depth"), "ord", F.col("calls_on").isNull().alias("terminal"))
    inner = calls.join(found.filter(F.col("depth") < depth).select(F.col("id").alias("from_id")), "from_id", "left_semi").join(found.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return nodes, inner.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("calls"))


def importer_closure(graph: CodeGraph, files: DataFrame) -> DataFrame:
    """Files (column file) that import the given ones, directly or over others; the given ones included."""
    scratch = Scratch(graph.edges.sparkSession, "closure")
    file_of = graph.symbols.select("id", "file")
    edges = graph.edges.filter("type = 'imports'").join(file_of.select(F.col("id").alias("from_id"), F.col("file").alias("importer")), "from_id").join(file_of.select(F.col("id").alias("to_id"), F.col("file").alias("imported")), "to_id")
    edges = scratch.save(edges.select("importer", "imported").distinct())
    known = frontier = scratch.save(files.select("file").distinct())
    while True:
        new = edges.join(frontier.withColumnRenamed("file", "imported"), "imported", "left_semi").select(F.col("importer").alias("file")).distinct().join(known, "file", "left_anti")
        frontier = scratch.save(new)
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
