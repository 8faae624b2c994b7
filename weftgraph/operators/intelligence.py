"""Graph intelligence: importance, communities, bridges, strongly connected cycles, repository map."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.model import EDGE_TYPES, CodeGraph
from weftgraph.operators.resolve import directory_of, is_generated_path, is_generic_name
from weftgraph.session import Scratch

# Weights of kinds, signals and relations, penalties.
KIND_WEIGHT = {"class": 1.15, "interface": 1.1, "enum": 1.05, "function": 1.0, "type": 0.95, "method": 0.9, "variable": 0.65, "file": 0.55}
SIGNALS = {"callers": 0.3, "callees": 0.1, "imported_by": 0.2, "dependents": 0.2, "cross_file_reach": 0.15, "inheritance": 0.05}
HIGHEST_KIND = 1.15
COMMUNITY_WEIGHT = {"calls": 3.0, "extends": 2.0, "implements": 2.0, "imports": 1.5, "references": 1.0, "contains": 0.5}
BRIDGE_WEIGHT = COMMUNITY_WEIGHT
PENALTY = {"generated": 0.3, "file": 0.35, "hub": 0.55}
PASSES = 20
#: Edges of a repository whose communities one task finds; the moves are sequential by definition.
COMMUNITY_EDGES = 2_000_000

CYCLE_TYPES = ("calls", "imports", "extends")


def _by(column: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def degree_stats(graph: CodeGraph) -> DataFrame:
    """id, callers, callees, imported_by, dependents, cross_file_reach, inheritance, total_degree of every node.

    Edge ends are unfolded once, so all six signals come from one aggregation by node.
    """
    e = graph.edges.filter("type <> 'contains'")
    files = graph.symbols.select("id", "file")
    full = e.join(files.select(F.col("id").alias("from_id"), F.col("file").alias("from_file")), "from_id", "left").join(files.select(F.col("id").alias("to_id"), F.col("file").alias("to_file")), "to_id", "left")
    both = F.col("from_file").isNotNull() & F.col("to_file").isNotNull()
    side = lambda here, there, here_file, there_file, inbound: F.struct(F.col(here).alias("id"), F.col(there).alias("other"), F.col(there_file).alias("other_file"), F.lit(inbound).alias("inbound"), (both & (F.col("from_file") != F.col("to_file"))).alias("away"), both.alias("known"), "type")
    ends = full.select(F.explode(F.array(side("from_id", "to_id", "from_file", "to_file", False), side("to_id", "from_id", "to_file", "from_file", True))).alias("x")).select("x.*")
    uses = F.col("known") & F.col("type").isin("calls", "references")
    inherits = F.col("known") & F.col("type").isin("extends", "implements")
    per = ends.groupBy("id").agg(
        F.count_if(uses & F.col("inbound")).alias("callers"), F.count_if(uses & ~F.col("inbound")).alias("callees"), F.count_if(inherits).alias("inheritance"), F.count(F.lit(1)).alias("total_degree"),
        F.count_distinct(F.when((uses | inherits) & F.col("inbound"), F.col("other"))).alias("dependents"),
    )
    imports = full.filter(both & (F.col("type") == "imports")).select(F.col("to_file").alias("file"), F.col("from_file").alias("importer")).distinct()
    importers = imports.groupBy("file").agg(F.count(F.lit(1)).alias("imported_by"))
    # A node reaches the files at the other end of its edges, and those that import its file.
    own = ends.filter("away").select("id", F.col("other_file").alias("reach")).distinct()
    extra = graph.symbols.select("id", "file").join(imports.filter("importer <> file"), "file").select("id", F.col("importer").alias("reach"))
    reach = own.union(extra).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("cross_file_reach"))
    rows = graph.symbols.select("id", "file").join(per, "id", "left").join(importers, "file", "left").join(reach, "id", "left")
    return rows.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*SIGNALS, "total_degree")])


def hub_threshold(stats: DataFrame, fraction: float = 0.95) -> DataFrame:
    """The degree at place floor((n - 1) * fraction) of the ascending order, as one row.

    Degrees are counted by value first, so what is ordered is the number of different degrees.
    """
    counts = stats.groupBy("total_degree").agg(F.count(F.lit(1)).alias("nodes"))
    upto = Window.orderBy("total_degree").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("nodes").over(upto)).withColumn("all_nodes", F.sum("nodes").over(Window.partitionBy()))
    return placed.filter(F.col("upto") > F.floor((F.col("all_nodes") - 1) * F.lit(fraction))).agg(F.min("total_degree").alias("hub_threshold"))


def importance(graph: CodeGraph, limit: int = 50, include_files: bool = False) -> DataFrame:
    """rank, id, score, noise_penalty of the most important symbols: log-normalised signals, weighted, by kind, less for noise."""
    nodes = graph.symbols if include_files else graph.symbols.filter("type <> 'file'")
    # The statistics are read three times: for the maxima, the threshold and the scores.
    stats = Scratch(graph.edges.sparkSession, "importance").save(nodes.select("id", "type", "name", "file", "node_key").join(degree_stats(graph), "id"))
    most = stats.agg(*[F.max(s).alias(f"max_{s}") for s in SIGNALS]).crossJoin(hub_threshold(stats))
    rows = stats.crossJoin(F.broadcast(most))  # one row
    signal = sum((F.when((F.col(f"max_{s}") > 0) & (F.col(s) > 0), F.log1p(s) / F.log1p(f"max_{s}")).otherwise(0.0) * w for s, w in SIGNALS.items()), F.lit(0.0))
    local_hub = (F.col("total_degree") >= F.greatest(F.lit(8), "hub_threshold")) & (F.col("cross_file_reach") <= F.greatest(F.lit(1), F.floor(F.col("total_degree") * 0.25)))
    generic = is_generic_name(F.col("name")) & (F.col("total_degree") >= 6)
    penalty = F.when(is_generated_path(F.col("file")), PENALTY["generated"]).when(F.col("type") == "file", PENALTY["file"]).when(local_hub | generic, PENALTY["hub"]).otherwise(1.0)
    score = F.least(F.lit(1.0), signal * _by(F.col("type"), KIND_WEIGHT, 1.0) * penalty / HIGHEST_KIND)
    top = rows.select("id", "node_key", F.round(score, 9).alias("score"), penalty.alias("noise_penalty")).orderBy(F.desc("score"), "node_key").limit(max(1, min(1000, limit)))
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "node_key")).cast("long").alias("rank"), "id", "score", "noise_penalty")


def _moved(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Local moving over nodes in order of node_key: each joins the neighbouring label of the best modularity gain."""
    order = nodes.sort_values("node_key").id.tolist()
    weight: dict[str, dict[str, float]] = {}
    degree: dict[str, float] = {}
    for a, b, w in zip(edges.from_id, edges.to_id, edges.weight, strict=True):
        for x, y in ((a, b), (b, a)):
            near = weight.setdefault(x, {})
            near[y] = near.get(y, 0.0) + w
            degree[x] = degree.get(x, 0.0) + w
    label = {n: n for n in order}
    inside = {n: degree.get(n, 0.0) for n in order}
    everything = max(1.0, sum(degree.values()))
    for _ in range(PASSES):
        moved = False
        for n in order:
            own, mine = label[n], degree.get(n, 0.0)
            inside[own] -= mine
            shares: dict[str, float] = {}
            for other, w in weight.get(n, {}).items():
                if other in label:
                    shares[label[other]] = shares.get(label[other], 0.0) + w
            gain, best = max(((w - mine * inside[c] / everything, c) for c, w in shares.items()), key=lambda x: (x[0], tuple(-ord(ch) for ch in x[1])), default=(0.0, own))
            target = best if gain > 0 else own
            inside[target] += mine
            if target != own:
                label[n] = target
                moved = True
        if not moved:
            break
    members: dict[str, list[str]] = {}
    for n in order:
        members.setdefault(label[n], []).append(n)
    names = {c: "community-" + hashlib.sha256("\0".join(sorted(m)).encode()).hexdigest()[:16] for c, m in members.items()}
    return pd.DataFrame({"id": order, "community": [names[label[n]] for n in order]})


def communities(graph: CodeGraph) -> DataFrame:
    """(id, community) of every node, by repository: the symbols' column repo, or all one without it.

    Moves are sequential by definition, so a repository is one task and repositories run side by side; edges between
    repositories don't count. Pair weights are summed before they get there. A repository of more than COMMUNITY_EDGES
    weighted pairs is an error, not a different answer.
    """
    kinds = [k for k, w in COMMUNITY_WEIGHT.items() if w]
    repo = F.col("repo") if "repo" in graph.symbols.columns else F.lit("")
    nodes = graph.symbols.select("id", "node_key", repo.alias("repo"))
    weighted = graph.edges.filter(F.col("type").isin(*kinds)).groupBy("from_id", "to_id").agg(F.sum(_by(F.col("type"), COMMUNITY_WEIGHT, 0.0)).alias("weight"))
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("repo").alias(f"{side}_repo"))
    weighted = weighted.join(end("from"), "from_id").join(end("to"), "to_id").filter("from_repo = to_repo").select("from_id", "to_id", "weight", F.col("from_repo").alias("repo"))
    weighted = Scratch(graph.edges.sparkSession, "communities").save(weighted)
    most = weighted.groupBy("repo").agg(F.count(F.lit(1)).alias("pairs")).agg(F.max("pairs").alias("pairs")).first().pairs or 0
    if most > COMMUNITY_EDGES:
        raise ValueError(f"communities are found in repositories of up to {COMMUNITY_EDGES} weighted pairs, one has {most}")
    return weighted.groupBy("repo").cogroup(nodes.groupBy("repo")).applyInPandas(lambda e, n: _moved(e, n), "id string, community string")


def community_stats(graph: CodeGraph, membership: DataFrame) -> DataFrame:
    """community, size, files, label, internal_edges, external_edges, cohesion, coupling, quality, representatives (up to 5).

    label is the most frequent directory; representatives have the highest degree.
    """
    member = membership.join(graph.symbols.select("id", "file", "type", "node_key"), "id")
    label = member.groupBy("community", directory_of(F.col("file")).alias("directory")).agg(F.count(F.lit(1)).alias("n"))
    label = label.withColumn("nth", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "directory"))).filter("nth = 1").select("community", F.col("directory").alias("label"))
    placed = edge_areas(graph, membership)
    sides = placed.select(F.explode(F.when(F.col("source") == F.col("target"), F.array(F.struct(F.col("source").alias("community"), F.lit(True).alias("inner")))).otherwise(F.array(F.struct(F.col("source").alias("community"), F.lit(False).alias("inner")), F.struct(F.col("target").alias("community"), F.lit(False).alias("inner"))))).alias("x"))
    counts = sides.groupBy("x.community").agg(F.count_if("x.inner").alias("internal_edges"), F.count_if(~F.col("x.inner")).alias("external_edges"))
    degree = graph.edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    top = member.join(degree, "id", "left").withColumn("nth", F.row_number().over(Window.partitionBy("community").orderBy(F.desc_nulls_last("degree"), "node_key"))).filter("nth <= 5")
    top = top.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("representatives"))
    size = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("file").alias("files"))
    rows = size.join(label, "community").join(counts, "community", "left").join(top, "community")
    inner, outer = F.coalesce("internal_edges", F.lit(0)), F.coalesce("external_edges", F.lit(0))
    quality = F.when(F.col("size") == 1, "singleton").when(F.col("size") < 3, "tiny").when(F.col("size") > 200, "oversized").otherwise("normal")
    return rows.select("community", "size", "files", "label", inner.alias("internal_edges"), outer.alias("external_edges"), F.when(inner + outer > 0, inner / (inner + outer)).otherwise(0.0).alias("cohesion"), (outer / F.col("size")).alias("coupling"), quality.alias("quality"), "representatives")


def edge_areas(graph: CodeGraph, membership: DataFrame, types: tuple[str, ...] | None = None, column: str = "community") -> DataFrame:
    """Edges with the area of either end: from_id, to_id, type, source, target; edges with an end outside all areas are dropped."""
    edges = graph.edges if types is None else graph.edges.filter(F.col("type").isin(*types))
    m = membership.select("id", F.col(column).alias("area"))
    return edges.join(m.select(F.col("id").alias("from_id"), F.col("area").alias("source")), "from_id").join(m.select(F.col("id").alias("to_id"), F.col("area").alias("target")), "to_id")


def area_coupling(graph: CodeGraph, membership: DataFrame, column: str = "community", samples: int = 5) -> DataFrame:
    """source, target, edges, relation counts and up to ``samples`` representative edges of each directed pair of areas."""
    placed = edge_areas(graph, membership, column=column).filter("source <> target")
    pairs = placed.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("source", "target").agg(F.sum("n").alias("edges"), F.sort_array(F.collect_list(F.struct("type", "n"))).alias("relations"))
    few = placed.withColumn("nth", F.row_number().over(Window.partitionBy("source", "target").orderBy("from_id", "to_id", "type"))).filter(F.col("nth") <= samples)
    few = few.groupBy("source", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "from_id", "to_id", "type"))), lambda x: F.concat_ws(" ", x["from_id"], x["type"], x["to_id"])).alias("samples"))
    return pairs.join(few, ["source", "target"])


#: Edges for each wanted bridge that are looked at first, and rows that are broadcast to the edges.
BRIDGE_EDGES, BROADCAST_ROWS = 100, 100_000


def _edge_ends(graph: CodeGraph, m: DataFrame, types: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """id, degree, external (edges to other areas, of the types given) and into (those that end at the node), a type of edges after another."""
    rows, parts = graph.edges, []
    ends = lambda e: e.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(0).alias("into")), F.struct(F.col("to_id").alias("id"), F.lit(1).alias("into")))).alias("x")).groupBy("x.id").agg(F.count(F.lit(1)).alias("n"), F.sum("x.into").alias("into"))
    none = F.lit(0).cast("long")
    for kind in (*EDGE_TYPES, None):
        e = rows.filter(~F.col("type").isin(*EDGE_TYPES) if kind is None else F.col("type") == kind).select("from_id", "to_id")
        parts.append(scratch.save(ends(e).select("id", F.col("n").alias("degree"), none.alias("external"), none.alias("into"))))
        if kind in types:
            half = scratch.save(e.join(m.select(F.col("id").alias("from_id"), F.col("area").alias("source")), "from_id"))
            away = scratch.save(half.join(m.select(F.col("id").alias("to_id"), F.col("area").alias("target")), "to_id").filter("source <> target").select("from_id", "to_id"))
            scratch.drop(half)
            parts.append(scratch.save(ends(away).select("id", none.alias("degree"), F.col("n").alias("external"), "into")))
            scratch.drop(away)
    out = scratch.save(reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("degree").alias("degree"), F.sum("external").alias("external"), F.sum("into").alias("into")))
    scratch.drop(*parts)
    return out


def bridges(graph: CodeGraph, membership: DataFrame, limit: int = 50, column: str = "community") -> DataFrame:
    """from_id, to_id, type, source, target, score: sparse edges between areas that cross a directory or an architectural boundary.

    A score falls with the external edges of both ends. So edges into the nodes with fewest of them are scored first, and more only if the last bridge
    wanted doesn't score above all that the others can reach: what is left out can't be among the results.
    """
    scratch, wanted = Scratch(graph.edges.sparkSession, "bridges", "zstd"), max(1, limit)
    types = tuple(k for k in COMMUNITY_WEIGHT if k != "contains")
    m = scratch.save(membership.select("id", F.col(column).alias("area")))
    stats = _edge_ends(graph, m, types, scratch)
    most = graph.symbols.select("id").join(stats, "id").agg(F.max("degree").alias("max_degree"))
    node = graph.symbols.select("id", "type", "file", "node_key").join(stats.filter("external > 0"), "id").crossJoin(F.broadcast(most))
    noisy = is_generated_path(F.col("file")) | ((F.col("degree") >= F.greatest(F.lit(8.0), F.col("max_degree") * 0.8)) & (F.col("external") >= 4))
    node = node.filter(~noisy).select("id", F.col("type").alias("kind"), directory_of(F.col("file")).alias("directory"), "external", "node_key")
    end = lambda side: node.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("kind", "directory", "external", "node_key")])
    order = [F.desc("score"), "from_node_key", "to_node_key", "from_id", "to_id", "type"]
    # A row for each different number of external edges.
    counts = stats.filter("into > 0").groupBy("external").agg(F.sum("into").alias("edges")).orderBy("external").collect()
    goal = BRIDGE_EDGES * wanted
    while True:
        sums = list(accumulate(r.edges for r in counts))
        at = next((i for i, n in enumerate(sums) if n >= goal), len(sums) - 1)
        upto = counts[at].external if counts else 0
        low = scratch.save(stats.filter((F.col("into") > 0) & (F.col("external") <= upto)).select(F.col("id").alias("to_id")))
        areas = m.join(low.withColumnRenamed("to_id", "id"), "id", "left_semi").select("area").distinct()
        into = scratch.save(m.join(areas, "area", "left_semi").select(F.col("id").alias("to_id"), F.col("area").alias("target")))
        few = into.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        ends = scratch.save(graph.edges.filter(F.col("type").isin(*types)).join(F.broadcast(into) if few else into, "to_id"))
        placed = scratch.save(ends.join(m.select(F.col("id").alias("from_id"), F.col("area").alias("source")), "from_id").filter("source <> target"))
        pairs = placed.groupBy("source", "target").agg(F.count(F.lit(1)).alias("pair"))
        rows = placed.join(low, "to_id", "left_semi").join(pairs, ["source", "target"]).join(end("from"), "from_id").join(end("to"), "to_id")
        sparse = (F.col("from_external") <= 2) & (F.col("to_external") <= 2)
        boundary = F.col("type").isin("imports", "extends") | F.col("from_kind").isin("file", "class", "interface") | F.col("to_kind").isin("file", "class", "interface")
        rows = rows.filter(((F.col("pair") <= 2) | sparse) & ((F.col("from_directory") != F.col("to_directory")) | boundary))
        score = _by(F.col("type"), BRIDGE_WEIGHT, 1.0) / (F.col("pair") * F.sqrt(F.greatest(F.lit(1), F.col("from_external") + F.col("to_external"))))
        top = scratch.save(rows.withColumn("score", F.round(score, 9)).orderBy(*order).limit(wanted).select("from_id", "to_id", "type", "source", "target", "score", "from_node_key", "to_node_key"))
        scratch.drop(ends, placed, into)
        found = top.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).first()
        # Any other edge ends at a node with more than upto external edges and begins at one with one at least.
        if at >= len(counts) - 1 or (found.n == wanted and found.last > round(max(BRIDGE_WEIGHT[k] for k in types) / (upto + 2) ** 0.5, 9)):
            return top.orderBy(*order).select("from_id", "to_id", "type", "source", "target", "score")
        goal *= 16


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of (src, dst) on cycles; component is the smallest id of its strongly connected nodes.

    Nodes without a way in or out are trimmed, then the smallest label that reaches a node is spread
    forward and backward; nodes that agree with their own root form its component and leave.
    """
    scratch = Scratch(edges.sparkSession, "components")
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    left = scratch.save(edges.filter("src <> dst").distinct())
    done = None
    while True:
        while True:
            size = left.count()
            left = scratch.save(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if left.count() == size:
                break
        if left.isEmpty():
            break
        nodes = scratch.save(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct())
        ahead = _spread(nodes.withColumn("root", F.col("id")), left, scratch)
        # Backward within the nodes of one forward root only.
        own = left.join(ahead.select(F.col("id").alias("src"), F.col("root").alias("r")), "src").join(ahead.select(F.col("id").alias("dst"), F.col("root").alias("q")), "dst").filter("r = q").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = _reached(ahead.filter("id = root").select("id"), scratch.save(own), scratch)
        found = scratch.save(ahead.join(back, "id", "left_semi").select("id", F.col("root").alias("component")))
        done = found if done is None else done.union(found)
        gone = found.select("id")
        left = scratch.save(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    alone = loops.withColumn("component", F.col("id"))
    if done is None:
        return alone
    several = done.join(done.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "component", "left_semi").select("id", "component")
    return several.union(alone.join(several, "id", "left_anti"))


def _spread(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The smallest label that reaches each node along (src, dst)."""
    labels = scratch.save(labels)
    while True:
        sent = edges.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "root")
        after = scratch.save(labels.union(sent).groupBy("id").agg(F.min("root").alias("root")))
        same = after.join(labels, ["id", "root"], "left_anti").isEmpty()
        labels = after
        if same:
            return labels


def _reached(seeds: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    known = frontier = scratch.save(seeds)
    while True:
        frontier = scratch.save(edges.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.union(frontier)


def cycles(graph: CodeGraph, types: tuple[str, ...] = CYCLE_TYPES) -> DataFrame:
    """relation, component (its smallest id), id: the nodes of each relation's cycles."""
    out = None
    for kind in types:
        part = strong_components(graph.edges.filter(F.col("type") == kind).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))
        part = part.select(F.lit(kind).alias("relation"), "component", "id")
        out = part if out is None else out.union(part)
    return out


def shortest_cycle(graph: CodeGraph, component: DataFrame, kind: str) -> DataFrame:
    """hop, id of the shortest cycle through the smallest node of one component (column id), first discovery in order of node_key."""
    from weftgraph.operators.traverse import levels, way_back

    spark = graph.edges.sparkSession
    nodes = component.select("id").join(graph.symbols, "id")
    edges = graph.edges.filter(F.col("type") == kind).join(component.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(component.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    scratch = Scratch(spark, "cycle")
    edges = scratch.save(edges.select("from_id", "to_id", "type").distinct())
    first = nodes.orderBy("node_key").select("id").first()
    if first is None:
        return spark.createDataFrame([], "hop int, id string")
    back = edges.filter(F.col("to_id") == first.id).select(F.col("from_id").alias("id"))
    ways = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "type", F.lit("forward").alias("direction"), "from_id", "to_id")
    seed = spark.createDataFrame([(first.id, 1)], "id string, ord long")
    closing = lambda level: level.join(back, "id", "left_semi")
    if not closing(seed).isEmpty():
        return spark.createDataFrame([(0, first.id), (1, first.id)], "hop int, id string")
    found = levels(graph, seed, ways, [F.col("node_key")], 2**20, scratch, lambda level: not closing(level).isEmpty())
    last = closing(found[-1]).orderBy("ord").first()
    if last is None:
        return spark.createDataFrame([], "hop int, id string")
    path = [first.id, *[hop[3] for hop in way_back(found, last.id)], first.id]
    return spark.createDataFrame(list(enumerate(path)), "hop int, id string")


def canonical_cycles(graph: CodeGraph, types: tuple[str, ...] = CYCLE_TYPES) -> dict[tuple[str, str], DataFrame]:
    """The shortest cycle through the smallest node of each component, by relation and component. A search for each: for reports of a few."""
    members = Scratch(graph.edges.sparkSession, "cycles").save(cycles(graph, types))
    keys = [(r.relation, r.component) for r in members.select("relation", "component").distinct().orderBy("relation", "component").collect()]
    return {(kind, c): shortest_cycle(graph, members.filter((F.col("relation") == kind) & (F.col("component") == c)).select("id"), kind) for kind, c in keys}


def repository_map(graph: CodeGraph, areas: DataFrame) -> DataFrame:
    """area, files, symbols, internal_edges, external_edges, cohesion, coupling over (file, area) membership.

    An edge counts as external for each area it touches, also when its other end is in none.
    """
    member = graph.symbols.select("id", "file", "type").join(areas, "file")
    size = member.groupBy("area").agg(F.count_distinct("file").alias("files"), F.count_if(F.col("type") != "file").alias("symbols"))
    m = member.select("id", "area")
    e = graph.edges.filter("type <> 'contains'").join(m.select(F.col("id").alias("from_id"), F.col("area").alias("source")), "from_id", "left").join(m.select(F.col("id").alias("to_id"), F.col("area").alias("target")), "to_id", "left")
    sides = e.select(F.explode(F.when(F.col("source") == F.col("target"), F.array(F.struct(F.col("source").alias("area"), F.lit(True).alias("inner")))).otherwise(F.array(F.struct(F.col("source").alias("area"), F.lit(False).alias("inner")), F.struct(F.col("target").alias("area"), F.lit(False).alias("inner"))))).alias("x")).select("x.*").filter("area is not null")
    counts = sides.groupBy("area").agg(F.count_if("inner").alias("internal_edges"), F.count_if(~F.col("inner")).alias("external_edges"))
    inner, outer = F.coalesce("internal_edges", F.lit(0)), F.coalesce("external_edges", F.lit(0))
    return size.join(counts, "area", "left").select("area", "files", "symbols", inner.alias("internal_edges"), outer.alias("external_edges"), F.when(inner + outer > 0, inner / (inner + outer)).otherwise(0.0).alias("cohesion"), F.when(F.col("symbols") > 0, outer / F.col("symbols")).otherwise(0.0).alias("coupling"))
