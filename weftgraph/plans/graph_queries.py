"""Registered queries over the projected graph, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import EDGE_TYPES, STAR_EDGES, STAR_SQL, CodeGraph, star_edges, star_rows, star_symbols, star_symbols_upto
from weftgraph.operators import intelligence, relations, resolve, traverse
from weftgraph.session import Scratch, ship

PART = "interface:part/0000000001"
NATION = "file:nation/0000000003"
CUSTOMER = "function:customer/0000000007"
NATION_PATH = "region/%/nation/0000000003"


_INDEXED: dict[tuple[str, str, str], DataFrame] = {}


def _indexed(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    ship(spark)
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _INDEXED:
        _INDEXED[at] = Scratch(spark, "graph", "zstd").save(rows())
    return _INDEXED[at]


def _rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, "symbols", lambda: star_rows(spark, sf_dir))


def symbols_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of a folder's graph, from what is written once a session."""
    return star_symbols(_rows_of(spark, sf_dir))


def symbols_upto(spark: SparkSession, sf_dir: str, last: int | None) -> DataFrame:
    """The symbols of a folder's graph that begin up to a line, and its files."""
    return star_symbols_upto(_rows_of(spark, sf_dir), last)


def graph_of(spark: SparkSession, sf_dir: str, *types: str) -> CodeGraph:
    """The graph of a folder with its edges of ``types`` (none named: all). The edges of a type are a table that is written when first asked for."""
    symbols = symbols_of(spark, sf_dir)
    edges = [_indexed(spark, sf_dir, k, lambda k=k: star_edges(spark, sf_dir, k, symbols)).withColumn("type", F.lit(k)) for k in STAR_EDGES if not types or k in types]
    return CodeGraph(symbols, reduce(DataFrame.union, edges))


def with_graph(sql: str, recursive: bool = False, more: str = "") -> str:
    return f"with {'recursive ' if recursive else ''}{STAR_SQL}{more} {sql}"


def region_areas(graph: CodeGraph) -> DataFrame:
    """Files by the region or brand that holds them: a membership that both engines can compute."""
    return graph.symbols.select("file").distinct().select("file", F.regexp_extract("file", "^([^/]+/[^/]+)", 1).alias("area"))


def node_areas(graph: CodeGraph) -> DataFrame:
    return graph.symbols.select("id", F.regexp_extract("file", "^([^/]+/[^/]+)", 1).alias("community"))


def owner_areas(graph: CodeGraph) -> DataFrame:
    """Customers with their orders, suppliers and parts as areas of their own; files as theirs."""
    return graph.symbols.select("id", F.coalesce(F.substring_index("qualified_name", ".", 2), "file").alias("community"))


OWNER = "coalesce(split_part(qualified_name, '.', 1) || '.' || split_part(qualified_name, '.', 2), file)"
AREA = "regexp_extract(file, '^([^/]+/[^/]+)', 1)"
DIRECTORY = "case when instr(file, '/') = 0 then '.' else regexp_replace(file, '/[^/]*$', '') end"


def _related_sql(node: str, kind: str, inverse: bool) -> str:
    here, there = ("to_id", "from_id") if inverse else ("from_id", "to_id")
    return with_graph(f"""
        select id, node_key, '{kind}' as relation, '{"inverse" if inverse else "forward"}' as direction, row_number() over (order by node_key) as rank
        from (select distinct {there} as id from edges where type = '{kind}' and {here} = '{node}') join symbols using (id) order by node_key limit 100""")


def _resolve_sql(query: str) -> str:
    q = query.lower()
    form = "".join(c for c in q if c.isalnum())
    norm = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
    s = resolve.SCORES
    more = f"""
        , scored as (select id, node_key, case
            when qualified_name = '{query}' then {s["qualified"]} when type = 'file' and (file = '{query}' or ends_with(file, '/{query}')) then {s["file_path"]} when name = '{query}' then {s["name"]}
            when {norm("name")} = '{form}' or {norm("coalesce(qualified_name, '')")} = '{form}' then {s["normalized"]} when file = '{query}' or ends_with(file, '/{query}') then {s["other_path"]}
            when starts_with(lower(name), '{q}') or starts_with(lower(coalesce(qualified_name, '')), '{q}') then {s["prefix"]}
            when contains(lower(name), '{q}') or contains(lower(coalesce(qualified_name, '')), '{q}') then {s["substring"]} else 0 end as score from symbols),
        top as (select count(*) as best from scored where score > 0 and score = (select max(score) from scored))"""
    return with_graph("""
        select case when best > 1 then 'ambiguous' else 'resolved' end as status, row_number() over (order by score desc, node_key) as rank, score::bigint as score, id, node_key
        from scored, top where score > 0 order by score desc, node_key limit 20""", more=more)


def without(graph: CodeGraph, *types: str) -> CodeGraph:
    return CodeGraph(graph.symbols, graph.edges.filter(~F.col("type").isin(*types)))


def only(graph: CodeGraph, *types: str) -> CodeGraph:
    return CodeGraph(graph.symbols, graph.edges.filter(F.col("type").isin(*types)))


def _priority(table: dict[str, int]) -> str:
    return "case e.type " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {len(table)} end"


def _levels_sql(seed: str, types: tuple[str, ...], directions: tuple[str, ...], order: str, depth: int) -> str:
    """level0 .. of a search (id, ord, depth, type, direction, parent, path), a node at its first discovery by ``order`` after its parent's place."""
    kinds = ", ".join(f"'{t}'" for t in types)
    sides = {"forward": "select from_id as src, to_id as dst, *, 'forward' as direction from edges", "inverse": "select to_id as src, from_id as dst, *, 'inverse' as direction from edges"}
    out = f"""
        , ways as materialized (select e.*, s.node_key from ({" union all ".join(sides[d] for d in directions)}) e join symbols s on s.id = dst join symbols r on r.id = src where e.type in ({kinds})),
        level0 as (select id, 1::bigint as ord, 0 as depth, null::varchar as type, null::varchar as direction, null::varchar as parent, [id] as path, []::varchar[] as hops from symbols where id = '{seed}')"""
    for k in range(1, depth + 1):
        known = " union all ".join(f"select id from level{j}" for j in range(k))
        out += f""",
        first{k} as (
            select dst as id, p.ord as pord, e.type, e.direction, p.id as parent, list_append(p.path, dst) as path, list_append(p.hops, concat_ws(' ', p.id, e.type, e.direction, dst)) as hops, row_number() over (partition by dst order by p.ord, {order}, e.from_id, e.to_id) as nth,
                row_number() over (order by p.ord, {order}, e.from_id, e.to_id) as place
            from level{k - 1} p join ways e on src = p.id where dst not in ({known})),
        level{k} as materialized (select id, row_number() over (order by place) as ord, {k} as depth, type, direction, parent, path, hops from first{k} where nth = 1)"""
    every = " union all ".join(f"select * from level{k}" for k in range(1, depth + 1))
    return out + f", reached as (select *, row_number() over (order by depth, ord) as place from ({every}))"


def _impact(limit: int, more: str = "") -> str:
    search = _levels_sql(PART, traverse.IMPACT_TYPES, ("inverse",), f"{_priority(traverse.IMPACT_PRIORITY)}, e.node_key", 3)
    return f"{search}, items as (select id, depth::bigint as depth, type as relation, path from reached where place <= {limit}){more}"


def queries() -> dict:
    g = graph_of
    one = lambda f: lambda spark, d: f(g(spark, d))

    def summary(graph: CodeGraph) -> DataFrame:
        return traverse.impact_summary(graph, PART, traverse.impact(graph, PART, 3, 1000), max_results=1000)

    def distance(graph: CodeGraph) -> DataFrame:
        return traverse.trace(graph, CUSTOMER, PART, 8, "explanatory").agg(F.max("hop").alias("hops"))

    def breakdown(graph: CodeGraph) -> DataFrame:
        return relations.edge_breakdown(graph)

    def cohesive(graph: CodeGraph) -> DataFrame:
        return intelligence.repository_map(graph, region_areas(graph)).withColumn("cohesion", F.round("cohesion", 9)).withColumn("coupling", F.round("coupling", 9))

    def by_folder(graph: CodeGraph) -> CodeGraph:
        """The whole graph, each nation's or brand's file a repository of its own."""
        return CodeGraph(graph.symbols.withColumn("repo", F.col("file")), graph.edges)

    return {
        "impact": one(lambda x: traverse.impact(x, PART, 3, 1000).select("id", "depth")),
        "impact_items": one(lambda x: traverse.impact(x, PART, 3, 100).withColumn("path", F.array_join("path", " "))),
        "impact_file": one(lambda x: traverse.impact(only(x, "imports"), NATION, 3, 1000).select("id", "depth", "relation")),
        "impact_summary": one(summary),
        "callers": one(lambda x: relations.callers(x, PART)),
        "callees": one(lambda x: relations.callees(x, CUSTOMER)),
        "imports": one(lambda x: relations.imports(x, CUSTOMER)),
        "imported_by": one(lambda x: relations.imported_by(x, NATION)),
        "node_details": one(lambda x: relations.node_details(x, PART)),
        "edge_breakdown": one(breakdown),
        "symbols_per_file": one(relations.symbols_per_file),
        "overview_edges": one(lambda x: relations.overview(x, 500)[1]),
        "known_collection": one(lambda x: relations.known_collection(x.symbols, 1000)),
        "resolve_entity": one(lambda x: resolve.resolve(x, "customer#000000007")),
        "resolve_ambiguous": one(lambda x: resolve.resolve(x, "part.")),
        "search_nodes": one(lambda x: resolve.search_nodes(x, "00001")),
        "trace_distance": one(distance),
        "trace_path": one(lambda x: traverse.trace(x, CUSTOMER, PART, 8, "explanatory")),
        "expand_context": one(lambda x: traverse.expand(x, x.symbols.filter(F.col("id") == CUSTOMER).select("file", "name", "type", "start_line")).withColumn("path", F.array_join("path", " "))),
        "neighborhood_nodes": one(lambda x: traverse.neighborhood(x, NATION, 1, 500, ("imports",))[0].select("id")),
        "execution_flow_nodes": one(lambda x: traverse.execution_flow(x, CUSTOMER)[0].select("id", "depth", "terminal")),
        "execution_flow_edges": one(lambda x: traverse.execution_flow(x, CUSTOMER)[1]),
        "importer_closure": one(lambda x: traverse.importer_closure(x, x.symbols.filter(F.col("id") == NATION).select("file"))),
        "degree_stats": one(intelligence.degree_stats),
        "hub_threshold": one(lambda x: intelligence.hub_threshold(intelligence.degree_stats(x))),
        "importance": one(lambda x: intelligence.importance(x, 100)),
        "area_coupling": one(lambda x: intelligence.area_coupling(x, node_areas(x)).select("source", "target", "edges")),
        "bridges": one(lambda x: intelligence.bridges(x, owner_areas(x), 1000)),
        "repository_map": one(cohesive),
        "cycles_scc": one(lambda x: intelligence.cycles(x)),
        "communities": one(lambda x: intelligence.communities(by_folder(x))),
        "community_stats": one(lambda x: intelligence.community_stats(x, node_areas(x)).select("community", "size", "files", "label", "internal_edges", "external_edges", "quality")),
    }


def oracle_sql() -> dict[str, str]:
    area_edges = f", member as materialized (select id, {AREA} as area, file, type, node_key from symbols), placed as materialized (select e.*, a.area as source, b.area as target from edges e join member a on a.id = from_id join member b on b.id = to_id)"
    degrees = """
        , arch as (select e.*, a.file as from_file, b.file as to_file from edges e join symbols a on a.id = from_id join symbols b on b.id = to_id where e.type <> 'contains'),
        ends as (
            select from_id as id, to_id as other, to_file as other_file, false as inbound, type, from_file <> to_file as away from arch
            union all select to_id, from_id, from_file, true, type, from_file <> to_file from arch),
        per as (
            select id, count(*) filter (type in ('calls', 'references') and inbound) as callers, count(*) filter (type in ('calls', 'references') and not inbound) as callees,
                count(*) filter (type in ('extends', 'implements')) as inheritance, count(*) as total_degree, count(distinct other) filter (inbound and type in ('calls', 'references', 'extends', 'implements')) as dependents
            from ends group by id),
        imps as (select distinct to_file as file, from_file as importer from arch where type = 'imports'),
        importers as (select file, count(*) as imported_by from imps group by file),
        reach as (select id, count(distinct f) as cross_file_reach from (select id, other_file as f from ends where away union select s.id, importer from symbols s join imps using (file) where importer <> file) group by id),
        stats as (
            select s.id, s.type, s.name, s.file, s.node_key, coalesce(callers, 0) as callers, coalesce(callees, 0) as callees, coalesce(imported_by, 0) as imported_by, coalesce(dependents, 0) as dependents,
                coalesce(cross_file_reach, 0) as cross_file_reach, coalesce(inheritance, 0) as inheritance, coalesce(total_degree, 0) as total_degree
            from symbols s left join per on per.id = s.id left join importers on importers.file = s.file left join reach on reach.id = s.id)"""
    signal = " + ".join(f"case when max_{s} > 0 and {s} > 0 then ln(1 + {s}) / ln(1 + max_{s}) else 0 end * {w}" for s, w in intelligence.SIGNALS.items())
    kinds = "case type " + " ".join(f"when '{k}' then {w}" for k, w in intelligence.KIND_WEIGHT.items()) + " end"
    weights = "case type " + " ".join(f"when '{k}' then {w}" for k, w in intelligence.BRIDGE_WEIGHT.items()) + " end"
    return {
        "impact": with_graph("select id, depth from items", more=_impact(1000)),
        "impact_items": with_graph("""
            select id, depth, relation, array_to_string(path, ' ') as path, case relation when 'calls' then 'caller' when 'imports' then 'imported-by' when 'extends' then 'inheritance-dependent' else 'dependent' end as reason from items""", more=_impact(100)),
        "expand_context": with_graph(
            "select id, depth::bigint as depth, type as relation, array_to_string(path, ' ') as path, place as nth from reached where place <= 8",
            more=_levels_sql(CUSTOMER, EDGE_TYPES, ("forward", "inverse"), "case when e.type = 'calls' then 0 else 1 end, e.type, e.node_key", 2)),
        "trace_path": with_graph(f"""
            select nth as hop, h[1] as from_id, h[2] as relation, h[3] as direction, h[4] as to_id from (select unnest(range(1, len(hops) + 1)) as nth, string_split(unnest(hops), ' ') as h from reached where id = '{PART}')""",
            more=_levels_sql(CUSTOMER, traverse.TRACE_TYPES, ("forward", "inverse"), f"{_priority(traverse.TRACE_PRIORITY)}, e.node_key, e.direction", 4)),
        "impact_file": with_graph("select id, depth, 'imports' as relation from items", True, f"""
            , seeds as (select id from symbols where file = (select file from symbols where id = '{NATION}')),
            reach(id, depth) as (select id, 0::bigint from seeds union select e.from_id, r.depth + 1 from reach r join edges e on e.to_id = r.id and e.type = 'imports' where r.depth < 3),
            items as (select id, min(depth) as depth from reach group by id having min(depth) > 0)"""),
        "impact_summary": with_graph(f"""
            select *, case when direct >= 10 or total >= 50 or cross_directory >= 5 then 'high' when direct >= 3 or total >= 10 or cross_file >= 3 then 'medium' else 'low' end as risk, total >= 1000 as truncated from c""", more=_impact(1000, f"""
            , t as (select file as target_file from symbols where id = '{PART}'), x as (select i.*, s.file, {DIRECTORY} as directory from items i join symbols s on s.id = i.id),
            c as (select count(*) filter (depth = 1) as direct, count(*) filter (depth > 1) as transitive, count(*) as total, count(distinct x.file) filter (x.file <> target_file) as cross_file,
                count(distinct directory) filter (directory <> regexp_replace(target_file, '/[^/]*$', '')) as cross_directory from x, t)""")),
        "callers": _related_sql(PART, "calls", True),
        "callees": _related_sql(CUSTOMER, "calls", False),
        "imports": with_graph(f"""
            select id, node_key, 'imports' as relation, 'forward' as direction, row_number() over (order by node_key) as rank from (
                select distinct to_id as id from edges where type = 'imports' and from_id = (select id from symbols where type = 'file' and file = (select file from symbols where id = '{CUSTOMER}')))
            join symbols using (id) order by node_key limit 100"""),
        "imported_by": _related_sql(NATION, "imports", True),
        "node_details": with_graph("select role, id, node_key from (" + " union all ".join(f"select '{role}' as role, {'from_id' if inverse else 'to_id'} as id from edges where type = '{kind}' and {'to_id' if inverse else 'from_id'} = '{PART}'" for role, (kind, inverse) in relations.DETAILS.items()) + ") join symbols using (id)"),
        "edge_breakdown": with_graph("select type, count(*) as edges from edges group by type"),
        "symbols_per_file": with_graph("select file, count(*) filter (type <> 'file') as symbols from symbols group by file"),
        "overview_edges": with_graph(", n as (select id from symbols order by node_key limit 500) select from_id, to_id, type from edges where from_id in (select id from n) and to_id in (select id from n)"),
        "known_collection": with_graph("select count(*) as total, least(count(*), 1000) as returned, count(*) - least(count(*), 1000) as omitted, count(*) > 1000 as truncated from symbols"),
        "resolve_entity": _resolve_sql("customer#000000007"),
        "resolve_ambiguous": _resolve_sql("part."),
        "search_nodes": with_graph("""
            select id, name, type, file, case when lower(name) = '00001' then 0 when contains(lower(name), '00001') then 1 else 2 end::bigint as rank, node_key from symbols
            where contains(lower(name), '00001') or contains(lower(coalesce(qualified_name, '')), '00001') or contains(lower(file), '00001') order by rank, node_key limit 30"""),
        "trace_distance": with_graph(f"""
            , ways as (select from_id as a, to_id as b from edges union all select to_id, from_id from edges),
            walk(id, hops) as (select '{CUSTOMER}', 0::bigint union select b, hops + 1 from walk join ways on a = id where hops < 4 and id <> '{PART}')
            select min(hops) as hops from walk where id = '{PART}'""", True),
        "neighborhood_nodes": with_graph(f"select distinct id from (select '{NATION}' as id union all select to_id from edges where type = 'imports' and from_id = '{NATION}' union all select from_id from edges where type = 'imports' and to_id = '{NATION}')"),
        "execution_flow_nodes": with_graph("select id, min(depth) as depth, id not in (select from_id from edges where type = 'calls') as terminal from flow group by id", True, f"""
            , flow(id, depth) as (select '{CUSTOMER}', 0::bigint union select to_id, depth + 1 from flow join edges on from_id = id and type = 'calls' where depth < 8)"""),
        "execution_flow_edges": with_graph("select from_id, to_id, count(*) as calls from edges where type = 'calls' and from_id in (select id from flow) and to_id in (select id from flow) group by all", True, f"""
            , flow(id, depth) as (select '{CUSTOMER}', 0::bigint union select to_id, depth + 1 from flow join edges on from_id = id and type = 'calls' where depth < 8)"""),
        "importer_closure": with_graph(f"""
            , f as (select distinct a.file as importer, b.file as imported from edges e join symbols a on a.id = from_id join symbols b on b.id = to_id where e.type = 'imports'),
            c(file) as (select file from symbols where id = '{NATION}' union select importer from f join c on c.file = imported) select file from c""", True),
        "degree_stats": with_graph("select id, callers, callees, imported_by, dependents, cross_file_reach, inheritance, total_degree from stats", more=degrees),
        "hub_threshold": with_graph("select d[floor((len(d) - 1) * 0.95)::int + 1] as hub_threshold from (select list(total_degree order by total_degree) as d from stats)", more=degrees),
        "importance": with_graph(f"""
            , cand as (select * from stats where type <> 'file'),
            m as (select {", ".join(f"max({s}) as max_{s}" for s in intelligence.SIGNALS)}, list(total_degree order by total_degree)[floor((count(*) - 1) * 0.95)::int + 1] as hub from cand),
            p as (select *, case when total_degree >= greatest(8, hub) and cross_file_reach <= greatest(1, floor(total_degree * 0.25)) then 0.55 else 1.0 end::double as noise_penalty from cand, m),
            s as (select id, node_key, round(least(1.0, (({signal}) * {kinds} * noise_penalty / {intelligence.HIGHEST_KIND})::double), 9) as score, noise_penalty from p)
            select row_number() over (order by score desc, node_key) as rank, id, score, noise_penalty from s order by score desc, node_key limit 100""", more=degrees),
        "area_coupling": with_graph("select source, target, count(*) as edges from placed where source <> target group by all", more=area_edges),
        "bridges": with_graph(f"""
            , deg as (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by id),
            mx as (select max(degree) as max_degree from deg),
            cross_ as (select * from placed where source <> target and type <> 'contains'),
            pair as (select source, target, count(*) as pair from cross_ group by all),
            ext as (select id, count(*) as external from (select from_id as id from cross_ union all select to_id from cross_) group by id),
            n as (select m.id, m.type as kind, {DIRECTORY} as directory, external, node_key from member m join deg using (id) join ext using (id), mx where not (degree >= greatest(8.0, max_degree * 0.8) and external >= 4))
            select from_id, to_id, type, source, target, round({weights}::double / (pair * sqrt(greatest(1, a.external + b.external))), 9) as score
            from cross_ join pair using (source, target) join n a on a.id = from_id join n b on b.id = to_id
            where (pair <= 2 or (a.external <= 2 and b.external <= 2)) and (a.directory <> b.directory or type in ('imports', 'extends') or a.kind in ('file', 'class', 'interface') or b.kind in ('file', 'class', 'interface'))
            order by score desc, a.node_key, b.node_key, from_id, to_id, type limit 1000""", more=area_edges.replace(AREA, OWNER)),
        "repository_map": with_graph("""
            , size as (select area, count(distinct file) as files, count(*) filter (type <> 'file') as symbols from member group by area),
            side as (select source as area, source = target as inner_ from placed where type <> 'contains' union all select target, false from placed where type <> 'contains' and source <> target),
            cnt as (select area, count(*) filter (inner_) as i, count(*) filter (not inner_) as o from side group by area)
            select area, files, symbols, coalesce(i, 0) as internal_edges, coalesce(o, 0) as external_edges, round(coalesce(i / (i + o), 0.0), 9) as cohesion, round(coalesce(o, 0) / symbols, 9) as coupling from size left join cnt using (area)""", more=area_edges),
        "cycles_scc": with_graph("""
            , e as (select from_id as a, to_id as b from edges where type = 'imports'), r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
            select 'imports' as relation, min(y.b) as component, x.a as id from r x join r y on y.a = x.a and exists (select 1 from r z where z.a = y.b and z.b = x.a) where x.a = x.b group by x.a""", True),
        "community_stats": with_graph(f"""
            , size as (select area, count(*) as size, count(distinct file) as files from member group by area),
            dirs as (select area, {DIRECTORY} as directory, count(*) as n from member group by all), lab as (select area, arg_min(directory, (-n, directory)) as label from dirs group by area),
            side as (select source as area, source = target as inner_ from placed union all select target, false from placed where source <> target),
            cnt as (select area, count(*) filter (inner_) as i, count(*) filter (not inner_) as o from side group by area)
            select area as community, size, files, label, coalesce(i, 0) as internal_edges, coalesce(o, 0) as external_edges, case when size = 1 then 'singleton' when size < 3 then 'tiny' when size > 200 then 'oversized' else 'normal' end as quality
            from size join lab using (area) left join cnt using (area)""", more=area_edges),
    }
