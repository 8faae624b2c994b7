"""Registered change, policy, reliability, resolution, workspace and context queries, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph, read_table
from weftgraph.operators import change, context, evaluation, policy, reliability, resolution, traverse, workspace
from weftgraph.plans.graph_queries import graph_of, only, symbols_of, symbols_upto, with_graph
from weftgraph.session import few, ship

#: The date that splits line items into a snapshot before and after.
SPLIT = "1998-05-24"


def before_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The calls of orders that have a line item shipped before the split, over the nodes of the whole graph."""
    g = graph_of(spark, sf_dir)
    early = read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp")).select(F.concat(F.lit("method:orders/"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("from_id"), F.concat(F.lit("interface:part/"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("to_id")).distinct()
    return CodeGraph(g.symbols, early.withColumn("type", F.lit("calls")))


def uses_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    g = graph_of(spark, sf_dir)
    return CodeGraph(g.symbols, g.edges.filter("type = 'calls' and from_id like 'method:%'"))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = read_table(spark, sf_dir, "events")
    path = F.concat(F.lit("region/"), F.lpad(F.col("n_regionkey").cast("string"), 10, "0"), F.lit("/nation/"), F.lpad(F.col("n_nationkey").cast("string"), 10, "0"))
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", path.alias("path"))
    rows = e.join(F.broadcast(n), (F.col("user_id") % 25) == F.col("n_nationkey"))
    start, lines = (1 + F.col("event_id") % 500).cast("int"), (F.col("event_id") % 5).cast("int")
    return rows.select("path", start.alias("old_start"), (F.col("event_id") % 3).cast("int").alias("old_lines"), start.alias("new_start"), lines.alias("new_lines"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[change.Side, change.Side]:
    """Symbols before, without orders of the last years, and after, without those of the first."""
    dated = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("method:orders/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("id"), F.year("o_orderdate").alias("year"))

    def tagged(rows: DataFrame) -> DataFrame:
        # Orders are reduced to the symbols asked for where these are few.
        return rows.join(dated.join(few(rows.select("id").distinct()), "id", "left_semi"), "id", "left")

    whole = replace(whole_side(spark, sf_dir), tagged=tagged)
    return replace(whole, kept="year is null or year <= 1996"), replace(whole, kept="year is null or year >= 1994")


def whole_side(spark: SparkSession, sf_dir: str) -> change.Side:
    return change.Side(symbols_of(spark, sf_dir), lambda last: symbols_upto(spark, sf_dir, last))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunks(spark, sf_dir).select("path", F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("status")).distinct()


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as evidence: a user is a scope, an hour of theirs an output."""
    ship(spark)
    e = read_table(spark, sf_dir, "events")
    outcome = F.element_at(F.array(*[F.lit(o) for o in reliability.OUTCOMES]), (F.col("event_id") % 37 % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("scope_key"), (F.col("event_id") % 11).alias("output_key"), outcome.alias("outcome"), (F.col("event_id") % 13 != 0).alias("complete"), (F.col("event_id") % 17 == 0).alias("stale"), (F.col("event_type") != "error").alias("applicable"), (F.col("event_type") != "view").alias("supported"), (F.col("value") > 1).alias("attempted"))


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    e = read_table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(g) for g in reliability.GAPS]), (F.col("event_id") % 13 + 1).cast("int"))
    return e.select(kind.alias("kind"), (F.col("event_id") % 3).alias("count"), F.col("event_type").alias("file"))


def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of errors as symbols without a test."""
    e = read_table(spark, sf_dir, "events")
    return e.filter("event_type = 'error'").select(F.col("event_type").alias("file"), F.concat(F.lit("s"), (F.col("event_id") % 11).cast("string")).alias("symbol_id"))


GROUPS = tuple(policy.Group(f"region{i}", (f"region/{i:010d}/**",)) for i in range(5))
RULES = (policy.Rule("no-0-1", "region0", "region1", severity="high"), policy.Rule("no-2-3", "region2", "region3"), policy.Rule("no-4-0", "region4", "region0", severity="low"))
BASELINE = policy.Policy(GROUPS, RULES[:2])
TARGET = policy.Policy(GROUPS, RULES[1:], cycles=True)


def import_sides(spark: SparkSession, sf_dir: str) -> tuple[CodeGraph, CodeGraph]:
    """Imports before files of region 2 imported anything, and after nothing imported files of region 1 any more."""
    g = only(graph_of(spark, sf_dir), "imports")
    within = lambda i: g.symbols.filter(F.col("file").startswith(f"region/{i:010d}/")).select("id")
    before = g.edges.join(within(2).withColumnRenamed("id", "from_id"), "from_id", "left_anti").select(*g.edges.columns)
    after = g.edges.join(within(1).withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*g.edges.columns)
    return CodeGraph(g.symbols, before), CodeGraph(g.symbols, after)


def import_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events as imports between modules, and the files there are."""
    ship(spark)
    e = read_table(spark, sf_dir, "events")
    spec = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("./")).otherwise(F.lit("../lib/")), F.lit("m"), (F.col("user_id") % 60).cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit(".js")).otherwise(F.lit("")))
    imports = e.select(F.concat(F.lit("src/a"), (F.col("user_id") % 9).cast("string"), F.lit("/x.ts")).alias("file"), spec.alias("specifier")).distinct()
    m = e.select((F.col("user_id") % 60).alias("m")).distinct()
    lib = m.select(F.concat(F.lit("src/lib/m"), F.col("m").cast("string"), F.when(F.col("m") % 2 == 0, F.lit(".ts")).when(F.col("m") % 3 == 0, F.lit("/index.tsx")).otherwise(F.lit(".css"))).alias("file"))
    near = m.filter("m % 5 = 0").select(F.concat(F.lit("src/a3/m"), F.col("m").cast("string"), F.lit(".jsx")).alias("file"))
    return imports, lib.union(near)


def messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even orders as producers, odd ones as consumers of events and requests over Kafka or another protocol."""
    ship(spark)
    o = read_table(spark, sf_dir, "orders")
    kafka = F.col("o_custkey") % 3 == 0
    base = [F.concat(F.lit("repo"), (F.col("o_custkey") % 7).cast("string")).alias("repo"), F.col("o_orderkey").cast("string").alias("id"), F.when(kafka, "kafka").otherwise("unspecified").alias("protocol_kind"), F.lit("literal").alias("destination_kind"),
            F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("destination"), F.when(kafka, "spring").otherwise("nestjs").alias("framework")]
    producers = o.filter("o_orderkey % 2 = 0").select(*base, F.when(F.col("o_orderkey") % 4 == 0, "event").otherwise("request").alias("producer_kind"), (F.col("o_orderkey") % 10 != 0).alias("proven"))
    consumers = o.filter("o_orderkey % 2 <> 0").select(*base, F.when(kafka | (F.col("o_orderkey") % 3 == 0), "event").otherwise("request_response").alias("consumer_kind"))
    return producers, consumers


def packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    p = read_table(spark, sf_dir, "part").select(F.concat(F.lit("repo"), (F.col("p_partkey") % 5).cast("string")).alias("repo"), F.lower(F.regexp_replace(F.concat_ws("-", "p_brand", (F.col("p_partkey") % 90).cast("string")), "[^A-Za-z0-9-]", "-")).alias("name")).distinct()
    s = read_table(spark, sf_dir, "supplier")
    deps = s.select(F.concat(F.lit("repo"), (F.col("s_suppkey") % 6).cast("string")).alias("repo"), F.when(F.col("s_suppkey") % 2 == 0, "runtime").otherwise("dev").alias("kind"), F.concat(F.lit("brand-"), (F.col("s_suppkey") % 30).cast("string"), F.lit("-"), (F.col("s_suppkey") % 90).cast("string")).alias("declared_name"), F.when(F.col("s_suppkey") % 7 == 0, "file:../x").otherwise("^1.0.0").alias("raw_spec")).distinct()
    return p, deps


def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    c = read_table(spark, sf_dir, "conversations")
    kinds = F.array(*[F.lit(k) for k in ("lexical", "semantic", "graph", "explicit_anchor", "impact")])
    return c.select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("subject"), F.when(F.col("turn") == 7, "explicit_anchor").when(F.col("turn") > 4, "graph").otherwise(F.element_at(kinds, (F.col("turn") % 2 + 1).cast("int"))).alias("kind"), (F.col("conv_id") % 50 + F.col("turn") + 1).alias("rank"), (F.col("turn") == 3).alias("exact"), (F.length("text") % 300 + 20).cast("long").alias("tokens"))


def queries() -> dict:
    def changed(s: SparkSession, d: str) -> DataFrame:
        return change.changed_symbols(*snapshots(s, d), changed_files(s, d), hunks(s, d))

    def changed_impact(s: SparkSession, d: str) -> DataFrame:
        g = only(graph_of(s, d), "calls")
        seeds = g.symbols.filter("type = 'interface' and id like '%00'").select("id")
        return change.multi_impact(g, seeds, 2).select("id", "depth", F.array_join("origins", " ").alias("origins"))

    def decisions(s: SparkSession, d: str) -> DataFrame:
        g = graph_of(s, d, "imports")
        names = g.symbols.filter("type = 'interface'").select("id", "file", "name", F.lit("function").alias("type"))
        sites = names.select(F.concat(F.lit("site:"), "id").alias("site_id"), "file", F.col("name").alias("callee"), F.lit("typescript").alias("language"), (F.col("id").like("%7")).alias("uncertain"))
        classes = g.symbols.filter("type = 'class'").select("id", "file", "name", "type")
        file_of = g.symbols.filter("type = 'file'").select("id", "file")
        pairs = g.edges.filter("type = 'imports'").join(file_of.select(F.col("id").alias("from_id"), F.col("file").alias("importer")), "from_id").join(file_of.select(F.col("id").alias("to_id"), F.col("file").alias("target_file")), "to_id")
        used = pairs.join(classes.select(F.col("file").alias("target_file"), "name", "id"), "target_file")
        bound = used.select(F.col("importer").alias("file"), F.concat(F.lit("a "), "name").alias("local_name"), "target_file", F.col("name").alias("imported_name"))
        sites = sites.union(used.select(F.concat_ws(":", F.lit("use"), "importer", "id"), "importer", F.concat(F.lit("a "), "name"), F.lit("typescript"), F.lit(False)))
        return resolution.decide_calls(sites, names.union(classes), bound).select("site_id", "status", "target", "strategy", "confidence", F.array_join("candidates", " ").alias("candidates"), "reason")

    def owners(s: SparkSession, d: str) -> DataFrame:
        e = hunks(s, d).filter("new_lines > 0")
        points = e.select(F.concat_ws(":", "path", "new_start", "new_lines").alias("point_id"), F.col("path").alias("file"), F.col("new_start").alias("start_line"), (F.col("new_start") + F.col("new_lines") - 1).alias("end_line")).distinct()
        return resolution.direct_owner(points, graph_of(s, d).symbols.filter("type <> 'file'"))

    def gate(s: SparkSession, d: str) -> DataFrame:
        facts = contributions(s, d).agg(F.lit("high").alias("risk"), F.count_if("stale").alias("uncovered"), F.count(F.lit(1)).alias("affected"), F.count_if("complete").alias("covered"), F.lit(False).alias("authoritative"))
        found = policy.architecture_drift(*import_sides(s, d), BASELINE, TARGET)
        rules = policy.GatePolicy("medium", False, 10, 0.5, True, ("parser_error",), "low")
        return policy.change_gate(rules, facts, reliability.merge_gaps(gap_rows(s, d)), found)

    def context_rows(s: SparkSession, d: str) -> DataFrame:
        return context.ranked(context.merge_candidates(candidate_evidence(s, d)))

    def status(s: SparkSession, d: str) -> DataFrame:
        ship(s)
        docs = read_table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_hash"), "doc_id")
        return change.repository_status(docs.filter("doc_id % 10 <> 0").select("path", "content_hash"), docs.filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.lit("other")).otherwise(F.col("content_hash")).alias("content_hash")))

    def coverage(s: SparkSession, d: str) -> DataFrame:
        ship(s)
        e = read_table(s, d, "events").select("event_type", *[(F.col("event_id") % (i + 2)).alias(c) for i, c in enumerate(reliability.COUNTERS)], (F.col("event_id") % 997 == 0).alias("may_be_incomplete"))
        return reliability.merge_coverage(e, "event_type")

    def evidence(s: SparkSession, d: str) -> DataFrame:
        g = graph_of(s, d)
        rows = g.edges.filter("type = 'implements'").select(F.col("from_id").alias("key"), F.substring("to_id", -1, 1).alias("value"), F.col("to_id").alias("node_id"))
        return workspace.accepted_evidence(rows, g.symbols.filter("id like '%1' or id like '%12' or id like '%2'"))

    def entries(s: SparkSession, d: str) -> DataFrame:
        ship(s)
        o = read_table(s, d, "orders")
        e = o.select(F.lit("nest").alias("framework"), F.when(F.col("o_orderkey") % 2 == 0, "route").when(F.col("o_orderkey") % 3 == 0, "scheduled_job").otherwise("component").alias("kind"), F.col("o_orderkey").cast("string").alias("logical_key"), "o_orderkey", "o_custkey")
        bound = e.filter("o_orderkey % 4 = 0").select("framework", "kind", "logical_key", F.lit("controller_route").alias("relation_kind"), F.explode(F.array(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 8 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).cast("string"))).alias("node_id"))
        return workspace.list_entries(e, bound, kind="route")

    def comparison(s: SparkSession, d: str) -> DataFrame:
        ship(s)
        o = read_table(s, d, "orders").groupBy(F.concat(F.when(F.col("o_custkey") % 2 == 0, "hit_").otherwise("tokens_"), "o_orderpriority").alias("metric"))
        return evaluation.against_policy(o.agg(F.sum(F.col("o_orderkey") % 10).alias("value")), o.agg(F.sum(F.col("o_orderkey") % 9).alias("value")).filter("metric not like '%URGENT'"))

    def reexported(s: SparkSession, d: str) -> DataFrame:
        """Suppliers as the names that nations export, handed on whole along imports."""
        g = graph_of(s, d)
        own = g.symbols.filter("type = 'class'").select("file", "name", F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("source_name"))
        file_of = g.symbols.filter("type = 'file'").select("id", "file")
        stars = g.edges.filter("type = 'imports'").join(file_of.select(F.col("id").alias("from_id"), "file"), "from_id").join(file_of.select(F.col("id").alias("to_id"), F.col("file").alias("source_file")), "to_id")
        none = F.lit(None).cast("string")
        return resolution.reexports(own.union(stars.select("file", none, "source_file", none)))

    def scopes(s: SparkSession, d: str) -> DataFrame:
        """Files hold customers, customers their orders."""
        sym = graph_of(s, d).symbols
        file_of = sym.filter("type = 'file'").select("file", F.col("id").alias("file_id"))
        owner = F.concat(F.lit("function:"), F.replace(F.substring_index("qualified_name", ".orders", 1), F.lit("."), F.lit("/")))
        rows = sym.filter("type in ('file', 'function', 'method')").join(file_of, "file")
        return rows.select("file", F.col("id").alias("scope_id"), F.when(F.col("type") == "method", owner).when(F.col("type") == "function", F.col("file_id")).alias("parent_id"))

    def bindings(s: SparkSession, d: str) -> DataFrame:
        """Each order asks for a name that its file binds, and every tenth customer too."""
        tree = scopes(s, d)
        sites = tree.filter("scope_id like 'method:%'").select(F.col("scope_id").alias("site_id"), "file", "scope_id", F.lit("x").alias("name"))
        bound = tree.filter("scope_id like 'file:%'").select("file", "scope_id", F.lit("x").alias("name"), F.concat(F.lit("file:"), "file").alias("target")).union(
            tree.filter("scope_id like 'function:%0'").select("file", "scope_id", F.lit("x").alias("name"), F.concat(F.lit("own:"), "scope_id").alias("target")))
        return resolution.innermost_binding(sites, resolution.scope_closure(tree), bound)

    def members(s: SparkSession, d: str) -> DataFrame:
        """Orders as calls of methods on `this` or a variable, over five classes."""
        ship(s)
        o = read_table(s, d, "orders")
        n = lambda prefix, column, m: F.concat(F.lit(prefix), (F.col(column) % m).cast("string"))
        sites = o.select(F.col("o_orderkey").cast("string").alias("site_id"), n("f", "o_custkey", 7).alias("file"), n("C", "o_custkey", 5).alias("owner_class"), F.when(F.col("o_orderkey") % 3 == 0, "this").otherwise(n("r", "o_orderkey", 4)).alias("receiver"), n("m", "o_orderkey", 6).alias("method"), F.lit("typescript").alias("language"), F.lit(False).alias("uncertain"))
        methods = s.createDataFrame([(f"C{c}.m{m}", f"C{c}", f"m{m}") for c in range(5) for m in range(6) if (c + m) % 4], "id string, class_name string, name string")
        types = s.createDataFrame(TYPES, "file string, owner_class string, receiver string, type_name string, how string")
        return resolution.decide(sites, resolution.member_candidates(sites, methods, types)).select("site_id", "status", "target", "strategy")

    def inherited(s: SparkSession, d: str) -> DataFrame:
        """Orders as calls on `this` of customers' classes, each with a parent; every seventh class has the methods of its number."""
        ship(s)
        o, c = read_table(s, d, "orders"), read_table(s, d, "customer")
        name = lambda column: F.concat(F.lit("C"), column.cast("string"))
        sites = o.select(F.col("o_orderkey").cast("string").alias("site_id"), name(F.col("o_custkey")).alias("owner_class"), F.when(F.col("o_orderkey") % 5 == 0, "super").otherwise("this").alias("receiver"), F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("method"))
        heritage = c.filter("c_custkey > 1").select(name(F.col("c_custkey")).alias("class_name"), name(F.floor(F.col("c_custkey") / 2)).alias("parent"))
        methods = c.filter("c_custkey % 7 = 0").select(F.concat(name(F.col("c_custkey")), F.lit(".m"), (F.floor(F.col("c_custkey") / 7) % 3).cast("string")).alias("id"), name(F.col("c_custkey")).alias("class_name"), F.concat(F.lit("m"), (F.floor(F.col("c_custkey") / 7) % 3).cast("string")).alias("name"))
        return resolution.inherited_candidates(sites, methods, heritage).select("site_id", "target")

    return {
        "coverage_merge": coverage,
        "accepted_evidence": evidence,
        "list_entries": entries,
        "policy_comparison": comparison,
        "changed_symbols": changed,
        "change_summary": lambda s, d: change.change_summary(changed(s, d)),
        "unmapped_hunks": lambda s, d: change.unmapped_hunks(*[whole_side(s, d)] * 2, changed_files(s, d), hunks(s, d)),
        "changed_impact": changed_impact,
        "affected_tests": lambda s, d: change.affected_tests(as_tests(graph_of(s, d, *traverse.IMPACT_TYPES)), symbols_of(s, d).filter("id = 'interface:part/0000000001'").select("id")).withColumns({"kinds": F.array_join("kinds", " "), "test_symbols": F.array_join("test_symbols", " ")}),
        "graph_delta": lambda s, d: change.graph_delta(before_graph(s, d), uses_graph(s, d), None, 1000),
        "delta_summary": lambda s, d: change.delta_summary(before_graph(s, d), uses_graph(s, d)),
        "repository_status": status,
        "plan_invalidation": lambda s, d: change.plan_invalidation(*invalidation_input(s, d), only(graph_of(s, d), "imports")),
        "policy_membership": lambda s, d: policy.membership(graph_of(s, d).symbols, BASELINE),
        "policy_decisions": lambda s, d: policy.decide(e := change.structural_edges(only(graph_of(s, d), "imports")), policy.membership(e.select(F.explode(F.array("from_file", "to_file")).alias("file")), TARGET), TARGET).groupBy("action", "rule_id").agg(F.count(F.lit(1)).alias("edges")),
        "architecture_drift": lambda s, d: policy.architecture_drift(*import_sides(s, d), BASELINE, TARGET).filter("finding = 'forbidden_dependency'"),
        "architecture_cycles": lambda s, d: policy.cycle_drift(*import_sides(s, d), BASELINE, TARGET),
        "change_gate": gate,
        "gate_summary": lambda s, d: policy.gate_summary(gate(s, d)),
        "reliability": lambda s, d: reliability.aggregate_reliability(contributions(s, d)),
        "coverage_gaps": lambda s, d: reliability.coverage_gaps(gap_rows(s, d)),
        "merge_gaps": lambda s, d: reliability.merge_gaps(gap_rows(s, d)),
        "verification_targets": lambda s, d: reliability.verification_targets(gap_rows(s, d), uncovered(s, d)),
        "diagnostics_summary": lambda s, d: reliability.diagnostics_summary(gap_rows(s, d)),
        "resolve_imports": lambda s, d: resolution.resolve_imports(*import_rows(s, d)),
        "call_decisions": decisions,
        "direct_owner": owners,
        "message_links": lambda s, d: workspace.message_links(*messages(s, d)),
        "workspace_message_links": lambda s, d: workspace.cross_message_links(*messages(s, d)),
        "workspace_package_links": lambda s, d: workspace.package_links(*packages(s, d)),
        "workspace_map": lambda s, d: workspace.workspace_map(by_region(graph_of(s, d)), by_region_edges(graph_of(s, d))),
        "task_context_ranking": lambda s, d: context_rows(s, d).withColumn("signal", F.round("signal", 9)),
        "task_context_budget": lambda s, d: context.budgeted(context_rows(s, d)).select("rank", "subject", "included"),
        "reexports": reexported,
        "scope_closure": lambda s, d: resolution.scope_closure(scopes(s, d)),
        "innermost_bindings": bindings,
        "member_calls": members,
        "inherited_calls": inherited,
    }


#: Types of receivers: (file, class that they hold in or None, receiver, type, how it is known); two kinds for some, none for others.
TYPES = [(f"f{f}", None if r < 2 else f"C{(f + r) % 5}", f"r{r}", f"C{(f + r + more) % 5}", ("declared", "constructor", "parameter", "assignment")[(f + r) % 4]) for f in range(7) for r in range(3) for more in ((0, 1) if f % 3 == 0 else (0,))]
_TYPES_SQL = [(f[1:], "null" if owner is None else f"'{owner}'", r[1:], kind, how) for f, owner, r, kind, how in TYPES]


def as_tests(g: CodeGraph) -> CodeGraph:
    """Every third order in a test folder of its nation."""
    test = (F.col("type") == "method") & F.col("id").rlike("[369]$")
    return CodeGraph(g.symbols.withColumn("file", F.when(test, F.concat("file", F.lit("/tests/"), "name")).otherwise(F.col("file"))), g.edges)


def by_region(g: CodeGraph) -> DataFrame:
    return g.symbols.withColumn("repo", F.substring_index("file", "/", 2))


def by_region_edges(g: CodeGraph) -> DataFrame:
    return g.edges.join(by_region(g).select(F.col("id").alias("from_id"), "repo"), "from_id")


def invalidation_input(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = graph_of(s, d).symbols.filter("type = 'file'").select(F.col("file").alias("path"), F.sha2("file", 256).alias("content_hash"))
    current = files.filter("path not like '%7'").select(F.when(F.col("path").like("%8"), F.concat("path", F.lit("-moved"))).otherwise(F.col("path")).alias("path"), F.when(F.col("path").like("%03"), F.lit("edited")).otherwise(F.col("content_hash")).alias("content_hash"))
    return current, files


def oracle_sql() -> dict[str, str]:
    hunk = """, hunk as (
        select 'region/' || lpad(n_regionkey::varchar, 10, '0') || '/nation/' || lpad(n_nationkey::varchar, 10, '0') as path, (1 + event_id % 500)::int as s, (event_id % 5)::int as n, (event_id % 3)::int as o from events join nation on user_id % 25 = n_nationkey)"""
    touched = lambda side: f"select distinct id, file, type, coalesce(qualified_name, name) as label from {side} x join hunk on path = file and {'n' if side == 'late_side' else 'o'} > 0 and coalesce(start_line, end_line, 0) <= s + {'n' if side == 'late_side' else 'o'} - 1 and coalesce(end_line, start_line, 0) >= s"
    snap = f""", dated as (select x.*, year(o_orderdate) as y from symbols x left join orders on x.id = 'method:orders/' || lpad(o_orderkey::varchar, 10, '0')),
        early_side as materialized (select * from dated where y is null or y <= 1996), late_side as materialized (select * from dated where y is null or y >= 1994),
        new_hit as materialized ({touched("late_side")}), old_hit as materialized ({touched("early_side")}),
        kinds as (
            select id, file, case when exists (select 1 from early_side b where (b.file, b.type, coalesce(b.qualified_name, b.name)) = (h.file, h.type, h.label) and b.file in (select path from hunk)) then 'modified' else 'added' end as change_kind from new_hit h
            union all select id, file, 'deleted' from old_hit where (file, type, label) not in (select (file, type, label) from new_hit))"""
    key = lambda t: f"case when {t}.type = 'file' then 'file:' || {t}.file else 'symbol:' || {t}.file || ':' || {t}.type || ':' || coalesce({t}.qualified_name, {t}.name) end"
    delta = f""", early as (select distinct 'method:orders/' || lpad(l_orderkey::varchar, 10, '0') as from_id, 'interface:part/' || lpad(l_partkey::varchar, 10, '0') as to_id from lineitem where l_shipdate < timestamp '{SPLIT}'),
        late as (select from_id, to_id from edges where type = 'calls' and from_id like 'method:%'),
        b as (select distinct 'calls' as kind, {key("x")} as from_key, {key("y")} as to_key from early join symbols x on x.id = from_id join symbols y on y.id = to_id),
        a as (select distinct 'calls' as kind, {key("x")} as from_key, {key("y")} as to_key from late join symbols x on x.id = from_id join symbols y on y.id = to_id)"""
    group = "case when regexp_matches(file, '^region/000000000[0-4]/') then 'region' || file[17] end"
    pol = f""", m as (select id, file, {group} as g from symbols), e as (select distinct a.file as from_file, b.file as to_file, {key("x")} as from_key, {key("y")} as to_key, a.g as gf, b.g as gt
        from edges join symbols x on x.id = from_id join symbols y on y.id = to_id join m a on a.id = from_id join m b on b.id = to_id where edges.type = 'imports')"""
    drift = """, sides as (select *, coalesce(gf <> 'region2', true) as was, coalesce(gt <> 'region1', true) as is_, coalesce((gf, gt) in (('region0', 'region1'), ('region2', 'region3')), false) as base_bad, coalesce((gf, gt) in (('region2', 'region3'), ('region4', 'region0')), false) as target_bad from e),
        drift as (select 'forbidden_dependency' as finding, case when is_ and target_bad then 'introduced' else 'resolved' end as status, case when was <> is_ and base_bad <> target_bad then 'both' when base_bad <> target_bad then 'policy_change' else 'code_change' end as cause,
            case gf when 'region0' then 'high' when 'region2' then 'medium' else 'low' end as severity, case gf when 'region0' then 'no-0-1' when 'region2' then 'no-2-3' else 'no-4-0' end as rule_id, from_key || ' imports ' || to_key as detail
            from sides where (was and base_bad) <> (is_ and target_bad))"""
    side = lambda name, flag: f"""
        i_{name} as (select distinct from_file as a, to_file as b from sides where {flag}), r_{name}(a, b) as (select a, b from i_{name} union select r_{name}.a, i_{name}.b from r_{name} join i_{name} on i_{name}.a = r_{name}.b),
        k_{name} as (select x.a as file, min(y.b) as component from r_{name} x join r_{name} y on y.a = x.a and exists (select 1 from r_{name} z where z.a = y.b and z.b = x.a) where x.a = x.b group by x.a),
        c_{name} as (select string_agg(file, ' ' order by file) as detail from k_{name} group by component)"""  # noqa: E731
    loops = f""", {side("old", "was")}, {side("new", "is_")},
        loops as (select 'dependency_cycle' as finding, 'introduced' as status, case when detail in (select detail from c_old) then 'policy_change' else 'both' end as cause, 'medium' as severity, null::varchar as rule_id, detail from c_new)"""
    checks = """, ev as (select count(*) filter (event_id % 17 = 0) as uncovered, count(*) as affected, count(*) filter (event_id % 13 <> 0) as covered, count(*) filter (event_id % 13 = 6) as parser from events),
        intro as (select count(*) as n from (select status from drift where status = 'introduced' union all select status from loops)),
        checks as (
            select 'risk.maxAllowed' as id, 'fail' as status, 'high' as actual
            union all select 'tests.maxUncoveredAffectedSymbols', case when uncovered <= 10 then 'pass' else 'fail' end, uncovered::varchar from ev
            union all select 'tests.minStructuralTestEvidenceRatio', case when covered / affected >= 0.5 then 'pass' else 'fail' end, round(covered / affected, 6)::varchar from ev
            union all select 'diagnostics.authoritativeNegativeResults', 'fail', 'false'
            union all select 'diagnostics.forbidGapKinds', case when least(parser, 1) = 0 then 'pass' else 'fail' end, least(parser, 1)::varchar from ev
            union all select 'architecture.introducedSeverity', case when n > 0 then 'fail' else 'warn' end, n::varchar from intro)""".replace("event_id % 13 = 6", f"event_id % 13 = {reliability.GAPS.index('parser_error')}")
    outcomes = "[" + ", ".join(f"'{o}'" for o in reliability.OUTCOMES) + "]"
    gaps = "[" + ", ".join(f"'{g}'" for g in reliability.GAPS) + "]"
    gap = f"with gap as (select ({gaps})[(event_id % 13 + 1)::int] as kind, event_id % 3 as count, event_type as file from events)"
    msg = """with o as (
            select 'repo' || (o_custkey % 7) as repo, o_orderkey as k, o_orderkey::varchar as id, o_custkey % 3 = 0 as kafka, o_orderpriority || '/' || (o_custkey % 40) as destination from orders),
        p as (select *, k % 10 <> 0 as proven, case when kafka or k % 4 = 0 then 'event' else 'request_response' end as kind from o where k % 2 = 0),
        c as (select *, case when kafka or k % 3 = 0 then 'event' else 'request_response' end as kind from o where k % 2 <> 0)"""
    return {
        "changed_symbols": with_graph("select * from kinds", more=hunk + snap),
        "change_summary": with_graph("select count(distinct file) as files, " + ", ".join(f"count(*) filter (change_kind = '{k}') as {k}" for k in ("modified", "added", "deleted")) + " from kinds", more=hunk + snap),
        "unmapped_hunks": with_graph("select path, s as new_start from hunk where not exists (select 1 from symbols where path = file and greatest(n, o) > 0 and coalesce(start_line, end_line, 0) <= s + greatest(n, o) - 1 and coalesce(end_line, start_line, 0) >= s)", more=hunk),
        "changed_impact": with_graph("""
            , seed as (select id from symbols where type = 'interface' and id like '%00'), c as (select distinct from_id, to_id from edges where type = 'calls'),
            one as (select distinct from_id as id, to_id as origin from c where to_id in (select id from seed) and from_id not in (select id from seed)),
            two as (select distinct from_id as id, origin from c join one on one.id = to_id where from_id not in (select id from one) and from_id not in (select id from seed))
            select id, 1::bigint as depth, string_agg(origin, ' ' order by origin) as origins from one group by id union all select id, 2, string_agg(origin, ' ' order by origin) from two group by id"""),
        "graph_delta": with_graph("select change, kind, from_key, to_key from (select 'added' as change, * from (from a except from b) union all select 'removed', * from (from b except from a)) order by kind, from_key, to_key, change limit 1000", more=delta),
        "delta_summary": with_graph("select (select count(*) from (from a except from b)) as added, (select count(*) from (from b except from a)) as removed, (select count(*) from (from a intersect from b)) as unchanged", more=delta),
        "affected_tests": with_graph("""
            , s as materialized (select id, type, case when type = 'method' and regexp_matches(id, '[369]$') then file || '/tests/' || name else file end as file from symbols),
            same as (select id from s where file = (select file from s where id = 'interface:part/0000000001')),
            r(id, depth) as (select id, 0 from same union select from_id, depth + 1 from r join edges on to_id = r.id and edges.type in ('calls', 'imports', 'extends', 'implements', 'references') where depth < 3),
            m as (select id, min(depth) as depth from r group by id having min(depth) > 0),
            one(id, depth) as (select 'interface:part/0000000001', 0 union select from_id, depth + 1 from one join edges on to_id = one.id and edges.type in ('calls', 'imports', 'extends', 'implements', 'references') where depth < 3),
            both_ as (select id, min(depth) as depth from (select * from m union all select id, min(depth) from one group by id having min(depth) > 0) group by id),
            k as (select s.file, s.id, s.type, depth, case when s.type = 'file' then 'import_dependency' when depth = 1 and s.id in (select from_id from edges where type = 'calls' and to_id in (select id from same)) then 'direct_reference' else 'call_path' end as kind
                from both_ join s using (id) where s.file like '%/tests/%'),
            g as (select file, min(depth)::bigint as distance, min(case when kind <> 'call_path' then 0 when depth <= 2 then 1 else 2 end) as place, array_to_string(list_sort(list(distinct kind)), ' ') as kinds, array_to_string(list_sort(list(distinct id) filter (type <> 'file')), ' ') as test_symbols from k group by file)
            select file, distance, ['high', 'medium', 'low'][place + 1] as confidence, kinds, test_symbols, (select count(*) from g) > 100 as truncated from g order by place, distance, file limit 100""", True),
        "repository_status": """
            with c as (select doc_id::varchar as path, sha256(text) as h from documents where doc_id % 10 <> 0), i as (select doc_id::varchar as path, case when doc_id % 11 = 0 then 'other' else sha256(text) end as h from documents where doc_id % 7 <> 0)
            select path, case when i.h is null then 'new' when c.h is null then 'removed' when c.h = i.h then 'current' else 'changed' end as state from c full join i using (path)""",
        "policy_membership": with_graph(f"select distinct file, case when {group} is null then 'unclassified' else 'classified' end as state, {group} as \"group\" from symbols"),
        "policy_decisions": with_graph("""select case when gf is null or gt is null then 'unclassified' when (gf, gt) in (('region2', 'region3'), ('region4', 'region0')) then 'deny' else 'allow' end as action,
            case when gf = 'region2' and gt = 'region3' then 'no-2-3' when gf = 'region4' and gt = 'region0' then 'no-4-0' end as rule_id, count(*) as edges from e group by all""", more=pol),
        "architecture_drift": with_graph("select * from drift", True, pol + drift),
        "architecture_cycles": with_graph("select * from loops", True, pol + drift + loops),
        "change_gate": with_graph("select id, status, actual from checks", True, pol + drift + loops + checks),
        "gate_summary": with_graph("""
            select case when count(*) filter (status = 'fail') > 0 then 'fail' else 'pass' end as gate, count(*) filter (status = 'pass') as passed, count(*) filter (status = 'fail') as failed,
                count(*) filter (status = 'warn') as warnings, count(*) filter (status = 'skipped') as skipped from checks""", True, pol + drift + loops + checks),
        "reliability": f"""
            with c as (select user_id as scope_key, event_id % 11 as output_key, (event_id % 37 % 5)::int as o, event_id % 13 <> 0 as complete, event_id % 17 = 0 as stale, event_type <> 'error' as ap, event_type <> 'view' as su, value > 1 as tried from events),
            p as (select scope_key, output_key, max(o) as o, bool_and(complete and not stale) as complete, bool_or(stale) as stale, count(*) filter (ap) as ap, count(*) filter (su) as su, count(*) filter (tried) as tried_ from c group by all),
            s as (select scope_key, max(o) as o, bool_and(complete) as complete, bool_or(stale) as stale, sum(ap)::bigint as applicable, sum(su)::bigint as supported, sum(tried_)::bigint as attempted,
                count(*) filter (o = 0) as resolved, count(*) filter (o = 1) as unsupported, count(*) filter (o = 2) as unknown, count(*) filter (o = 3) as budget_exhausted, count(*) filter (o = 4) as ambiguous from p group by scope_key)
            select scope_key, ({outcomes})[o + 1] as outcome, complete, stale, complete and not stale and o = 0 as authoritative, complete and not stale and o = 0 as authoritative_negative, applicable, supported, attempted, resolved, unsupported, unknown, budget_exhausted, ambiguous from s""",
        "coverage_merge": "select event_type, " + ", ".join(f"sum(event_id % {i + 2})::bigint as {c}" for i, c in enumerate(reliability.COUNTERS)) + ", bool_or(event_id % 997 = 0) as may_be_incomplete from events group by event_type",
        "accepted_evidence": with_graph("""
            , k as (select from_id as key, right(to_id, 1) as v, to_id like '%1' or to_id like '%12' or to_id like '%2' as known from edges where type = 'implements'),
            n as (select key, count(distinct v) filter (known) as n, min(v) filter (known) as v from k group by key)
            select key, case when n = 1 then v end as value, case when n = 1 then 'accepted' when n > 1 then 'conflict' else 'unresolved' end as state from n"""),
        "list_entries": "select 'nest' as framework, 'route' as kind, o_orderkey::varchar as logical_key, case when o_orderkey % 8 = 0 then 2 when o_orderkey % 4 = 0 then 1 else 0 end::bigint as handlers, case when o_orderkey % 8 = 0 then 'ambiguous' when o_orderkey % 4 = 0 then 'bound' else 'unbound' end as state from orders where o_orderkey % 2 = 0",
        "policy_comparison": """
            with o as (select case when o_custkey % 2 = 0 then 'hit_' else 'tokens_' end || o_orderpriority as metric, sum(o_orderkey % 10)::bigint as value, sum(o_orderkey % 9)::bigint as base from orders group by 1)
            select metric, value, case when metric not like '%URGENT' then base end as baseline, case when metric like '%URGENT' then true when metric like 'hit%' then value >= base else value <= base * 1.1 end as passed from o""",
        "resolve_imports": """
            with e as (select distinct 'src/a' || (user_id % 9) || '/x.ts' as file, case when event_id % 2 = 0 then './' else '../lib/' end || 'm' || (user_id % 60) || case when event_id % 3 = 0 then '.js' else '' end as specifier from events),
            m as (select distinct user_id % 60 as m from events),
            f as (select 'src/lib/m' || m || case when m % 2 = 0 then '.ts' when m % 3 = 0 then '/index.tsx' else '.css' end as file from m union all select 'src/a3/m' || m || '.jsx' from m where m % 5 = 0),
            b as (select *, case when starts_with(specifier, './') then regexp_replace(file, 'x.ts$', '') || specifier[3:] else 'src/' || specifier[4:] end as base from e),
            c as (select file, specifier, unnest(case when ends_with(base, '.js') then [rtrim_js || x for x in ['.ts', '.tsx', '.js', '.jsx']] else [base || x for x in ['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']] end) as candidate,
                unnest(range(case when ends_with(base, '.js') then 4 else 8 end)) as nth from (select *, regexp_replace(base, '[.]js$', '') as rtrim_js from b)),
            t as (select c.file, c.specifier, arg_min(candidate, nth) as target from c join f on f.file = candidate group by all)
            select file, specifier, target from e left join t using (file, specifier)""",
        "plan_invalidation": with_graph("""
            , f as (select file as path from symbols where type = 'file'),
            gone as (select path from f where path like '%7' or path like '%8'), edited as (select path from f where path like '%03' ),
            imp as (select distinct a.file as importer, b.file as imported from edges e join symbols a on a.id = from_id join symbols b on b.id = to_id where e.type = 'imports'),
            r(path) as (select path from gone union select path from edited union select importer from imp join r on r.path = imported)
            select path, case when path in (select path from gone) then 'removed' when path in (select path from edited) then 'parse' when path in (select path from r) then 'resolve' else 'reuse' end as action from f
            union all select path || '-moved', 'renamed' from f where path like '%8'""", True),
        "coverage_gaps": f"{gap} select list_position({gaps}, kind)::bigint as place, kind, sum(count)::bigint as count, count(distinct file) as files from gap where count > 0 group by kind",
        "merge_gaps": f"{gap} select kind, case when kind in ('not_indexed', 'stale_index') then least(sum(count), 1) else sum(count) end::bigint as count from gap group by kind",
        "verification_targets": f"""{gap} select * from (select distinct file, '' as symbol_id, kind as reason from gap where count > 0
            union select distinct event_type, 's' || (event_id % 11), 'no indexed structural test evidence found' from events where event_type = 'error') order by file, symbol_id, reason limit 100""",
        "diagnostics_summary": f"{gap} select count(*) filter (count > 0) > 0 as may_be_incomplete, count(*) filter (count > 0) = 0 as authoritative_negative_results, count(distinct kind) filter (count > 0) as kinds from gap",
        "message_links": f"""{msg}, l as (select p.repo, p.id as producer, c.id as consumer from p left join c on c.repo = p.repo and c.kafka = p.kafka and c.destination = p.destination and c.kind = p.kind),
            r as (select repo, producer, 0 as step, 'producer' as record, null::varchar as consumer, case count(consumer) when 0 then 'none' when 1 then 'one' else 'many' end as cardinality from l group by all
                union all select repo, producer, 1, case when consumer is null then 'unlinked' else 'link' end, consumer, null from l),
            n as (select *, row_number() over (order by repo, producer, step, consumer) as place, count(*) over () > 1000 as truncated from r)
            select place, record, repo, producer, consumer, cardinality, truncated from n where place <= 1000""",
        "workspace_message_links": f"""{msg}, n as (select destination, kafka, kind, repo as there, count(*) as n from c group by all),
            j as (select p.repo, p.id as producer, p.proven, coalesce(sum(n) filter (there <> p.repo), 0)::bigint as matches from p left join n using (destination, kafka, kind) group by all)
            select repo, producer, matches, case when not proven then 'unknown' when matches = 0 then 'none' when matches = 1 then 'one' else 'many' end as cardinality from j""",
        "workspace_package_links": """
            with p as (select distinct 'repo' || (p_partkey % 5) as target_repo, lower(regexp_replace(p_brand || '-' || (p_partkey % 90), '[^A-Za-z0-9-]', '-', 'g')) as declared_name from part),
            d as (select distinct 'repo' || (s_suppkey % 6) as repo, case when s_suppkey % 2 = 0 then 'runtime' else 'dev' end as kind, 'brand-' || (s_suppkey % 30) || '-' || (s_suppkey % 90) as declared_name, s_suppkey % 7 <> 0 as ok from supplier),
            j as (select d.repo, d.declared_name, d.kind, d.ok, list(distinct target_repo) filter (d.ok and target_repo <> d.repo) as t from d left join p using (declared_name) group by all)
            select repo, declared_name, kind, case when len(t) = 1 then t[1] end as target_repo, case when not ok then 'unsupported' when coalesce(len(t), 0) = 0 then 'unmatched' when len(t) > 1 then 'ambiguous' else 'linked' end as state from j""",
        "direct_owner": with_graph("""
            , pt as (select distinct path || ':' || s || ':' || n as point_id, path as file, s, s + n - 1 as e from hunk where n > 0)
            select point_id, arg_min(id, (end_line - start_line, id)) as owner_id from pt join symbols x on x.file = pt.file and x.type <> 'file' and start_line <= s and end_line >= e group by point_id""", more=hunk),
        "call_decisions": with_graph("""
            , f as (select id, file, name from symbols where type = 'interface'), c as (select 'site:' || a.id as site_id, a.id like '%7' as un, list(b.id order by b.id) as t, 'lexical-local' as how from f a join f b on a.file = b.file and a.name = b.name group by all
                union all select 'use:' || a.file || ':' || k.id, false, [k.id], 'imports-exports' from edges e join symbols a on a.id = from_id join symbols b on b.id = to_id join symbols k on k.file = b.file and k.type = 'class' where e.type = 'imports')
            select site_id, case when un then 'unknown' when len(t) = 1 then 'resolved' else 'ambiguous' end as status, case when not un and len(t) = 1 then t[1] end as target, case when not un and len(t) = 1 then how end as strategy,
                case when not un and len(t) = 1 then 'exact' end as confidence, case when not un and len(t) > 1 then array_to_string(t, ' ') end as candidates, case when un then 'insufficient_evidence' when len(t) > 1 then 'multiple_candidates' end as reason from c"""),
        "workspace_map": with_graph("""
            , s as (select *, string_split(file, '/')[1] || '/' || string_split(file, '/')[2] as repo from symbols), e as (select repo, count(*) as edges from edges join s on s.id = from_id group by repo)
            select repo, count(*) filter (type = 'file') as files, count(*) filter (type <> 'file') as symbols, coalesce(any_value(edges), 0) as edges from s left join e using (repo) group by repo"""),
        "task_context_ranking": f"{_RANKED} select rank, subject, priority, round(signal, 9) as signal, tokens from ranked",
        "task_context_budget": f"""{_RANKED}, costed as (select rank, subject, priority, coalesce(tokens, {context.COST}) as cost from ranked),
            fold(rank, n, used, included) as (
                select 0::bigint, 0, 0::bigint, false union all
                select c.rank, n + t::int, used + case when t then cost else 0 end, t from (select c.*, f.n, f.used, c.priority = 'required' or (f.n < {context.ITEMS} and f.used + c.cost <= {context.TOKENS}) as t from fold f join costed c on c.rank = f.rank + 1) c)
            select f.rank, subject, included from fold f join ranked using (rank)""",
        "reexports": with_graph("""
            , f as (select distinct a.file as importer, b.file as imported from edges e join symbols a on a.id = from_id join symbols b on b.id = to_id where e.type = 'imports'),
            own as (select file, name, file as origin_file, name as origin_name from symbols where type = 'class'),
            r(file, name, origin_file, origin_name, hops) as (select *, 0 from own union select importer, name, origin_file, origin_name, hops + 1 from r join f on imported = file where hops < 12)
            select file, name, origin_file, origin_name, min(hops) as hops from r group by all""".replace("min(hops) as hops from r group by all", "min(hops) as hops from r group by file, name, origin_file, origin_name"), True),
        "scope_closure": with_graph("""
            select file, id as scope_id, id as ancestor_id, 0 as distance from symbols where type in ('file', 'function', 'method')
            union all select m.file, m.id, c.id, 1 from symbols m join symbols c on c.id = 'function:' || replace(split_part(m.qualified_name, '.orders', 1), '.', '/') where m.type = 'method'
            union all select c.file, c.id, f.id, case c.type when 'function' then 1 else 2 end from symbols c join symbols f on f.file = c.file and f.type = 'file' where c.type in ('function', 'method')"""),
        "innermost_bindings": with_graph("""
            , m as (select id, file, 'function:' || replace(split_part(qualified_name, '.orders', 1), '.', '/') as owner from symbols where type = 'method')
            select m.id as site_id, case when owner like '%0' then 'own:' || owner else 'file:' || m.file end as target from m"""),
        "inherited_calls": """
            with recursive m as (select c_custkey as c, (c_custkey // 7) % 3 as m from customer where c_custkey % 7 = 0),
            up(c, a, distance) as (select c_custkey, c_custkey // 2, 1 from customer where c_custkey > 1 union all select c, a // 2, distance + 1 from up where a > 1),
            o as (select o_orderkey as k, o_custkey as c, o_orderkey % 3 as m, o_orderkey % 5 = 0 as above from orders),
            f as (select k, a, o.m, distance from o join up using (c) join m on m.c = a and m.m = o.m where above or (o.c, o.m) not in (select (c, m) from m))
            select k::varchar as site_id, 'C' || arg_min(a, distance) || '.m' || any_value(m) as target from f group by k""",
        "member_calls": f"""
            with o as (select o_orderkey as k, 'f' || (o_custkey % 7) as file, 'C' || (o_custkey % 5) as owner_class, case when o_orderkey % 3 = 0 then 'this' else 'r' || (o_orderkey % 4) end as receiver, 'm' || (o_orderkey % 6) as method from orders),
            methods as (select * from (values {", ".join(f"('C{c}.m{m}', 'C{c}', 'm{m}')" for c in range(5) for m in range(6) if (c + m) % 4)}) v(id, class_name, name)),
            types as (select * from (values {", ".join(f"('f{f}', {owner}, 'r{r}', '{kind}', '{how}')" for f, owner, r, kind, how in _TYPES_SQL)}) v(file, owner_class, receiver, type_name, how)),
            found as (
                select k, owner_class as class_name, method, 'receiver-member' as strategy from o where receiver = 'this'
                union all select k, type_name, method, case how when 'declared' then 'explicit-type' when 'constructor' then 'constructor' when 'parameter' then 'parameter' else 'assignment' end from o join types t on t.file = o.file and t.receiver = o.receiver and (t.owner_class is null or t.owner_class = o.owner_class)),
            c as (select k, id as target, strategy, list_position({list(resolution.STRATEGIES)!r}, strategy) as place from found f join methods m on m.class_name = f.class_name and m.name = f.method),
            p as (select k, target, arg_min(strategy, (place, strategy)) as strategy from c group by all),
            n as (select k, count(*) as n, min(target) as target, arg_min(strategy, target) as strategy from p group by k)
            select k::varchar as site_id, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unknown' end as status, case when n = 1 then target end as target, case when n = 1 then strategy end as strategy from o left join n using (k)""",
    }


_RANKED = """
    with recursive v as (select lpad(conv_id::varchar, 8, '0') as subject, case when turn = 7 then 'explicit_anchor' when turn > 4 then 'graph' when turn % 2 = 0 then 'lexical' else 'semantic' end as kind, conv_id % 50 + turn + 1 as rank, turn = 3 as exact, (length(text) % 300 + 20)::bigint as tokens from conversations),
            k as (select subject, kind, min(rank) as rank, count(*) as pieces, bool_or(exact) as exact, max(tokens) as tokens from v group by all),
            s as (select subject, sum(pieces) as pieces, bool_or(exact) as exact, max(tokens) as tokens, round(list_sum(list(pieces / (60 + rank) order by kind)), 12) as signal,
                case when bool_or(kind = 'explicit_anchor') then 'required' when bool_or(kind = 'graph') then 'supporting' when sum(pieces) filter (kind in ('lexical', 'semantic')) > 1 then 'supporting' else 'optional' end as priority from k group by subject),
            ranked as (select row_number() over (order by case priority when 'required' then 0 when 'supporting' then 1 else 2 end, signal desc, exact desc, pieces desc, subject) as rank, subject, priority, signal, tokens from s)"""
