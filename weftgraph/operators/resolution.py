"""From facts to decisions: imports, calls, members, re-exports, scopes, owners, and the unique-target gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.paths import basename, dirname, extension, normalize_path
from weftgraph.session import Scratch

# Strategies in their order and what they need; the capability levels of each language.
STRATEGIES = ("scip", "lexical-local", "imports-exports", "explicit-type", "constructor", "assignment", "parameter", "return", "alias", "inheritance", "receiver-member", "chained-call", "bounded-interprocedural")
NEEDS = {"scip": "directCall", "lexical-local": "localBinding", "imports-exports": "moduleImport", "explicit-type": "declaredType", "constructor": "constructorType", "assignment": "assignment", "parameter": "parameterFlow",
         "return": "returnFlow", "alias": "localBinding", "inheritance": "inheritance", "receiver-member": "receiverMember", "chained-call": "directCall", "bounded-interprocedural": "returnFlow"}
CAPABILITIES = ("moduleImport", "localBinding", "directCall", "declaredType", "constructorType", "receiverMember", "assignment", "parameterFlow", "returnFlow", "inheritance")
LEVELS = {
    "javascript": {"moduleImport": "full", "localBinding": "full", "directCall": "full", "declaredType": "full", "constructorType": "full", "receiverMember": "full", "assignment": "full", "parameterFlow": "full", "returnFlow": "full", "inheritance": "full"},
    "typescript": {"moduleImport": "full", "localBinding": "full", "directCall": "full", "declaredType": "full", "constructorType": "full", "receiverMember": "full", "assignment": "full", "parameterFlow": "full", "returnFlow": "full", "inheritance": "full"},
    "tsx": {"moduleImport": "full", "localBinding": "full", "directCall": "full", "declaredType": "full", "constructorType": "full", "receiverMember": "full", "assignment": "full", "parameterFlow": "full", "returnFlow": "full", "inheritance": "full"},
    "python": {"moduleImport": "full", "localBinding": "full", "directCall": "full", "declaredType": "full", "constructorType": "full", "receiverMember": "full", "assignment": "full", "parameterFlow": "full", "returnFlow": "full", "inheritance": "full"},
    "java": {"moduleImport": "full", "localBinding": "full", "directCall": "full", "declaredType": "full", "constructorType": "full", "receiverMember": "full", "assignment": "full", "parameterFlow": "full", "returnFlow": "full", "inheritance": "full"},
    "kotlin": {"moduleImport": "full", "localBinding": "full", "directCall": "partial", "declaredType": "full", "constructorType": "partial", "receiverMember": "partial", "assignment": "partial", "parameterFlow": "full", "returnFlow": "partial", "inheritance": "partial"},
    "go": {"moduleImport": "full", "localBinding": "full", "directCall": "full", "declaredType": "full", "constructorType": "full", "receiverMember": "full", "assignment": "partial", "parameterFlow": "full", "returnFlow": "partial", "inheritance": "unsupported"},
    "rust": {"moduleImport": "full", "localBinding": "full", "directCall": "full", "declaredType": "partial", "constructorType": "full", "receiverMember": "partial", "assignment": "full", "parameterFlow": "full", "returnFlow": "partial", "inheritance": "unsupported"},
    "swift": {"moduleImport": "partial", "localBinding": "full", "directCall": "partial", "declaredType": "partial", "constructorType": "partial", "receiverMember": "partial", "assignment": "partial", "parameterFlow": "partial", "returnFlow": "partial", "inheritance": "partial"},
    "dart": {"moduleImport": "partial", "localBinding": "full", "directCall": "partial", "declaredType": "full", "constructorType": "full", "receiverMember": "partial", "assignment": "partial", "parameterFlow": "partial", "returnFlow": "partial", "inheritance": "full"},
    "c": {"moduleImport": "partial", "localBinding": "full", "directCall": "full", "declaredType": "full", "constructorType": "partial", "receiverMember": "partial", "assignment": "full", "parameterFlow": "partial", "returnFlow": "partial", "inheritance": "partial"},
    "cpp": {"moduleImport": "partial", "localBinding": "full", "directCall": "partial", "declaredType": "partial", "constructorType": "partial", "receiverMember": "partial", "assignment": "partial", "parameterFlow": "partial", "returnFlow": "partial", "inheritance": "full"},
}
CONFIDENCE = ("weak", "strong", "exact")
REEXPORT_DEPTH = 12
CODE_EXTENSIONS = (".ts", ".tsx", ".jsx", ".mjs", ".cjs", ".json", ".css")


def capability_table(spark: SparkSession) -> DataFrame:
    """(language, capability, level): 120 rows."""
    return spark.createDataFrame([(language, c, levels[c]) for language, levels in LEVELS.items() for c in CAPABILITIES], "language string, capability string, level string")


def import_candidates(importer: Column, specifier: Column) -> Column:
    """The paths that a relative specifier may mean, in the order that they are tried."""
    base = normalize_path(F.concat_ws("/", dirname(importer), specifier))
    stem, ext = F.regexp_replace(base, r"\.[^./]*$", ""), extension(base)
    tails = (".ts", ".tsx", ".js", ".jsx")
    open_ = F.concat(F.when(ext != "", F.array(base)).otherwise(F.expr("cast(array() as array<string>)")), F.array(*[F.concat(base, F.lit(t)) for t in tails], *[F.concat(base, F.lit(f"/index{t}")) for t in tails]))
    return F.when(ext == ".js", F.array(*[F.concat(stem, F.lit(t)) for t in tails])).when(ext.isin(*CODE_EXTENSIONS), F.array(base)).otherwise(open_)


def language_candidates(importer: Column, specifier: Column, language: Column) -> Column:
    """The same for Python's dots, Kotlin's packages and Rust's paths."""
    here = dirname(normalize_path(importer))
    at = lambda tail: normalize_path(F.concat_ws("/", here, tail))
    bare = F.regexp_replace(specifier, r"^\.+", "")
    module = F.when(bare == "", F.regexp_replace(basename(importer), r"\.[^.]*$", "")).otherwise(bare)
    python = F.array(F.concat(at(module), F.lit(".py")), F.concat(at(module), F.lit("/__init__.py")))
    owner = lambda sep: F.filter(F.split(specifier, sep), lambda x: x != "")
    last_but_one = lambda xs: F.when(F.size(xs) >= 2, F.element_at(xs, F.greatest(F.size(xs) - 1, F.lit(1)))).otherwise(F.get(xs, F.lit(0)))
    kotlin = F.array(at(F.concat(F.lower(last_but_one(owner(r"\."))), F.lit(".kt"))))
    rust = F.array(at(F.concat(last_but_one(owner("::")), F.lit(".rs"))), at(F.concat(last_but_one(owner("::")), F.lit("/mod.rs"))))
    return F.when((language == "python") & specifier.startswith("."), python).when(language == "kotlin", kotlin).when(language == "rust", rust).otherwise(import_candidates(importer, specifier))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier) with target: the first candidate that is a file, null if none is. Columns: file, specifier, optionally language."""
    language = F.col("language") if "language" in imports.columns else F.lit("typescript")
    keys = imports.select("file", "specifier", language.alias("language")).distinct()
    tried = keys.select("file", "specifier", F.posexplode(language_candidates(F.col("file"), F.col("specifier"), F.col("language"))).alias("nth", "candidate"))
    found = tried.join(files.select(F.col("file").alias("candidate")).distinct(), "candidate").groupBy("file", "specifier").agg(F.min_by("candidate", "nth").alias("target"))
    return keys.select("file", "specifier").join(found, ["file", "specifier"], "left")


def reexports(exports: DataFrame, limit: int = REEXPORT_DEPTH) -> DataFrame:
    """(file, name, origin_file, origin_name, hops) of every exported name, chased over named and star re-exports.

    exports: file, name (null for a star), source_file (null for an own name), source_name. Rounds are bounded; cycles end because a
    name is expanded once for each file. A name with several origins has several rows: the gate calls it ambiguous.
    """
    scratch = Scratch(exports.sparkSession, "reexports")
    own = exports.filter("source_file is null").select("file", "name", F.col("file").alias("origin_file"), F.col("name").alias("origin_name"), F.lit(0).alias("hops"))
    via = scratch.save(exports.filter("source_file is not null").select(F.col("file").alias("via_file"), F.col("name").alias("via_name"), F.col("source_file").alias("file"), F.col("source_name").alias("wanted")))
    known = frontier = scratch.save(own.distinct())
    for hop in range(1, limit + 1):
        step = via.join(frontier, "file").filter(F.col("wanted").isNull() | (F.col("wanted") == F.col("name")))
        step = step.filter(F.col("wanted").isNotNull() | (F.col("name") != "default"))
        new = step.select(F.col("via_file").alias("file"), F.coalesce("via_name", F.when(F.col("wanted").isNull(), F.col("name")).otherwise(F.col("wanted"))).alias("name"), "origin_file", "origin_name", F.lit(hop).alias("hops"))
        key = ["file", "name", "origin_file", "origin_name"]
        frontier = scratch.save(new.dropDuplicates(key).join(known.select(*key), key, "left_anti"))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def scope_closure(scopes: DataFrame, depth: int = 64) -> DataFrame:
    """(file, scope_id, ancestor_id, distance), a scope being its own ancestor at 0. scopes: file, scope_id, parent_id."""
    scratch = Scratch(scopes.sparkSession, "scopes")
    parents = scratch.save(scopes.filter("parent_id is not null").select("file", F.col("scope_id").alias("ancestor_id"), "parent_id"))
    known = frontier = scratch.save(scopes.select("file", "scope_id", F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("distance")))
    for distance in range(1, depth + 1):
        frontier = scratch.save(frontier.join(parents, ["file", "ancestor_id"]).select("file", "scope_id", F.col("parent_id").alias("ancestor_id"), F.lit(distance).alias("distance")))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def innermost_binding(sites: DataFrame, closure: DataFrame, bindings: DataFrame) -> DataFrame:
    """site_id, target of the nearest enclosing scope with a binding of the name. sites: site_id, file, scope_id, name; bindings: file, scope_id, name, target."""
    up = sites.join(closure, ["file", "scope_id"]).select("site_id", "file", F.col("ancestor_id").alias("scope_id"), "name", "distance")
    return up.join(bindings, ["file", "scope_id", "name"]).groupBy("site_id").agg(F.min_by("target", F.struct("distance", "target")).alias("target"))


def direct_owner(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """point_id, owner_id: the smallest symbol of the point's file whose lines hold the point's (start, end).

    An equi-join on the file with containment as its condition; ties go to the first id.
    """
    s = symbols.select("file", F.col("id").alias("owner_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    p = points.select("point_id", "file", F.col("start_line").alias("ps"), F.col("end_line").alias("pe"))
    held = p.join(s, "file").filter("s <= ps and e >= pe and owner_id <> point_id")
    return held.groupBy("point_id").agg(F.min_by("owner_id", F.struct(F.col("e") - F.col("s"), "owner_id")).alias("owner_id"))


def call_candidates(sites: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(site_id, target, strategy, confidence) of bare calls: by import binding to its file and name, else by name in the same file.

    sites: site_id, file, callee. bindings: file, local_name, target_file, imported_name. symbols: id, file, name, type.
    """
    callable_ = symbols.filter("type in ('function', 'class', 'method', 'variable')").select(F.col("id").alias("target"), F.col("file").alias("target_file"), F.col("name").alias("imported_name"))
    bound = sites.join(bindings.select("file", F.col("local_name").alias("callee"), "target_file", "imported_name"), ["file", "callee"])
    imported = bound.join(callable_, ["target_file", "imported_name"]).select("site_id", "target", F.lit("imports-exports").alias("strategy"), F.lit("exact").alias("confidence"))
    rest = sites.join(bound.select("site_id").distinct(), "site_id", "left_anti")
    local = rest.join(callable_.select(F.col("target_file").alias("file"), F.col("imported_name").alias("callee"), "target"), ["file", "callee"]).select("site_id", "target", F.lit("lexical-local").alias("strategy"), F.lit("exact").alias("confidence"))
    return imported.union(local)


def member_candidates(sites: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """(site_id, target, strategy, confidence) of `receiver.method` calls.

    sites: site_id, file, owner_class, receiver (`this`, a field or a local name), method. methods: id, class_name, name.
    types: file, owner_class (null: any), receiver, type_name, how (declared, constructor, parameter, assignment, return, alias).
    """
    own = sites.filter("receiver = 'this'").select("site_id", F.col("owner_class").alias("class_name"), F.col("method").alias("name"), F.lit("receiver-member").alias("strategy"))
    t = types.select("file", F.col("owner_class").alias("of_class"), "receiver", "type_name", "how")
    typed = sites.join(t, ["file", "receiver"]).filter("of_class is null or of_class = owner_class")
    how = F.when(F.col("how") == "declared", "explicit-type").when(F.col("how") == "constructor", "constructor").when(F.col("how").isin("parameter", "return", "alias"), F.col("how")).otherwise("assignment")
    typed = typed.select("site_id", F.col("type_name").alias("class_name"), F.col("method").alias("name"), how.alias("strategy"))
    return own.union(typed).join(methods.select("class_name", "name", F.col("id").alias("target")), ["class_name", "name"]).select("site_id", "target", "strategy", F.lit("strong").alias("confidence"))


HERITAGE_DEPTH = 32


def type_environment(declared: DataFrame, calls: DataFrame, returns: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file, owner_class, receiver, type_name, how): what is known of the types of names, as `member_candidates` takes it.

    declared: file, owner_class, receiver, type_name, how (declared, constructor, parameter, assignment). calls: file, owner_class,
    receiver, callee: names that hold a call's result, of the type that its one function returns (how: return). returns: file, function,
    type_name. aliases: file, owner_class, receiver, of_name: names for another name of the same file and class, whose types they share
    (how: alias; one step). A function name with several return types in its file gives none.
    """
    one = returns.groupBy("file", F.col("function").alias("callee")).agg(F.count_distinct("type_name").alias("n"), F.min("type_name").alias("type_name")).filter("n = 1").drop("n")
    columns = ["file", "owner_class", "receiver", "type_name", "how"]
    known = declared.select(*columns).union(calls.join(one, ["file", "callee"]).withColumn("how", F.lit("return")).select(*columns))
    named = aliases.select("file", F.col("owner_class").alias("of_class"), F.col("receiver").alias("alias"), F.col("of_name").alias("receiver"))
    shared = known.join(named, ["file", "receiver"]).filter(F.col("owner_class").eqNullSafe(F.col("of_class")) | F.col("owner_class").isNull())
    return known.union(shared.select("file", F.col("of_class").alias("owner_class"), F.col("alias").alias("receiver"), "type_name", F.lit("alias").alias("how"))).distinct()


def ancestors(heritage: DataFrame, depth: int = HERITAGE_DEPTH) -> DataFrame:
    """(class_name, ancestor, distance), least distances. heritage: class_name, parent. Cycles end because a pair is found once."""
    scratch = Scratch(heritage.sparkSession, "ancestors")
    up = scratch.save(heritage.filter("class_name <> parent").select("class_name", "parent").distinct())
    known = frontier = scratch.save(up.select("class_name", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    for distance in range(2, depth + 1):
        new = frontier.select("class_name", F.col("ancestor").alias("via")).join(up.select(F.col("class_name").alias("via"), F.col("parent").alias("ancestor")), "via")
        new = new.filter("class_name <> ancestor").select("class_name", "ancestor", F.lit(distance).alias("distance")).distinct()
        frontier = scratch.save(new.join(known.select("class_name", "ancestor"), ["class_name", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def inherited_candidates(sites: DataFrame, methods: DataFrame, heritage: DataFrame) -> DataFrame:
    """(site_id, target, strategy, confidence) of `this.method` calls that the own class hasn't: the method of the nearest ancestors that have it.

    sites: site_id, owner_class, receiver, method. Several ancestors at one distance give several candidates.
    """
    own = sites.filter("receiver = 'this' or receiver = 'super'").select("site_id", F.col("owner_class").alias("class_name"), "receiver", F.col("method").alias("name"))
    missing = own.filter("receiver = 'super'").union(own.filter("receiver = 'this'").join(methods.select("class_name", "name"), ["class_name", "name"], "left_anti").select(*own.columns))
    above = missing.join(ancestors(heritage), "class_name").join(methods.select(F.col("class_name").alias("ancestor"), "name", F.col("id").alias("target")), ["ancestor", "name"])
    nearest = above.groupBy("site_id").agg(F.min("distance").alias("distance"))
    return above.join(nearest, ["site_id", "distance"]).select("site_id", "target", F.lit("inheritance").alias("strategy"), F.lit("strong").alias("confidence")).distinct()


def alias_candidates(sites: DataFrame, aliases: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(site_id, target, strategy, confidence) of bare calls of a name that stands for another one in its file. aliases: file, alias, of_name."""
    renamed = sites.join(aliases.select("file", F.col("alias").alias("callee"), "of_name"), ["file", "callee"]).select("site_id", "file", F.col("of_name").alias("callee")).distinct()
    return call_candidates(renamed, symbols, bindings).select("site_id", "target", F.lit("alias").alias("strategy"), F.lit("strong").alias("confidence"))


def chained_candidates(sites: DataFrame, methods: DataFrame, returns: DataFrame) -> DataFrame:
    """(site_id, target, strategy, confidence) of `inner().method` calls: the method of the type that the one inner function of the file returns.

    sites: site_id, file, inner, method. returns: file, function, type_name.
    """
    one = returns.groupBy("file", F.col("function").alias("inner")).agg(F.count_distinct("type_name").alias("n"), F.min("type_name").alias("class_name")).filter("n = 1")
    found = sites.join(one.drop("n"), ["file", "inner"]).withColumnRenamed("method", "name").join(methods.select("class_name", "name", F.col("id").alias("target")), ["class_name", "name"])
    return found.select("site_id", "target", F.lit("chained-call").alias("strategy"), F.lit("strong").alias("confidence"))


def within_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` candidates of each site in order of strategy and target, with exhausted where there were more."""
    order = Window.partitionBy("site_id").orderBy(F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy")), "target")
    rows = candidates.withColumn("nth", F.row_number().over(order))
    over = candidates.groupBy("site_id").agg((F.count(F.lit(1)) > budget).alias("exhausted"))
    return rows.filter(F.col("nth") <= budget).drop("nth").join(over, "site_id")


def _gathered(candidates: DataFrame) -> DataFrame:
    """site_id, accepted, one, targets, exhausted: a site's candidates as one row."""
    level = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence")).cast("int")
    place = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy")).cast("int")
    exhausted = F.bool_or("exhausted") if "exhausted" in candidates.columns else F.lit(False)
    merged = candidates.groupBy("site_id", "target").agg(F.max(level).alias("level"), F.min(F.struct(-level, place, "strategy"))["strategy"].alias("strategy"), exhausted.alias("exhausted"))
    return merged.groupBy("site_id").agg(F.count_if(F.col("level") > 1).alias("accepted"), F.min(F.when(F.col("level") > 1, F.struct("target", "strategy", "level"))).alias("one"), F.sort_array(F.collect_set(F.when(F.col("level") > 1, F.col("target")))).alias("targets"), F.bool_or("exhausted").alias("exhausted"))


def decide(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """site_id, status, target, strategy, confidence, candidates, reason: one accepted target resolves, several never do.

    sites: site_id, language, uncertain (parse trouble). Candidates of one target merge: the best confidence and the earliest strategy
    with it. Weak ones alone don't resolve. The ladder: uncertainty, exhausted budget, one, several, weak only, unsupported, unknown.
    """
    return _decided(sites.join(_gathered(candidates), "site_id", "left"))


def decide_calls(sites: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """What decide(sites, call_candidates(sites, symbols, bindings)) gives, the candidates of a name gathered once for all sites of its file.

    Candidates depend on the file and the name only, so rows between are as many as names and candidates, not as their pairs with sites.
    """
    call = F.struct("file", "callee")
    asked = sites.select(call.alias("site_id"), "file", "callee").distinct()
    found = _gathered(call_candidates(asked, symbols, bindings)).select(F.col("site_id.file").alias("file"), F.col("site_id.callee").alias("callee"), "accepted", "one", "targets", "exhausted")
    return _decided(sites.join(found, ["file", "callee"], "left"))


def _decided(sites: DataFrame) -> DataFrame:
    """The ladder of `decide` over sites with what was gathered for each."""
    known = list(LEVELS)
    rows = sites.withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    some = F.col("one").isNotNull() | F.col("targets").isNotNull()
    status = (
        F.when(F.col("uncertain"), "unknown").when(F.coalesce("exhausted", F.lit(False)), "budget_exhausted").when(F.col("accepted") == 1, "resolved").when(F.col("accepted") > 1, "ambiguous")
        .when(~some & ~F.col("language").isin(*known), "unsupported").otherwise("unknown"))
    reason = F.when(F.col("uncertain"), "insufficient_evidence").when(status == "budget_exhausted", "budget_exhausted").when(status == "ambiguous", "multiple_candidates").when(status == "unsupported", "language_capability_unsupported").when(status == "unknown", F.when(some, "weak_only").otherwise("unknown"))
    resolved = status == "resolved"
    return rows.select("site_id", status.alias("status"), F.when(resolved, F.col("one.target")).alias("target"), F.when(resolved, F.col("one.strategy")).alias("strategy"), F.when(resolved, F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("one.level"))).alias("confidence"), F.when(status == "ambiguous", F.col("targets")).alias("candidates"), reason.alias("reason"))


def supported(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidates whose strategy the site's language supports; partial support makes them weak where they were strong."""
    spark = candidates.sparkSession
    needs = spark.createDataFrame([(s, c) for s, c in NEEDS.items()], "strategy string, capability string")
    table = capability_table(spark).join(needs, "capability").select("language", "strategy", "level")
    rows = candidates.join(sites.select("site_id", "language"), "site_id").join(F.broadcast(table), ["language", "strategy"]).filter("level <> 'unsupported'")
    return rows.withColumn("confidence", F.when((F.col("level") == "partial") & (F.col("confidence") == "strong"), "weak").otherwise(F.col("confidence"))).select(*candidates.columns)


def resolve_extends(heritage: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """(child_id, target) where exactly one class or interface is meant. heritage: child_id, file, parent_name, relation."""
    kinds = symbols.filter("type in ('class', 'interface')")
    sites = heritage.select(F.concat_ws("\0", "child_id", "parent_name").alias("site_id"), "file", F.col("parent_name").alias("callee"), "child_id", "relation")
    found = call_candidates(sites, kinds, bindings).groupBy("site_id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1")
    return sites.join(found, "site_id").select("child_id", "target", "relation")


class IdentityCollision(ValueError):
    """Several symbols have one identity."""


def assemble(files: DataFrame, symbols: DataFrame, imports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols and edges of a graph from facts: file nodes, contained symbols, resolved imports, decided calls.

    Identities must be unique: symbols that share one are an error that names some of them, as a graph without them would be another graph.
    """
    twice = symbols.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("id").limit(5).collect()
    if twice:
        raise IdentityCollision("symbols share an identity: " + ", ".join(r.id for r in twice))
    node = files.select(F.concat(F.lit("file:"), "file").alias("id"), F.lit("file").alias("type"), F.col("file").alias("name"), F.lit(None).cast("string").alias("qualified_name"), "file", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")).distinct()
    clear = symbols.select(*node.columns)
    nodes = node.union(clear)
    contains = clear.select(F.concat(F.lit("file:"), "file").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("type"))
    imported = imports.filter("target is not null").select(F.concat(F.lit("file:"), "file").alias("from_id"), F.concat(F.lit("file:"), "target").alias("to_id"), F.lit("imports").alias("type"))
    calls = decisions.filter("status = 'resolved'").select(F.col("caller_id").alias("from_id"), F.col("target").alias("to_id"), F.lit("calls").alias("type"))
    edges = contains.union(imported).union(calls).distinct()
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select("from_id", "to_id", "type")


def rebind(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends moved by (old_id, new_id); ends that aren't in the mapping stay."""
    a = mapping.select(F.col("old_id").alias("from_id"), F.col("new_id").alias("new_from"))
    b = mapping.select(F.col("old_id").alias("to_id"), F.col("new_id").alias("new_to"))
    return edges.join(a, "from_id", "left").join(b, "to_id", "left").select(F.coalesce("new_from", "from_id").alias("from_id"), F.coalesce("new_to", "to_id").alias("to_id"), "type").distinct()
