"""Strategies of call resolution on literal cases."""

from weftgraph.operators import resolution


def found(df):
    return {(r.site_id, r.target, r.strategy) for r in df.collect()}


METHODS = [("A.run", "A", "run"), ("B.run", "B", "run"), ("Base.stop", "Base", "stop"), ("Root.stop", "Root", "stop"), ("Root.go", "Root", "go")]


def test_types_flow_from_returns_and_aliases(spark):
    declared = spark.createDataFrame([("f", "K", "a", "A", "declared"), ("f", None, "x", "B", "constructor")], "file string, owner_class string, receiver string, type_name string, how string")
    calls = spark.createDataFrame([("f", None, "made", "make"), ("f", None, "odd", "either"), ("g", None, "far", "make")], "file string, owner_class string, receiver string, callee string")
    returns = spark.createDataFrame([("f", "make", "B"), ("f", "make", "B"), ("f", "either", "A"), ("f", "either", "B")], "file string, function string, type_name string")
    aliases = spark.createDataFrame([("f", "K", "also", "a"), ("f", None, "again", "made"), ("f", None, "lost", "a")], "file string, owner_class string, receiver string, of_name string")
    env = resolution.type_environment(declared, calls, returns, aliases)
    assert {tuple(r) for r in env.collect()} == {("f", "K", "a", "A", "declared"), ("f", None, "x", "B", "constructor"), ("f", None, "made", "B", "return"), ("f", "K", "also", "A", "alias"), ("f", None, "again", "B", "alias")}
    sites = spark.createDataFrame([("1", "f", "K", "also", "run"), ("2", "f", None, "made", "run"), ("3", "f", "L", "also", "run")], "site_id string, file string, owner_class string, receiver string, method string")
    methods = spark.createDataFrame(METHODS, "id string, class_name string, name string")
    assert found(resolution.member_candidates(sites, methods, env)) == {("1", "A.run", "alias"), ("2", "B.run", "return")}


def test_methods_are_inherited_from_the_nearest(spark):
    heritage = spark.createDataFrame([("A", "Base"), ("Base", "Root"), ("Root", "A"), ("B", "Root"), ("B", "Base")], "class_name string, parent string")
    methods = spark.createDataFrame(METHODS, "id string, class_name string, name string")
    sites = spark.createDataFrame([("1", "A", "this", "stop"), ("2", "A", "this", "go"), ("3", "A", "this", "run"), ("4", "A", "super", "run"), ("5", "B", "this", "stop"), ("6", "A", "other", "stop")], "site_id string, owner_class string, receiver string, method string")
    assert found(resolution.inherited_candidates(sites, methods, heritage)) == {("1", "Base.stop", "inheritance"), ("2", "Root.go", "inheritance"), ("5", "Base.stop", "inheritance"), ("5", "Root.stop", "inheritance")}
    assert {(r.ancestor, r.distance) for r in resolution.ancestors(heritage).filter("class_name = 'A'").collect()} == {("Base", 1), ("Root", 2)}


def test_aliases_and_chains(spark):
    symbols = spark.createDataFrame([("h1", "f", "helper", "function"), ("h2", "g", "other", "function")], "id string, file string, name string, type string")
    bindings = spark.createDataFrame([("f", "o", "g", "other")], "file string, local_name string, target_file string, imported_name string")
    sites = spark.createDataFrame([("1", "f", "short"), ("2", "f", "far"), ("3", "f", "helper")], "site_id string, file string, callee string")
    aliases = spark.createDataFrame([("f", "short", "helper"), ("f", "far", "o")], "file string, alias string, of_name string")
    assert found(resolution.alias_candidates(sites, aliases, symbols, bindings)) == {("1", "h1", "alias"), ("2", "h2", "alias")}
    chained = spark.createDataFrame([("1", "f", "make", "run"), ("2", "f", "either", "run")], "site_id string, file string, inner string, method string")
    returns = spark.createDataFrame([("f", "make", "B"), ("f", "either", "A"), ("f", "either", "B")], "file string, function string, type_name string")
    methods = spark.createDataFrame(METHODS, "id string, class_name string, name string")
    assert found(resolution.chained_candidates(chained, methods, returns)) == {("1", "B.run", "chained-call")}
