"""Retrieval, change, policy, resolution, context and sources on literal cases."""

import subprocess

import pytest

from weftgraph.model import CodeGraph
from weftgraph.operators import change, context, evaluation, policy, reliability, resolution, retrieval, workspace
from weftgraph.sources import generations, git_changes, repository
from weftgraph.streaming import sync

from test_graph import SYMBOLS, graph


def test_tokens_and_identifiers(spark):
    assert retrieval.query_tokens("where is the $userName_v2 used") == ["userName_v2"]
    assert retrieval.search_terms("parseHTTPBody2") == ["parsehttpbody2", "parse", "httpbody2"]
    df = spark.createDataFrame([("getUserName_v2",), ("",)], "n string")
    assert [r[0] for r in df.select(retrieval.identifier_parts(df.n)).collect()] == [["get", "user", "name", "v2"], []]


def test_fusion_shares_ranks_and_keeps_insertion(spark):
    v = spark.createDataFrame([("x", 1), ("y", 2)], "key string, rank long")
    lex = spark.createDataFrame([("y", 1, "g"), ("z", 2, "g")], "key string, rank long, rank_group string")
    got = retrieval.fused(v, lex).collect()
    assert [r.key for r in got] == ["y", "x", "z"] and got[2].lexical_rank == 1


def test_budget_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, 50), (2, 100), (3, 10)], "rank long, tokens long")
    # What is used counts twice: 50 + (50 + 1 + 10) for the last.
    assert [r.included for r in retrieval.greedy_budget(items, 111).orderBy("rank").collect()] == [True, False, True]
    assert [r.included for r in retrieval.greedy_budget(items, 110).orderBy("rank").collect()] == [True, False, False]


def test_bare_names_of_several_targets_are_ambiguous(spark):
    ddl = "document_id string, file string, symbol_name string, qualified_name string, symbol_type string, content string, start_line int, end_line int"
    docs = spark.createDataFrame([("1", "b.ts", "run", "b.run", "function", "x", 1, 9), ("2", "a.ts", "run", "a.run", "function", "y", 1, 9), ("3", "a.ts", "run", "a.run", "function", "z", 5, 20)], ddl)
    got = retrieval.lexical_search(docs, "run").collect()
    assert [r.document_id for r in got] == ["2", "3", "1"] and {r.score for r in got} == {0.0} and len({r.rank_group for r in got}) == 1
    assert retrieval.logical_targets(docs).count() == 2
    assert retrieval.lexical_search(docs, "the of").count() == 0 and retrieval.lexical_search(docs, "run", 5, "b").count() == 1


def test_vectors_of_other_lengths_are_skipped(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", [1.0, 1.0]), ("e", None)], "point_id string, vector array<float>")
    assert [r.point_id for r in retrieval.vector_search(v, [1.0, 0.0]).collect()] == ["a", "d"]
    assert retrieval.vector_search(v, [0.0, 0.0]).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a")], "case_id long, rank long, key string")
    judged = spark.createDataFrame([(1, "b", True), (1, "c", True), (1, "a", False), (2, "q", True)], "case_id long, key string, relevant boolean")
    rows = {r.case_id: r for r in evaluation.ranking_metrics(ranked, judged).collect()}
    assert (rows[1].hit_1, rows[1].hit_3, rows[1].mrr_5, rows[1].recall_5, rows[1].precision_5) == (0, 1, 0.5, 0.5, 0.5) and rows[2].recall_5 == 0 and rows[2].precision_5 is None


def symbols(spark, *rows):
    return spark.createDataFrame([(i, "function", n, None, f, s, e) for i, n, f, s, e in rows], SYMBOLS)


def test_changed_symbols_by_hunks(spark):
    before = symbols(spark, ("o1", "keep", "a.ts", 1, 5), ("o2", "gone", "a.ts", 6, 9), ("o3", "far", "old.ts", 1, 3))
    after = symbols(spark, ("n1", "keep", "a.ts", 1, 5), ("n2", "fresh", "a.ts", 6, 9), ("n3", "far", "new.ts", 1, 3))
    files = spark.createDataFrame([("a.ts", None, "modified"), ("new.ts", "old.ts", "renamed")], "path string, old_path string, status string")
    hunks = spark.createDataFrame([("a.ts", 5, 2, 5, 2), ("a.ts", 30, 0, 30, 0), ("new.ts", 1, 1, 1, 1)], "path string, old_start int, old_lines int, new_start int, new_lines int")
    got = sorted((r.id, r.change_kind) for r in change.changed_symbols(before, after, files, hunks).collect())
    assert got == [("n1", "modified"), ("n2", "added"), ("n3", "added"), ("o2", "deleted"), ("o3", "deleted")]
    assert [r.new_start for r in change.unmapped_hunks(before, after, files, hunks).collect()] == [30]
    row = change.change_summary(change.changed_symbols(before, after, files, hunks)).first()
    assert (row.modified, row.added, row.deleted) == (1, 2, 2)


def test_a_rename_changes_no_edge(spark):
    nodes = lambda f: [("a", "function", "run", None, f, 1, 2), ("b", "function", "stop", None, "lib.ts", 1, 2)]
    before, after = graph(spark, nodes("old.ts"), [("a", "b", "calls")]), graph(spark, nodes("new.ts"), [("a", "b", "calls")])
    renames = spark.createDataFrame([("old.ts", "new.ts")], "old_path string, path string")
    assert change.graph_delta(before, after, renames).count() == 0 and change.graph_delta(before, after).count() == 2
    assert tuple(change.delta_summary(before, after, renames).first()) == (0, 0, 1)
    with pytest.raises(ValueError):
        change.graph_delta(before, after, None, 0)


def test_affected_tests_by_evidence(spark):
    f = lambda i, file: (i, "function", i, None, file, 1, 2)
    g = graph(spark, [f("p", "src/p.ts"), f("q", "src/q.ts"), f("t1", "tests/t1.ts"), f("t2", "src/p.spec.ts"), f("t3", "test/t3.ts")], [("t1", "p", "calls"), ("q", "p", "calls"), ("t2", "q", "calls"), ("t3", "t2", "calls")])
    got = [(r.file, r.kinds[0], r.distance, r.confidence) for r in change.affected_tests(g, spark.createDataFrame([("p",)], "id string")).collect()]
    assert got == [("tests/t1.ts", "direct_reference", 1, "high"), ("src/p.spec.ts", "call_path", 2, "medium"), ("test/t3.ts", "call_path", 3, "low")]


def test_policies_are_checked():
    assert policy.glob_regex("src/**/a?.{ts}") == r"^src/(?:.*/)?a[^/]\.\{ts\}$".replace(r"\.\{", r"\.\{")
    good = {"groups": [{"id": "a", "include": ["a/**"]}, {"id": "b", "include": ["b/**"]}], "rules": [{"id": "r", "from": "a", "to": "b"}]}
    assert policy.parse_policy(good).rules[0].action == "deny"
    for bad in ({"nope": 1}, {**good, "rules": [{"id": "r", "from": "a", "to": "c"}]}, {**good, "rules": [*good["rules"], {"id": "s", "from": "a", "to": "b", "action": "allow"}]}, {"groups": [good["groups"][0]] * 2}):
        with pytest.raises(ValueError):
            policy.parse_policy(bad)


def test_drift_and_gate(spark):
    file = lambda i, f: (i, "file", f, None, f, None, None)
    nodes = [file("1", "a/x.ts"), file("2", "b/y.ts"), file("3", "c/z.ts"), file("4", "a/b/both.ts")]
    before, after = graph(spark, nodes, [("1", "2", "imports")]), graph(spark, nodes, [("1", "2", "imports"), ("2", "1", "imports"), ("1", "3", "imports"), ("1", "4", "imports")])
    groups = (policy.Group("a", ("a/**",)), policy.Group("b", ("b/**", "a/b/**")))
    p = policy.Policy(groups, (policy.Rule("ba", "b", "a", severity="high"),), cycles=True)
    found = policy.architecture_drift(before, after, p, p).collect()
    assert sorted((r.finding, r.status, r.cause, r.severity, r.rule_id) for r in found) == [("dependency_cycle", "introduced", "code_change", "medium", None), ("forbidden_dependency", "introduced", "code_change", "high", "ba")]
    states = {r.file: (r.state, r.group) for r in policy.membership(after.symbols, p).collect()}
    assert states == {"a/x.ts": ("classified", "a"), "b/y.ts": ("classified", "b"), "c/z.ts": ("unclassified", None), "a/b/both.ts": ("ambiguous", None)}
    facts = spark.createDataFrame([("unknown", 3, 0, 0, False)], "risk string, uncovered long, affected long, covered long, authoritative boolean")
    gaps = spark.createDataFrame([("parser_error", 2)], "kind string, count long")
    rules = policy.GatePolicy("medium", None, 5, 0.5, True, ("parser_error",), "high")
    checks = policy.change_gate(rules, facts, gaps, policy.architecture_drift(before, after, p, p))
    got = {r.id: r.status for r in checks.collect()}
    assert got == {"risk.allowUnknown": "fail", "risk.maxAllowed": "skipped", "tests.maxUncoveredAffectedSymbols": "pass", "tests.minStructuralTestEvidenceRatio": "skipped", "diagnostics.authoritativeNegativeResults": "fail", "diagnostics.forbidGapKinds": "fail", "architecture.introducedSeverity": "fail", "architecture.observations": "warn"}
    assert tuple(policy.gate_summary(checks).first()) == ("fail", 1, 4, 1, 2)


def test_worst_outcome_counts(spark):
    ddl = "scope_key string, output_key string, outcome string, complete boolean, stale boolean, applicable boolean, supported boolean, attempted boolean"
    rows = [("s", "o", "accepted", True, False, True, True, True), ("s", "o", "ambiguous", True, False, True, True, False), ("s", "p", "accepted", True, False, True, True, True), ("t", "o", "accepted", True, False, True, True, True)]
    got = {r.scope_key: r for r in reliability.aggregate_reliability(spark.createDataFrame(rows, ddl)).collect()}
    assert (got["s"].outcome, got["s"].resolved, got["s"].ambiguous, got["s"].authoritative) == ("ambiguous", 1, 1, False) and got["t"].authoritative_negative


def test_imports_try_candidates_in_order(spark):
    files = spark.createDataFrame([("src/a/b.tsx",), ("src/a/b.js",), ("src/lib/index.ts",), ("pkg/mod/__init__.py",)], "file string")
    rows = spark.createDataFrame([("src/a/x.ts", "./b.js", "typescript"), ("src/a/x.ts", "../lib", "typescript"), ("src/a/x.ts", "./none", "typescript"), ("pkg/use.py", ".mod", "python")], "file string, specifier string, language string")
    got = {r.specifier: r.target for r in resolution.resolve_imports(rows, files).collect()}
    assert got == {"./b.js": "src/a/b.tsx", "../lib": "src/lib/index.ts", "./none": None, ".mod": "pkg/mod/__init__.py"}


def test_unique_target_gate(spark):
    sites = spark.createDataFrame([(s, "python" if s != "u" else "cobol", s == "x") for s in "rambwuxz"[:8] if True], "site_id string, language string, uncertain boolean").dropDuplicates(["site_id"])
    ddl = "site_id string, target string, strategy string, confidence string, exhausted boolean"
    c = spark.createDataFrame([("r", "t", "lexical-local", "strong", False), ("r", "t", "imports-exports", "exact", False), ("a", "t", "alias", "strong", False), ("a", "u", "alias", "exact", False), ("w", "t", "alias", "weak", False), ("x", "t", "alias", "exact", False), ("b", "t", "alias", "exact", True)], ddl)
    got = {r.site_id: (r.status, r.target, r.strategy, r.reason) for r in resolution.decide(sites, c).collect()}
    assert got["r"] == ("resolved", "t", "imports-exports", None) and got["a"][0] == "ambiguous" and got["w"] == ("unknown", None, None, "weak_only")
    assert got["x"][3] == "insufficient_evidence" and got["u"][0] == "unsupported" and got["b"][0] == "budget_exhausted" and got["z"][3] == "unknown"


def test_calls_members_scopes_and_reexports(spark):
    s = spark.createDataFrame([("1", "lib.ts", "run", "function"), ("2", "a.ts", "run", "function"), ("3", "a.ts", "twice", "function"), ("4", "a.ts", "twice", "function")], "id string, file string, name string, type string")
    sites = spark.createDataFrame([("s1", "a.ts", "go"), ("s2", "a.ts", "run"), ("s3", "a.ts", "twice")], "site_id string, file string, callee string")
    bound = spark.createDataFrame([("a.ts", "go", "lib.ts", "run")], "file string, local_name string, target_file string, imported_name string")
    got = sorted((r.site_id, r.target, r.strategy) for r in resolution.call_candidates(sites, s, bound).collect())
    assert got == [("s1", "1", "imports-exports"), ("s2", "2", "lexical-local"), ("s3", "3", "lexical-local"), ("s3", "4", "lexical-local")]
    m = resolution.member_candidates(spark.createDataFrame([("m1", "a.ts", "A", "this", "f"), ("m2", "a.ts", "A", "dep", "g")], "site_id string, file string, owner_class string, receiver string, method string"), spark.createDataFrame([("A.f", "A", "f"), ("B.g", "B", "g")], "id string, class_name string, name string"), spark.createDataFrame([("a.ts", None, "dep", "B", "constructor")], "file string, owner_class string, receiver string, type_name string, how string"))
    assert sorted((r.site_id, r.target, r.strategy) for r in m.collect()) == [("m1", "A.f", "receiver-member"), ("m2", "B.g", "constructor")]
    closure = resolution.scope_closure(spark.createDataFrame([("f", "1", None), ("f", "2", "1"), ("f", "3", "2")], "file string, scope_id string, parent_id string"))
    near = resolution.innermost_binding(spark.createDataFrame([("s", "f", "3", "x")], "site_id string, file string, scope_id string, name string"), closure, spark.createDataFrame([("f", "1", "x", "outer"), ("f", "2", "x", "inner")], "file string, scope_id string, name string, target string"))
    assert closure.count() == 6 and near.first().target == "inner"
    ex = resolution.reexports(spark.createDataFrame([("a", "run", None, None), ("b", "go", "a", "run"), ("c", None, "b", None), ("a", "back", "c", "go"), ("a", "default", None, None), ("d", None, "a", None)], "file string, name string, source_file string, source_name string"))
    assert {("c", "go", "a", "run"), ("a", "back", "a", "run")} <= {(r.file, r.name, r.origin_file, r.origin_name) for r in ex.collect()} and not ex.filter("file = 'd' and name = 'default'").count()


def test_context_ranking_budget_and_delivery(spark):
    ddl = "subject string, kind string, rank long, exact boolean, tokens long"
    rows = [("anchor", "explicit_anchor", None, True, 5000), ("both", "lexical", 1, False, 10), ("both", "semantic", 2, False, 10), ("one", "lexical", 2, False, None), ("near", "graph", 1, False, 100)]
    ranked = context.ranked(context.merge_candidates(spark.createDataFrame(rows, ddl)))
    assert [(r.subject, r.priority) for r in ranked.orderBy("rank").collect()] == [("anchor", "required"), ("both", "supporting"), ("near", "supporting"), ("one", "optional")]
    assert [r.included for r in context.budgeted(ranked, 3, 5150).orderBy("rank").collect()] == [True, True, True, False]
    cols = "has_prior boolean, readable boolean, receipt_id string, state string, expires_at timestamp, now timestamp, identity_same boolean, selector_same boolean, content_same boolean, snapshot_id string, snapshot_same boolean, delta_available boolean, reconstruction_valid boolean"
    reads = spark.sql("select * from values (false,true,null,null,null,now(),true,true,true,null,true,true,true), (true,true,'r','active',null,now(),true,true,true,null,true,true,true), (true,true,'r','closed',null,now(),true,true,true,null,true,true,true), (true,true,'r','active',null,now(),true,true,false,'s',true,true,true), (true,true,'r','active',now() - interval 1 day,now(),true,true,true,'s',true,true,true) as t(" + ", ".join(c.split()[0] for c in cols.split(", ")) + ")")
    assert [(r.mode, r.reason) for r in context.delivery(reads).collect()] == [("full", "first_read"), ("unchanged", None), ("rehydrate", "receipt_not_active"), ("delta", None), ("rehydrate", "receipt_expired")]
    cycles = context.Lifecycles(10)
    task = cycles.start("Fix  it", 0)
    assert cycles.start("Fix it", 1) == task and cycles.refresh(task.identity, 1, 5).revision == 2
    for call in (lambda: cycles.close(task.identity, 1, 6), lambda: cycles.close(task.identity, 2, 99)):
        with pytest.raises(ValueError):
            call()


def test_links_between_repositories(spark):
    p = spark.createDataFrame([("a", "1", "topic", "literal", "x", "request", "nest", True), ("a", "2", "topic", "literal", "y", "request", "nest", True), ("a", "3", "topic", "literal", "x", "request", "nest", False)], "repo string, id string, protocol_kind string, destination_kind string, destination string, producer_kind string, framework string, proven boolean")
    c = spark.createDataFrame([("a", "4", "topic", "literal", "x", "request_response", "nest"), ("b", "5", "topic", "literal", "x", "request_response", "nest"), ("b", "6", "topic", "literal", "x", "event", "nest")], "repo string, id string, protocol_kind string, destination_kind string, destination string, consumer_kind string, framework string")
    assert {r.producer: r.cardinality for r in workspace.cross_message_links(p, c).collect()} == {"1": "one", "2": "none", "3": "unknown"}
    assert sorted((r.producer, r.consumer) for r in workspace.message_links(p, c).filter("record = 'link'").collect()) == [("1", "4"), ("3", "4")]
    e = spark.createDataFrame([("nest", "route", "k"), ("nest", "component", "c"), ("nest", "route", "j")], "framework string, kind string, logical_key string")
    r = spark.createDataFrame([("nest", "route", "k", "controller_route", "n1")], "framework string, kind string, logical_key string, relation_kind string, node_id string")
    assert [(x.logical_key, x.state) for x in workspace.list_entries(e, r).collect()] == [("j", "unbound"), ("k", "bound")]
    route = spark.range(1).select(workspace.route_key(*map(__import__("pyspark.sql.functions", fromlist=["lit"]).lit, ("nest", "get", "a//b"))).alias("k"))
    assert route.select(workspace.route_identity(route.k).alias("r")).first().r.path == "/a/b"


def test_scan_facts_and_git(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("import os\nclass A(Base):\n    def run(self, x: int):\n        return os.getcwd()\n")
    (tmp_path / "src/b.ts").write_text("import { x } from './c';\nconst y = require(\"../z\");\n")
    (tmp_path / "src/bad.py").write_text("def (")
    (tmp_path / "node_modules/n.js").write_text("x")
    files = repository.scan(spark, str(tmp_path))
    assert sorted((r.path, r.language) for r in files.collect()) == [("src/a.py", "python"), ("src/b.ts", "typescript"), ("src/bad.py", "python")]
    facts = {(r.kind, r.name, r.owner) for r in repository.extract_facts(files).collect()}
    assert {("class", "A", ""), ("method", "run", "A"), ("base", "Base", "A"), ("call", "os.getcwd", "A.run"), ("parameter", "x", "A.run"), ("parse_error", "", None), ("import", "os", "")} <= facts
    assert sorted(r.specifier for r in repository.module_specifiers(files).collect()) == ["../z", "./c"]
    assert repository.to_parse(files, files.filter("language = 'python'")).count() == 1
    assert repository.ignore_patterns("# x\ndist/\n*.log\n/top") == ["**/dist/**", "**/*.log", "**/*.log/**", "top", "top/**"]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b.c", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "src"), git("commit", "-qm", "one")
    (tmp_path / "src/b.ts").write_text("import { x } from './c';\nlet y = 1;\nlet z = 2;\n")
    git("mv", "src/a.py", "src/moved.py")
    changed, hunks = git_changes.read_changes(spark, str(tmp_path))
    rows = {r.path: r for r in changed.collect()}
    assert rows["src/b.ts"].status == "modified" and (rows["src/moved.py"].status, rows["src/moved.py"].old_path) == ("renamed", "src/a.py") and rows["node_modules/n.js"].status == "added"
    assert [tuple(r) for r in hunks.collect()] == [("src/b.ts", 2, 1, 2, 2)]
    first, _ = git_changes.read_changes(spark, str(tmp_path), "commit", "HEAD")
    assert {r.status for r in first.collect()} == {"added"} and git_changes.read_snapshot(spark, str(tmp_path)).count() == 3


def test_generations_and_stream(spark, tmp_path):
    store = generations.GenerationStore(spark, f"file://{tmp_path}/store")
    versions = lambda rows: spark.createDataFrame(rows, sync.FILE_VERSIONS)
    first = sync.sync_batch(store, versions([("a", "1", False, 1), ("b", "1", False, 1), ("a", "2", False, 2)]))
    assert store.active() == first and sorted((r.path, r.content) for r in store.read("files").collect()) == [("a", "2"), ("b", "1")]
    sync.sync_batch(store, versions([("a", "old", False, 1), ("b", None, True, 3), ("c", "1", False, 1)]))
    assert sorted((r.path, r.content) for r in store.read("files").collect()) == [("a", "2"), ("c", "1")]
    with pytest.raises(generations.Conflict):
        store.publish(store.candidate(), first)
    versions([("d", "1", False, 1)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(sync.FILE_VERSIONS).parquet(f"{tmp_path}/in")
    sync.sync_stream(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.path for r in store.read("files").collect()) == ["a", "c", "d"]


def test_every_rename_counts(spark):
    """More moved files than the 100,000 that were once read; each has one call."""
    n = 100_500
    ids = spark.range(n).selectExpr("cast(id as string) as id", "concat('old/', id, '.ts') as old_path", "concat('new/', id, '.ts') as path")
    side = lambda path: CodeGraph(ids.selectExpr("id", "'function' as type", "'f' as name", "cast(null as string) as qualified_name", f"{path} as file"), ids.selectExpr("id as from_id", "id as to_id", "'calls' as type"))
    row = change.delta_summary(side("old_path"), side("path"), ids.select("old_path", "path")).first()
    assert (row.added, row.removed, row.unchanged) == (0, 0, n)


def test_context_budget_judges_every_subject(spark):
    from weftgraph.plans import change_queries

    sf = "/root/testdata/sf0.1"
    rows = change_queries.queries()["task_context_budget"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() > 200


def test_whole_message_links_equal_their_sql(spark):
    """Every odd order consumes."""
    import duckdb
    from weftgraph.plans import change_queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{sf}/orders.parquet'")
    for name in ("message_links", "workspace_message_links"):
        got = change_queries.queries()[name](spark, sf)
        want = con.sql(change_queries.oracle_sql()[name])
        assert sorted(map(tuple, got.collect())) == sorted(want.project(", ".join(got.columns)).fetchall()) != []


def test_calls_of_one_name_are_decided_as_site_by_site(spark):
    names = spark.createDataFrame([(f"n{i}", "a.ts", "many", "function") for i in range(40)] + [("one", "a.ts", "single", "function"), ("far", "b.ts", "x", "class")], "id string, file string, name string, type string")
    sites = spark.createDataFrame([(f"s{i}", "a.ts", "many", "typescript", i % 7 == 0) for i in range(40)] + [("t", "a.ts", "single", "typescript", False), ("u", "a.ts", "far", "typescript", False), ("v", "a.ts", "none", "cobol", False), ("w", None, "single", "typescript", False)], "site_id string, file string, callee string, language string, uncertain boolean")
    bound = spark.createDataFrame([("a.ts", "far", "b.ts", "x")], "file string, local_name string, target_file string, imported_name string")
    got, want = resolution.decide_calls(sites, names, bound), resolution.decide(sites, resolution.call_candidates(sites, names, bound))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_query_writes_only_the_edges_it_reads(spark, sf, tmp_path):
    import __spark_entry__ as entry
    from weftgraph.plans import graph_queries

    (tmp_path / "sf").symlink_to(sf)
    written = lambda: {name for _, folder, name in graph_queries._INDEXED if folder == str(tmp_path / "sf")}
    entry.queries()["unmapped_hunks"](spark, str(tmp_path / "sf"))
    assert written() == {"symbols"}
    entry.queries()["call_decisions"](spark, str(tmp_path / "sf"))
    assert written() == {"symbols", "imports"}


def test_touched_rows_are_those_that_share_a_line(spark):
    import random

    pick = random.Random(5)
    make = lambda n, longest: [(pick.choice("abc"), lo := pick.randrange(6000), lo + pick.randrange(-1, longest), i) for i in range(n)]
    rows, spans = [*make(300, 20), *make(20, 4000), ("d", 1, 9000, 999)], [*make(60, 30), *make(2, 2500), ("d", 40, 40, 0)]
    ddl = "file string, lo int, hi int, i int"
    # A file of many rows and spans, which a join by the file alone would compare pair by pair: 900 million.
    many = spark.range(60_000).selectExpr("'big' as file", "cast(id as int) as lo", "cast(id + 5 as int) as hi", "cast(id + 5000 as int) as i")
    got = change.touching(spark.createDataFrame(rows, ddl).union(many), spark.createDataFrame(spans, ddl).drop("i").union(many.drop("i").filter("lo % 4 = 0 and lo >= 8000")))
    want = [r for r in rows if any(r[0] == s[0] and r[1] <= s[2] and r[2] >= s[1] for s in spans)]
    found = [tuple(r) for r in got.collect()]
    assert 50 < len(want) < len(rows) and sorted(r for r in found if r[0] != "big") == sorted(want)
    assert sorted(r[1] for r in found if r[0] == "big") == list(range(7995, 60_000))


def test_equal_hunks_stay_as_many(spark):
    at = symbols(spark, ("o1", "keep", "a.ts", 10, 15))
    files = spark.createDataFrame([("a.ts", None), ("new.ts", "a.ts")], "path string, old_path string")
    hunks = spark.createDataFrame([("a.ts", 3, 2, 3, 2)] * 3 + [("a.ts", 12, 0, 12, 2), ("new.ts", 15, 1, 900, 1), ("new.ts", 16, 0, 15, 0), ("x.ts", 1, 1, 1, 1)], "path string, old_start int, old_lines int, new_start int, new_lines int")
    got = change.unmapped_hunks(at, at, files, hunks).collect()
    assert sorted(map(tuple, got)) == [("a.ts", 3)] * 3 + [("new.ts", 15)]


def test_distances_keep_a_row_for_a_node_and_a_group(spark):
    f = lambda i, file: (i, "function", i, None, file, 1, 2)
    seeds, callers = [f"p{i}" for i in range(30)], [f"c{i}" for i in range(30)]
    g = graph(spark, [f(x, "src/p.ts") for x in seeds] + [f("hub", "src/q.ts")] + [f(x, "test/t.ts") for x in callers], [("hub", x, "calls") for x in seeds] + [(x, "hub", "references") for x in callers] + [("p1", "p0", "calls"), ("p0", "c3", "imports")])
    start = spark.createDataFrame([(x, "file") for x in seeds] + [("p0", "target")], "id string, origin string")
    got = sorted(map(tuple, change.distances(g, start, 3).collect()))
    want = [(x, "file", 0) for x in seeds] + [("p0", "target", 0), ("p1", "target", 1), ("hub", "file", 1), ("hub", "target", 1)] + [(x, o, 2) for x in callers for o in ("file", "target")]
    assert got == sorted(want)


def test_summary_of_a_file_of_many_hunks(spark):
    many = spark.range(20_000).selectExpr("concat('s', id) as id", "'function' as type", "concat('s', id) as name", "cast(null as string) as qualified_name", "'a.ts' as file", "cast(10 * id + 10 as int) as start_line", "cast(10 * id + 17 as int) as end_line")
    files = spark.createDataFrame([("a.ts", None, "modified")], "path string, old_path string, status string")
    hunks = spark.range(400_000).selectExpr("'a.ts' as path", "cast(1 + id % 500 as int) as old_start", "cast(id % 3 as int) as old_lines", "cast(1 + id % 500 as int) as new_start", "cast(id % 5 as int) as new_lines")
    row = change.change_summary(change.changed_symbols(many.filter("id not like '%7'"), many.filter("id not like '%9'"), files, hunks)).first()
    # Lines up to 504 are touched: s0 to s49; of these, five end in 7 and five in 9.
    assert tuple(row) == (1, 40, 5, 5)


def test_bridges_looked_at_first_are_the_best_of_all(spark, monkeypatch):
    import random

    from weftgraph.operators import intelligence

    pick = random.Random(3)
    nodes = [(f"n{i}", pick.choice(("function", "class")), f"n{i}", None, f"d{i % 9}/f.ts", 1, 2) for i in range(90)]
    g = graph(spark, nodes, sorted({(f"n{pick.randrange(90)}", f"n{int(90 * pick.random() ** 2)}", pick.choice(("calls", "implements", "references"))) for _ in range(300)}))
    areas = g.symbols.selectExpr("id", "concat('a', cast(substring(id, 2) as int) % 30) as community")
    every = intelligence.bridges(g, areas, 10_000).collect()
    monkeypatch.setattr(intelligence, "BRIDGE_EDGES", 1)
    assert len(every) > 40 and intelligence.bridges(g, areas, 7).collect() == every[:7]


def test_symbols_up_to_a_line_have_the_lines_of_all(spark, sf, monkeypatch):
    from weftgraph import model

    rows = model.star_rows(spark, sf).localCheckpoint()
    every = model.star_symbols(rows)
    # What doesn't read lines sorts nothing.
    assert "Window" not in every.select("id", "node_key")._jdf.queryExecution().optimizedPlan().toString()
    lines = every.collect()
    for head, lasts in ((6, (None, 505)), (9, (5, 10, 505, 1230, 10**6))):
        monkeypatch.setattr(model, "HEAD", head)
        for last in lasts:
            got = model.star_symbols_upto(rows, last).collect()
            assert sorted(map(str, got)) == sorted(str(r) for r in lines if r.type == "file" or last is not None and r.start_line <= last)


def test_unmapped_hunks_are_counted_once_and_copied(spark, sf, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(change, "COPIES", 7)
    at = symbols(spark, ("o1", "keep", "a.ts", 10, 15))
    files = spark.createDataFrame([("a.ts", None)] * 2, "path string, old_path string")
    hunks = spark.range(1000).selectExpr("'a.ts' as path", "cast(8 + id % 3 as int) as old_start", "1 as old_lines", "cast(8 + id % 3 as int) as new_start", "1 as new_lines")
    got = [tuple(r) for r in change.unmapped_hunks(at, at, files, hunks).collect()]
    assert sorted(got) == [("a.ts", 8)] * 668 + [("a.ts", 9)] * 666
    # The result is made from the distinct hunks: events aren't read and dealt out again for it.
    assert not [x for x in entry.queries()["unmapped_hunks"](spark, sf).inputFiles() if "events" in x]


def test_only_symbols_that_hunks_can_touch_are_looked_up(spark):
    many = spark.range(20_000).selectExpr("concat('s', id) as id", "'function' as type", "concat('s', id) as name", "cast(null as string) as qualified_name", "'a.ts' as file", "cast(10 * id + 10 as int) as start_line", "cast(10 * id + 17 as int) as end_line")
    files = spark.createDataFrame([("a.ts", None, "modified")], "path string, old_path string, status string")
    hunks = spark.range(40_000).selectExpr("'a.ts' as path", "cast(1 + id % 500 as int) as old_start", "cast(id % 3 as int) as old_lines", "cast(1 + id % 500 as int) as new_start", "cast(id % 5 as int) as new_lines")
    asked = []

    def tagged(rows):
        asked.append(rows.count())
        return rows.join(many.selectExpr("id", "substring(id, -1) as last"), "id", "left")

    both = change.Side(many, lambda last: many.filter(f"start_line <= {last}"), tagged)
    before, after = change.Side(many, both.upto, tagged, "last <> '7'"), change.Side(many, both.upto, tagged, "last <> '9'")
    row = change.change_summary(change.changed_symbols(before, after, files, hunks)).first()
    assert tuple(row) == (1, 40, 5, 5) and asked == [50, 45]
