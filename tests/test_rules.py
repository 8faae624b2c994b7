"""Rules of retrieval, message links, traces and affected tests against plain versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftgraph.model import code_graph
from weftgraph.operators import change, intelligence, retrieval, traverse, workspace

DOCS = "document_id string, file string, symbol_name string, qualified_name string, symbol_type string, content string, start_line int, end_line int"


def test_bare_identifiers_group_what_they_name(spark):
    docs = spark.createDataFrame([
        ("1", "a.ts", "run", "A.run", "method", "x", 1, 5), ("2", "b.ts", "run", "B.run", "method", "y", 1, 5), ("3", "c.ts", "walk", "C.walk", "method", "run away", 1, 5), ("4", "b.ts", "$run", "run", "function", "", 9, 9),
    ], DOCS)
    got = {r.document_id: (r.score, r.rank_group) for r in retrieval.lexical_search(docs, "run").collect()}
    assert got == {"1": (0.0, "bare-exact:run"), "2": (0.0, "bare-exact:run"), "3": (0.0, None), "4": (0.0, "bare-exact:run")}
    alone = {r.document_id: r.rank_group for r in retrieval.lexical_search(docs, "run", file_prefix="a").collect()}
    assert alone == {"1": None}
    assert retrieval.bare_identifier(" $Run ") == "run" and retrieval.bare_identifier("run it") is None and retrieval.bare_identifier("9a") is None


def test_owners_that_a_query_names_alike_share_a_rank(spark):
    docs = spark.createDataFrame([(str(i), f"{o}.ts", "save", f"{o}.save", "method", "", 1, 2) for i, o in enumerate(["UserStore", "UserCache", "Order", "user"])] + [("9", "x.ts", "save", "UserBox.save", "function", "", 1, 2)], DOCS)
    groups = {r.document_id: r.rank_group for r in retrieval.lexical_search(docs, "user save").collect()}
    assert groups["0"] == groups["1"] is not None and groups["2"] is None and groups["9"] is None


def test_budget_counts_the_rendered_prefix(spark):
    draw = random.Random(3)
    rows = [(i, f"doc{i}", f"f {i}.ts", "s", "method", " ".join("w" for _ in range(draw.randrange(0, 60))), 1, 2, 0.5) for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "rank long, document_id string, file string, symbol_name string, symbol_type string, content string, start_line int, end_line int, score double")
    block = retrieval.token_count(retrieval.context_block(F.lit(1), F.col("score")))
    got = {r["rank"]: (r.tokens, r.included) for r in retrieval.greedy_budget(docs.select("rank", block.alias("tokens")), 400).collect()}
    render = lambda chosen: "\n\n---\n\n".join(f"## Context {k}\nFile: {f}\nSymbol: {s}\nType: {t}\nLines: {a}-{b}\nScore: {x:.4f}\n\n{c}" for k, (_, _, f, s, t, c, a, b, x) in enumerate(chosen, 1))
    chosen, used, want = [], 0, {}
    for row in rows:
        tokens = len(render([*chosen, row]).split())
        want[row[0]] = (tokens, used + tokens <= 400)
        if want[row[0]][1]:
            chosen.append(row)
            used = tokens
    assert got == want and 1 < len(chosen) < 29
    assert retrieval.rendered_context(docs.filter(F.col("rank").isin([r[0] for r in chosen]))).first().context == render(chosen)


def test_inspection_reranks_and_adds_related(spark):
    docs = spark.createDataFrame([(f"d{i}", f"f{i}.ts", "run" if i < 3 else "x", f"q{i}", "function", "run " * (i + 1), 1, 2) for i in range(6)], DOCS)
    vectors = spark.createDataFrame([("d4", [1.0, 0.0]), ("d0", [0.9, 0.1])], "point_id string, vector array<double>")
    plain = {r.key: r for r in retrieval.inspect_retrieval(docs, vectors, "run it", [1.0, 0.0], top_k=4).collect()}
    assert len(plain) == 4 and all(r.place == r.fused_rank for r in plain.values()) and plain["d0"].sources == ["vector", "lexical"]
    last = max(plain.values(), key=lambda r: r.fused_rank).key
    scores = spark.createDataFrame([(last, 0.9)], "key string, rerank_score double")
    related = spark.createDataFrame([("d5", 1), ("d0", 2)], "key string, nth long")
    got = {r.key: r for r in retrieval.inspect_retrieval(docs, vectors, "run it", [1.0, 0.0], 4, 4, 4000, scores, related).collect()}
    assert got[last].place == 1 and got["d5"].place == 5 and got["d5"].sources == ["graph"] and got["d0"].sources == ["vector", "lexical", "graph"] and len(got) == 5


def test_message_kinds_and_the_record_budget(spark):
    p = spark.createDataFrame([("p1", "r", "kafka", "literal", "t", "request"), ("p2", "r", "unspecified", "literal", "t", "event"), ("p3", "r", "unspecified", "literal", "t", "request"), ("p4", "r", "unspecified", "literal", "none", "request")], "id string, repo string, protocol_kind string, destination_kind string, destination string, producer_kind string")
    c = spark.createDataFrame([("c1", "r", "kafka", "literal", "t", "event"), ("c2", "r", "unspecified", "literal", "t", "event"), ("c3", "r", "unspecified", "literal", "t", "request_response"), ("c4", "r", "unspecified", "literal", "t", "event")], "id string, repo string, protocol_kind string, destination_kind string, destination string, consumer_kind string")
    rows = [(r.record, r.producer, r.consumer, r.cardinality) for r in workspace.message_links(p, c).orderBy("place").collect()]
    assert rows == [("producer", "p1", None, "one"), ("link", "p1", "c1", None), ("producer", "p2", None, "many"), ("link", "p2", "c2", None), ("link", "p2", "c4", None), ("producer", "p3", None, "one"), ("link", "p3", "c3", None), ("producer", "p4", None, "none"), ("unlinked", "p4", None, None)]
    cut = workspace.message_links(p, c, 4).orderBy("place").collect()
    assert [(r.record, r.producer, r.consumer, r.cardinality) for r in cut] == rows[:4] and all(r.truncated for r in cut)
    assert not workspace.message_links(p, c, 9).first().truncated


def graph_of(spark, n, edges):
    symbols = spark.createDataFrame([(f"n{i:03d}", "function", f"f{i:03d}", None, f"d{i % 3}/x{i % 7}.ts", 1, 2) for i in range(n)], "id string, type string, name string, qualified_name string, file string, start_line int, end_line int")
    return code_graph(symbols, spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", t) for a, b, t in edges], "from_id string, to_id string, type string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_trace_finds_the_path_of_a_queue(spark, seed):
    draw = random.Random(seed)
    edges = sorted({(draw.randrange(60), draw.randrange(60), draw.choice(["calls", "imports", "references"])) for _ in range(130)})
    g = graph_of(spark, 60, edges)
    key = {r.id: r.node_key for r in g.symbols.collect()}
    near = {}
    for a, b, t in edges:
        near.setdefault(f"n{a:03d}", []).append((traverse.TRACE_PRIORITY[t], key[f"n{b:03d}"], "forward", f"n{a:03d}", f"n{b:03d}", t))
    for source, target in (("n000", "n030"), ("n005", "n041"), ("n007", "n007")):
        parent, queue = {source: None}, deque([source])
        while queue and target not in parent:
            for *_, a, b, t in sorted(near.get(queue.popleft(), [])):
                if b not in parent:
                    parent[b] = (a, t)
                    queue.append(b)
        path, at = [], target
        while source != target and parent.get(at):
            path.append((parent[at][0], parent[at][1], at))
            at = parent[at][0]
        got = [(r.from_id, r.relation, r.to_id) for r in traverse.trace(g, source, target, 32).orderBy("hop").collect()]
        assert got == path[::-1]


def test_shortest_cycles(spark):
    g = graph_of(spark, 12, [(0, 1, "calls"), (1, 2, "calls"), (2, 0, "calls"), (1, 0, "calls"), (5, 5, "calls"), (7, 8, "imports"), (8, 9, "imports"), (9, 7, "imports"), (3, 4, "calls")])
    found = {k: [r.id for r in v.orderBy("hop").collect()] for k, v in intelligence.canonical_cycles(g).items()}
    assert found == {("calls", "n000"): ["n000", "n001", "n000"], ("calls", "n005"): ["n005", "n005"], ("imports", "n007"): ["n009", "n007", "n008", "n009"]}


def test_communities_stay_in_their_repository(spark):
    g = graph_of(spark, 9, [(0, 3, "calls"), (3, 6, "calls"), (1, 4, "calls"), (0, 1, "calls"), (6, 7, "calls")])
    by = code_graph(g.symbols.drop("node_key").withColumn("repo", F.substring_index("file", "/", 1)), g.edges)
    got = {r.id: r.community for r in intelligence.communities(by).collect()}
    repo = {r.id: r.repo for r in by.symbols.collect()}
    assert len(got) == 9 and all(repo[a] == repo[b] for a in got for b in got if got[a] == got[b]) and got["n000"] == got["n003"]


def test_affected_tests_say_why(spark):
    rows = [("a", "function", "src/a.ts"), ("b", "function", "src/a.ts"), ("c", "function", "src/c.ts"), ("t1", "function", "tests/one.ts"), ("t2", "function", "tests/two.ts"), ("t3", "file", "tests/three.ts"), ("f", "file", "src/a.ts"), ("t4", "function", "tests/one.ts")]
    symbols = spark.createDataFrame([(i, t, i, None, f, 1, 2) for i, t, f in rows], "id string, type string, name string, qualified_name string, file string, start_line int, end_line int")
    edges = spark.createDataFrame([("t1", "a", "calls"), ("c", "a", "calls"), ("t2", "c", "references"), ("t3", "f", "imports"), ("t4", "b", "references")], "from_id string, to_id string, type string")
    got = {r.file: (r.distance, r.confidence, r.kinds, r.test_symbols) for r in change.affected_tests(code_graph(symbols, edges), spark.createDataFrame([("a",), ("t2",)], "id string")).collect()}
    assert got == {"tests/one.ts": (1, "high", ["call_path", "direct_reference"], ["t1", "t4"]), "tests/two.ts": (2, "medium", ["call_path"], ["t2"]), "tests/three.ts": (1, "high", ["import_dependency"], [])}
    assert [r.path for r in change.changed_tests(spark.createDataFrame([("tests/one.ts",), ("src/a.ts",)], "path string")).collect()] == ["tests/one.ts"]
