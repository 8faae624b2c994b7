"""Graph operators against queue-based models on small graphs."""

import random
from collections import deque

import pytest

from weftgraph.model import CodeGraph, code_graph
from weftgraph.operators import intelligence, relations, resolve, traverse

SYMBOLS = "id string, type string, name string, qualified_name string, file string, start_line int, end_line int"
EDGES = "from_id string, to_id string, type string"


def graph(spark, nodes, edges) -> CodeGraph:
    rows = [(n if isinstance(n, tuple) else (n, "function", n, None, f"src/{n[0]}.ts", 1, 5)) for n in nodes]
    return code_graph(spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame(edges, EDGES))


def key(n):
    return f"src/{n[0]}.ts:function:{n}:{n}"


def queue_impact(nodes, edges, seed, depth, most):
    order = traverse.IMPACT_PRIORITY
    seen, queue, items = {seed}, deque([(seed, 0, [seed])]), []
    while queue and len(items) < most:
        node, at, path = queue.popleft()
        if at >= depth:
            continue
        for a, _, t in sorted((e for e in edges if e[1] == node and e[2] != "contains"), key=lambda e: (order[e[2]], key(e[0]), e[0], e[1])):
            if a in seen or a not in nodes:
                continue
            seen.add(a)
            items.append((a, at + 1, t, path + [a]))
            if len(items) >= most:
                break
            queue.append((a, at + 1, path + [a]))
    return sorted(items)


@pytest.mark.parametrize("seed", range(3))
def test_impact_equals_a_queue(spark, seed):
    r = random.Random(seed)
    nodes = [f"{c}{i}" for c in "abc" for i in range(4)]
    edges = sorted({(r.choice(nodes), r.choice([*nodes, "gone"]), r.choice(["calls", "imports", "extends", "references", "contains"])) for _ in range(30)})
    g = graph(spark, nodes, edges)
    for depth, most in ((1, 100), (3, 3), (3, 100)):
        got = sorted((x.id, x.depth, x.relation, x.path) for x in traverse.impact(g, "a0", depth, most).collect())
        assert got == queue_impact(nodes, edges, "a0", depth, most)


def test_impact_of_a_file_and_its_summary(spark):
    g = graph(spark, [("f", "file", "src/a.ts", None, "src/a.ts", None, None), "a1", "b1", "c1"], [("b1", "a1", "calls"), ("c1", "b1", "calls")])
    items = traverse.impact(g, "f")
    assert sorted((x.id, x.depth) for x in items.collect()) == [("b1", 1), ("c1", 2)]
    row = traverse.impact_summary(g, "f", items, max_results=2).first()
    assert (row.direct, row.transitive, row.total, row.cross_file, row.cross_directory, row.risk, row.truncated) == (1, 1, 2, 2, 0, "low", True)
    assert traverse.impact_summary(g, "f", items, incomplete=True).first().risk == "unknown"


def test_truncation_is_told_when_the_limit_is_reached(spark):
    g = graph(spark, ["a0", *[f"b{i}" for i in range(12)]], [(f"b{i}", "a0", "calls") for i in range(12)])
    for most, told in ((5, True), (12, True), (13, False)):
        items = traverse.impact(g, "a0", 3, most)
        assert items.count() == min(most, 12) and traverse.impact_summary(g, "a0", items, max_results=most).first().truncated is told


def test_trace_takes_the_shortest_way(spark):
    g = graph(spark, ["a0", "b0", "c0", "d0"], [("a0", "b0", "calls"), ("a0", "c0", "calls"), ("b0", "d0", "calls"), ("c0", "d0", "calls"), ("d0", "a0", "calls")])
    assert [(h.from_id, h.to_id) for h in traverse.trace(g, "a0", "d0").collect()] == [("a0", "b0"), ("b0", "d0")]
    assert traverse.trace(g, "a0", "a0").count() == 0 and traverse.trace(g, "a0", "nowhere").count() == 0
    assert [h.direction for h in traverse.trace(g, "b0", "a0", mode="explanatory").collect()] == ["inverse"]


def test_expansion_neighbourhood_and_flow(spark):
    g = graph(spark, ["a0", "b0", "c0", "d0"], [("a0", "b0", "calls"), ("c0", "a0", "references"), ("b0", "d0", "calls"), ("d0", "a0", "calls")])
    seeds = g.symbols.filter("id = 'a0'").select("file", "name", "type", "start_line")
    assert [(x.id, x.depth) for x in traverse.expand(g, seeds, 2, 2).orderBy("nth").collect()] == [("b0", 1), ("d0", 1)]
    nodes, edges = traverse.neighborhood(g, "a0")
    assert sorted(x.id for x in nodes.collect()) == ["a0", "b0", "c0", "d0"] and edges.count() == 4
    flow, calls = traverse.execution_flow(g, "a0")
    assert sorted((x.id, x.depth, x.terminal) for x in flow.collect()) == [("a0", 0, False), ("b0", 1, False), ("d0", 2, False)] and calls.count() == 3
    closed = traverse.importer_closure(graph(spark, ["a0", "b0", "c0"], [("b0", "a0", "imports"), ("c0", "b0", "imports"), ("a0", "c0", "imports")]), spark.createDataFrame([("src/a.ts",)], "file string"))
    assert closed.count() == 3


def test_resolution_never_guesses(spark):
    nodes = [("1", "function", "runFast", None, "src/x/a.ts", 1, 2), ("2", "function", "runFast", None, "src/y/b.ts", 1, 2), ("3", "class", "Runner", "app.Runner", "src/x/a.ts", 3, 9), ("4", "file", "src/x/a.ts", None, "src/x/a.ts", None, None)]
    g = graph(spark, nodes, [])
    pick = lambda q: resolve.resolved_id(g, q)
    assert pick("runFast") is None and resolve.resolve(g, "runFast").first().status == "ambiguous"
    assert pick("x/a.ts:runFast") == "1" and pick("app.Runner") == "3" and pick("run_fast") is None and pick("x/a.ts") == "4" and pick("missing") is None
    assert pick("x/a.ts:run-fast") == "1" and pick("Runne") == "3"
    assert [r.id for r in resolve.search_nodes(g, "runner").collect()] == ["3"]


def test_relations_and_details(spark):
    g = graph(spark, ["a0", "b0", "c0", ("f", "file", "src/a.ts", None, "src/a.ts", None, None), ("h", "file", "src/h.ts", None, "src/h.ts", None, None)], [("b0", "a0", "calls"), ("b0", "a0", "calls"), ("gone", "a0", "calls"), ("f", "h", "imports"), ("a0", "c0", "extends")])
    assert [r.id for r in relations.callers(g, "a0").collect()] == ["b0"] and [r.id for r in relations.imports(g, "a0").collect()] == ["h"] and [r.id for r in relations.imported_by(g, "h").collect()] == ["f"]
    assert sorted((r.role, r.id) for r in relations.node_details(g, "a0").collect()) == [("callers", "b0"), ("callers", "b0"), ("extends", "c0")]
    assert relations.callers(g, "nobody").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_mutual_reachability(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(14)]
    edges = {(r.choice(nodes), r.choice(nodes)) for _ in range(22)}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {}
    for n in nodes:
        same = sorted(m for m in nodes if m in reach[n] and n in reach[m])
        if len(same) > 1 or (n, n) in edges:
            want[n] = same[0]
    got = {x.id: x.component for x in intelligence.strong_components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert got == want


def test_shortest_cycle_and_communities(spark):
    two = [f"{c}{i}" for c in "ab" for i in range(3)]
    edges = [(f"{c}{i}", f"{c}{j}", "calls") for c in "ab" for i in range(3) for j in range(3) if i != j] + [("a0", "b0", "references")]
    g = graph(spark, [*two, "z9"], edges)
    groups = {}
    for r in intelligence.communities(g).collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [["a0", "a1", "a2"], ["b0", "b1", "b2"], ["z9"]]
    part = spark.createDataFrame([("a0",), ("a1",), ("a2",)], "id string")
    assert [r.id for r in intelligence.shortest_cycle(g, part, "calls").orderBy("hop").collect()] == ["a0", "a1", "a0"]
    stats = {r.community: r for r in intelligence.community_stats(g, intelligence.communities(g)).collect()}
    assert sorted(r.quality for r in stats.values()) == ["normal", "normal", "singleton"]


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert traverse.impact(g, "x").count() == 0 and intelligence.importance(g).count() == 0 and intelligence.cycles(g).count() == 0
    assert relations.edge_breakdown(g).count() == 0 and intelligence.degree_stats(g).count() == 0 and resolve.resolve(g, "x").count() == 0
