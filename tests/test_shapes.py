"""Responses, frameworks, precise indexes and context compilation on literal cases."""

import pytest

from weftgraph.operators import context, responses
from weftgraph.sources import frameworks, scip

NEST = """@Controller('cats')
export class CatsController {
  constructor(private client: ClientProxy) {}
  @Get(':id')
  @UseGuards(Auth)
  async findOne(id: string) { this.client.emit('cat.read', id); this.client.send(TOPIC, 1); }
  @Post()
  create() {}
  @Cron('* * * * *')
  sweep() {}
  @EventPattern('cat.read')
  onRead(x) {}
  @Query(() => Cat, 'cat')
  cat() {}
}
"""
SPRING = """@RestController
@RequestMapping("/api")
public class Api {
  @GetMapping("/dogs")
  public List<Dog> dogs() { kafkaTemplate.send("dog.read", 1); return null; }
  @KafkaListener(topics = "dog.read")
  void listen(String x) {}
  @Scheduled(fixedRate = 5)
  void tick() {}
}
"""


def test_framework_evidence(spark):
    files = spark.createDataFrame([("src/cats.ts", "typescript", NEST), ("Api.java", "java", SPRING), ("app/(shop)/cart/page.tsx", "tsx", "'use client'\nexport default () => <Cart/>"), ("lib/main.dart", "dart", "GoRoute(path: '/home', x)\nclass Home extends StatelessWidget {}"), ("x.py", "python", "")], "path string, language string, content string")
    rows = {(r.framework, r.kind, r.logical_key, r.handler) for r in frameworks.framework_evidence(files).collect()}
    assert {("nestjs", "route", '{"method":"GET","path":"/cats/:id"}', "findOne"), ("nestjs", "route", '{"method":"POST","path":"/cats"}', "create"), ("nestjs", "message_consumer", '{"consumer":"event","destination":"cat.read"}', "onRead"), ("nestjs", "graphql_operation", '{"name":"cat","operation":"query"}', "cat")} <= rows
    assert {("spring", "route", '{"method":"GET","path":"/api/dogs"}', "dogs"), ("spring", "message_consumer", '{"consumer":"kafka","destination":"dog.read"}', "listen"), ("next", "route", '{"method":"PAGE","path":"/cart"}', "page"), ("react", "boundary", '{"value":"client"}', "client"), ("flutter", "route", '{"method":"PAGE","path":"/home"}', "")} <= rows
    sent = {(r.framework, r.destination_kind, r.destination) for r in frameworks.message_producers(files).collect()}
    assert sent == {("nestjs", "literal", "cat.read"), ("nestjs", "unknown", "TOPIC"), ("spring", "literal", "dog.read")}
    symbols = spark.createDataFrame([("1", "src/cats.ts", "findOne"), ("2", "src/cats.ts", "create"), ("3", "src/cats.ts", "create")], "id string, file string, name string")
    _, bound = frameworks.framework_edges(frameworks.framework_evidence(files), symbols)
    assert [r.node_id for r in bound.collect()] == ["1"]
    inputs = spark.createDataFrame([("o", ["a", "b"]), ("p", ["c"])], "owner_key string, keys array<string>")
    assert [r.owner_key for r in frameworks.invalid_owners(inputs, spark.createDataFrame([("b",)], "key string")).collect()] == ["o"]


def test_projection_pages_and_cursors(spark):
    rows = spark.createDataFrame([(i, "x" * 700, "calls" if i % 2 else "imports", 1, "e") for i in range(10)], "id long, content string, relation string, vector_rank long, evidence string")
    assert responses.project(rows).columns == ["id", "relation"] and len(responses.project(rows, "focused").first().content) == 601
    assert responses.project(rows, "full", relation_kinds=("calls",)).count() == 5
    first = responses.page(rows.select("id", "relation"), ["id"], 0, 4, 80)
    assert 0 < first.count() < 4 and [r.id for r in responses.page(rows.select("id"), ["id"], 4, 3).collect()] == [4, 5, 6]
    snap = responses.snapshot_digest(rows)
    assert snap == responses.snapshot_digest(rows.orderBy("id", ascending=False))
    cursor = responses.encode_cursor("q", "g", snap, 4, 100.0, b"k")
    assert responses.decode_cursor(cursor, "q", "g", snap, 200.0, b"k") == 4
    for args, code in ((("q", "g", snap, 2000.0, b"k"), "expired_cursor"), (("q", "h", snap, 200.0, b"k"), "stale_cursor"), (("r", "g", snap, 200.0, b"k"), "invalid_cursor"), (("q", "g", snap, 200.0, b"z"), "invalid_cursor")):
        with pytest.raises(responses.CursorError) as e:
            responses.decode_cursor(cursor, *args)
        assert e.value.code == code
    top, more = responses.limited(rows, 3, "id")
    assert top.count() == 3 and more.first().truncated


def test_index_evidence_and_hooks(spark):
    occ = spark.createDataFrame([("s", "a.ts", 3, True), ("s", "b.ts", 9, False), ("t", "a.ts", 4, True)], "symbol string, file string, line int, definition boolean")
    sym = spark.createDataFrame([("1", "a.ts", 3), ("2", "a.ts", 4), ("3", "a.ts", 4)], "id string, file string, start_line int")
    sites = spark.createDataFrame([("x", "b.ts", 9), ("y", "b.ts", 10)], "site_id string, file string, line int")
    assert [tuple(r) for r in scip.binding_evidence(occ, sym, sites).collect()] == [("x", "1", "scip", "exact")]
    docs = spark.createDataFrame([("1", "ab"), ("2", "abc")], "document_id string, embedding_text string")
    assert sorted(r.vector[0] for r in scip.embed(docs, lambda: lambda texts: [[float(len(t))] for t in texts]).collect()) == [2.0, 3.0]
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "xxx"), ("c", 3, "xxxxx")], "key string, rank long, content string")
    assert [r.key for r in scip.rerank(rows, lambda: lambda q, texts: [float(len(t)) for t in texts], "q", 2).collect()] == ["b", "a", "c"]


def test_context_is_compiled(spark):
    symbols = spark.createDataFrame([("1", "a.ts", "runFast", 10), ("2", "b.ts", "stop", 20), ("3", "c.ts", "stop", 30), ("4", "d.ts", "other", 5)], "id string, file string, name string, tokens long")
    hits = spark.createDataFrame([("4", 1)], "id string, rank long")
    request = context.normalize_task("fix `runFast`  and stop", [], ["c.ts"])
    evidence = context.collect_candidates(symbols, hits, hits.limit(0), request)
    assert {(r.subject, r.kind) for r in evidence.collect()} == {("1", "task_exact_resolution"), ("3", "explicit_changed_path"), ("4", "lexical")}
    more = context.enriched(evidence, spark.createDataFrame([("1", "2", "calls")], "from_id string, to_id string, type string"))
    plan = [(r.subject, r.priority, r.included) for r in context.compile_context(more, 3).orderBy("rank").collect()]
    assert plan == [("1", "required", True), ("3", "required", True), ("2", "supporting", True), ("4", "optional", False)]
