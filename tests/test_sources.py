"""Extractors, the facts codec, publishing and incremental sync on literal cases."""

import os
import threading

import pytest

from weftgraph.operators import resolution
from weftgraph.sources import repository
from weftgraph.sources.extractors import brace_facts
from weftgraph.sources.generations import Conflict, GenerationStore
from weftgraph.streaming import sync

TYPESCRIPT = """import Def, { a as b, c } from './m';
import * as ns from "n"; // import x from 'y'
export class Dog extends Animal<string> implements Pet, Other {
  private name: string = "class X {";
  constructor(private repo: Repo, n?: number) { super(n); }
  async bark(times: number): Promise<void> {
    if (times) { this.repo.save(times); helper(b()); }
  }
}
export function helper(x: Map<string, number>, y = 3) { return x.get(y); }
const arrow = async (p: Pet) => { p.run(); };
"""
JAVA = """package a; 
import java.util.List;
public class Api<T> extends Base implements One, Two<T> {
  /* void ghost() { } */
  public List<String> dogs(final String id, int[] n) throws IOException { return repo.find(id); }
}
"""
OTHERS = {
    "go": ("type Cat struct { n int }\nfunc (c *Cat) Meow(s string) { fmt.Println(s) }\nfunc Free() { run() }\n", {("class", "Cat"), ("method", "Cat.Meow"), ("function", "Free")}, {("fmt.Println", "Cat.Meow"), ("run", "Free")}),
    "rust": ("struct P<'a> { n: &'a str }\nimpl<'a> Show for P<'a> { fn show(&self, k: u32) { format(k); } }\nfn free() { P::new(); }\n", {("class", "P"), ("method", "P.show"), ("function", "free")}, {("format", "P.show"), ("P::new", "free")}),
    "kotlin": ("class K(val x: Int) : Base() { fun go(a: String): Int { return helper(a) } }\nfun top(x: Int) = x\n", {("class", "K"), ("method", "K.go"), ("function", "top")}, {("helper", "K.go")}),
    "swift": ("class S: Base { func go(_ a: Int) { show(a) } }\nextension S { func more() {} }\n", {("class", "S"), ("method", "S.go"), ("method", "S.more")}, {("show", "S.go")}),
    "dart": ("class W extends State<X> { Widget build(BuildContext c) { return a.make(c); } }\n", {("class", "W"), ("method", "W.build")}, {("a.make", "W.build")}),
    "cpp": ("class A : public B { int f(int x) { return g(x); } };\nint A::h(int v) { return k(v); }\n", {("class", "A"), ("method", "A.f"), ("method", "A.h")}, {("g", "A.f"), ("k", "A.h")}),
    "c": ("struct P { int x; };\nstatic int add(int a, char *b) { return helper(a); }\n", {("class", "P"), ("function", "add")}, {("helper", "add")}),
}


def split(facts):
    rows = list(facts)
    symbols = {(k, q) for _, k, _, q, _, _, _, _ in rows if k in ("class", "interface", "function", "method", "type", "enum")}
    return rows, symbols, {(n, o) for _, k, n, _, o, _, _, _ in rows if k == "call"}


def test_typescript_and_java_facts():
    rows, symbols, calls = split(brace_facts("a.ts", TYPESCRIPT, "typescript"))
    assert symbols == {("class", "Dog"), ("method", "Dog.constructor"), ("method", "Dog.bark"), ("function", "helper"), ("function", "arrow")}
    assert {("this.repo.save", "Dog.bark"), ("helper", "Dog.bark"), ("b", "Dog.bark"), ("x.get", "helper"), ("p.run", "arrow")} == calls
    assert {(n, a, d) for _, k, n, a, _, d, _, _ in rows if k == "import"} == {("default", "Def", "./m"), ("a", "b", "./m"), ("c", None, "./m"), ("*", "ns", "n")}
    assert {(n, o, d) for _, k, n, _, o, d, _, _ in rows if k == "base"} == {("Animal", "Dog", "extends"), ("Pet", "Dog", "implements"), ("Other", "Dog", "implements")}
    assert ("parameter", "repo", "Repo") in {(k, n, d) for _, k, n, _, _, d, _, _ in rows} and ("parameter", "x", "Map<string, number>") in {(k, n, d) for _, k, n, _, _, d, _, _ in rows}
    assert [(s, e) for _, k, n, _, _, _, s, e in rows if n == "Dog" and k == "class"] == [(3, 9)] and [(s, e) for _, k, n, _, _, _, s, e in rows if k == "method" and n == "bark"] == [(6, 8)]
    rows, symbols, calls = split(brace_facts("A.java", JAVA, "java"))
    assert symbols == {("class", "Api"), ("method", "Api.dogs")} and calls == {("repo.find", "Api.dogs")}
    assert {(n, d) for _, k, n, _, _, d, _, _ in rows if k == "parameter"} == {("id", "String"), ("n", "int[]")}


@pytest.mark.parametrize("language", sorted(OTHERS))
def test_facts_of_other_languages(language):
    text, want, called = OTHERS[language]
    _, symbols, calls = split(brace_facts("f", text, language))
    assert symbols == want and called <= calls


def test_broken_braces_are_an_error_and_empty_files_nothing():
    assert [f[1] for f in brace_facts("f", "class A { void b() {", "java")] == ["parse_error"]
    assert list(brace_facts("f", "", "go")) == []


def test_facts_are_packed_and_unpacked(spark):
    files = spark.createDataFrame([("a.ts", "typescript", TYPESCRIPT), ("b.py", "python", "def f(x: int):\n    return g(x)\n"), ("c.go", "go", OTHERS["go"][0]), ("d.txt", None, "x")], "path string, language string, content string")
    facts = repository.extract_facts(files)
    packed = repository.pack_facts(facts)
    assert sorted(map(repr, repository.unpack_facts(packed).collect())) == sorted(map(repr, facts.collect())) and {r.path for r in packed.collect()} == {"a.ts", "b.py", "c.go"}
    from pyspark.sql import functions as F

    broken = packed.withColumn("payload", F.when(F.col("path") == "a.ts", F.lit("[]")).otherwise(F.col("payload"))).withColumn("version", F.when(F.col("path") == "c.go", 0).otherwise(F.col("version")))
    assert {r.path for r in repository.unpack_facts(broken).collect()} == {"b.py"}


def test_one_of_two_writers_publishes(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("a", 1)], "file string, n int")
    names = [store.candidate() for _ in range(6)]
    for n in names:
        store.write(n, "t", rows)
    won, lost = [], []

    def publish(name):
        try:
            store.publish(name, None)
            won.append(name)
        except Conflict:
            lost.append(name)

    threads = [threading.Thread(target=publish, args=(n,)) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 5 and store.active() == won[0] and store.read("t").count() == 1
    store.publish(lost[0], won[0])
    assert store.active() == lost[0] and not [x for x in os.listdir(tmp_path) if x.endswith(".pointer")]
    with pytest.raises(Conflict):
        store.publish(lost[1], won[0])


def test_deleted_paths_stay_deleted(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}")
    batch = lambda *rows: spark.createDataFrame(list(rows), sync.FILE_VERSIONS)
    paths = lambda: {(r.path, r.version) for r in store.read("files").collect()}
    sync.sync_batch(store, batch(("a", "x", False, 1), ("b", "y", False, 5)))
    sync.sync_batch(store, batch(("a", None, True, 4)))
    assert paths() == {("b", 5)}
    sync.sync_batch(store, batch(("a", "late", False, 3), ("b", "late", False, 5)))
    assert paths() == {("b", 5)}
    sync.sync_batch(store, batch(("a", "again", False, 6)))
    assert paths() == {("a", 6), ("b", 5)}


def test_colliding_identities_are_rejected(spark):
    files = spark.createDataFrame([("a",)], "file string")
    symbols = spark.createDataFrame([("s", "function", "f", "f", "a", 1, 2)] * 2, "id string, type string, name string, qualified_name string, file string, start_line int, end_line int")
    none = spark.createDataFrame([], "file string, target string")
    decisions = spark.createDataFrame([], "status string, caller_id string, target string")
    with pytest.raises(resolution.IdentityCollision):
        resolution.assemble(files, symbols, none, decisions)
    nodes, edges = resolution.assemble(files, symbols.distinct(), none, decisions)
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("file:a", "s", "contains")]
