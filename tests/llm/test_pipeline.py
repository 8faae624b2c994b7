"""The pipeline against a brute-force version of each stage, and the registered queries."""

from collections import Counter

import corpus_pipeline as pipeline
from test_text_operators import brute_components, brute_contamination

import __spark_entry__ as entry
from weftgraph.session import Scratch


def test_stages_equal_brute_force(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark, "test-pipeline")
    out = {"": documents}
    docs = documents
    for name, stage in pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf))
        out[name] = docs
    pairs = lambda name: [(r.doc_id, r.text) for r in out[name].collect()]
    for name, _ in pipeline.STAGES[:-1]:
        assert out[name].columns == documents.columns
    judged = {r.doc_id: r.kept for r in entry.queries()["op3_quality_rules"](spark, sf).collect()}
    rules = pairs("quality_rules")
    assert sorted(d for d, _ in rules) == sorted(d for d, k in judged.items() if k)
    keep = {d for d, _, c in brute_components(rules) if d == c}
    assert sorted(d for d, _ in pairs("ngram_jaccard_join")) == sorted(keep)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(pairs("ngram_jaccard_join"), items) if r[5]}
    assert sorted(d for d, _ in pairs("benchmark_decontamination")) == sorted(keep - bad)
    mixed = Counter(d for d, _ in pairs("curriculum_mixing"))
    assert set(mixed) <= keep - bad and max(mixed.values()) <= 3
    last = out["sharding"].collect()
    assert Counter(r.doc_id for r in last) == mixed
    for shard in range(8):
        slots = sorted(r.slot for r in last if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sorted((r.doc_id, r.shard, r.slot) for r in pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in last)


def test_queries_are_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
