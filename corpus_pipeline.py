"""A training-data pipeline over ``documents``: quality rules, near duplicates, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from weftgraph.llm.queries import table
from weftgraph.session import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned rules keep."""
    return quality_rules.kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest doc_id."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's training stream: a document as often as the mix reads it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream's rows with their shard and slot."""
    return sharding.sharded_documents(docs.select(*COLUMNS))


STAGES = [("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", without_benchmark), ("curriculum_mixing", mixed), ("sharding", sharded)]

#: Learned rules and similarity components have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
