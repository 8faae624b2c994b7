"""The registered queries of the ten corpus operators: thin calls over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import oracle
from weftgraph.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.sharding import shard_table

    return shard_table(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.quality_rules import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.ngram_join import similarity_components

    return similarity_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "class_rows", "n_links")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.line_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.chat_format import rotated

    spans = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return rotated(table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "n_turns", "n_spoken", "text", spans.alias("mask_spans"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.pii import pseudonymised

    key = spark.conf.get("spark.weftgraph.pii.key", None) or "a public key for trials"
    return pseudonymised(table(spark, sf_dir, "documents"), key).withColumn("kinds", F.array_join("kinds", ","))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_sharding, op3_quality_rules, op4_ngram_jaccard_join, op5_line_dedup, op6_toxicity, op7_curriculum_mixing, op8_benchmark_decontamination, op9_chat_rotation, op10_pii_surrogates)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": oracle.sharding(), "op5_line_dedup": oracle.line_dedup(), "op9_chat_rotation": oracle.chat(), "op7_curriculum_mixing": oracle.mixing()}
