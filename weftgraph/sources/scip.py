"""Precise-index occurrences as binding evidence, and hooks for embeddings and rerankers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS = "point_id string, vector array<float>"


def binding_evidence(occurrences: DataFrame, symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, target, strategy, confidence) from an index's occurrences.

    occurrences: symbol, file, line, definition. A definition counts if exactly one parsed symbol of its file begins on
    its line; references reach sites of their file and line (columns site_id, file, line) that only one symbol is used on.
    """
    defined = occurrences.filter("definition").join(symbols.select("file", F.col("start_line").alias("line"), "id"), ["file", "line"]).groupBy("symbol").agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).filter("n = 1").select("symbol", "target")
    used = occurrences.filter("not definition").join(defined, "symbol").join(sites.select("site_id", "file", "line"), ["file", "line"])
    one = used.groupBy("site_id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1")
    return one.select("site_id", "target", F.lit("scip").alias("strategy"), F.lit("exact").alias("confidence"))


def embed(documents: DataFrame, provider: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """VECTORS for documents (document_id, embedding_text). The provider is made once a task and gets lists of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                yield pd.DataFrame({"point_id": part.document_id, "vector": model(part.embedding_text.tolist())})

    return documents.select("document_id", "embedding_text").mapInPandas(run, VECTORS)


def rerank(rows: DataFrame, provider: Callable[[], Callable[[str, list[str]], list[float]]], query: str, top: int = 5) -> DataFrame:
    """rows (key, rank, content) with rerank_score for the first ``top``; the others keep their rank and have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for b in batches:
            yield pd.DataFrame({"key": b.key, "rerank_score": model(query, b.content.tolist())})

    scored = rows.filter(F.col("rank") <= top).select("key", "content").mapInPandas(run, "key string, rerank_score double")
    return rows.join(scored, "key", "left").orderBy(F.desc_nulls_last("rerank_score"), "rank")
