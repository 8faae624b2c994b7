"""Roll-ups of evidence: resolution coverage, reliability, coverage gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes from best to worst, and gap kinds in report order.
OUTCOMES = ("accepted", "unsupported", "unknown", "budget_exhausted", "ambiguous")
GAPS = ("ambiguous_target", "broken_internal_import", "dynamic_dispatch", "missing_caller_context", "parser_error", "unsupported_construct", "unmapped_change_range",
        "missing_baseline", "binary_change", "truncated_analysis", "stale_index", "not_indexed", "ambiguous_architecture_membership")
SINGLE = ("not_indexed", "stale_index")
TARGETS = 100
COUNTERS = ("calls", "resolved_calls", "unresolved_calls", "ambiguous_calls", "extends_count", "resolved_extends", "unresolved_extends", "ambiguous_extends", "parser_errors", "unsupported_dynamic")


def _place(column: str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)).cast("int")


def merge_coverage(coverage: DataFrame, *by: str) -> DataFrame:
    """Counters summed and the flag or-ed, per group or over all."""
    return coverage.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS], F.bool_or("may_be_incomplete").alias("may_be_incomplete"))


def aggregate_reliability(contributions: DataFrame) -> DataFrame:
    """Per scope_key: outcome (the worst of any output), complete, stale, authoritative, authoritative_negative, and outputs by outcome.

    contributions: scope_key, output_key, outcome, complete, stale, applicable, supported, attempted. An output is as bad as
    its worst contribution; two aggregations, both combined before they are shuffled.
    """
    worst = _place("outcome", OUTCOMES)
    per = contributions.groupBy("scope_key", "output_key").agg(F.max(worst).alias("worst"), F.bool_and(F.col("complete") & ~F.col("stale")).alias("complete"), F.bool_or("stale").alias("stale"), *[F.count_if(c).alias(c) for c in ("applicable", "supported", "attempted")])
    names = ("resolved", "unsupported", "unknown", "budget_exhausted", "ambiguous")
    all_ = per.groupBy("scope_key").agg(F.max("worst").alias("worst"), F.bool_and("complete").alias("complete"), F.bool_or("stale").alias("stale"), *[F.sum(c).alias(c) for c in ("applicable", "supported", "attempted")], *[F.count_if(F.col("worst") == i).alias(n) for i, n in enumerate(names, 1)])
    sure = F.col("complete") & ~F.col("stale") & (F.col("worst") == 1)
    outcome = F.element_at(F.array(*[F.lit(x) for x in OUTCOMES]), F.col("worst"))
    return all_.select("scope_key", outcome.alias("outcome"), "complete", "stale", sure.alias("authoritative"), (sure & (F.col("ambiguous") + F.col("unknown") + F.col("unsupported") + F.col("budget_exhausted") == 0)).alias("authoritative_negative"), "applicable", "supported", "attempted", *names)


def coverage_gaps(gaps: DataFrame) -> DataFrame:
    """place, kind, count, files of (kind, count, file) rows with a positive count, in report order; unknown kinds are left out."""
    rows = gaps.filter("count > 0").withColumn("place", _place("kind", GAPS)).filter("place > 0")
    out = rows.groupBy("place", "kind").agg(F.sum("count").alias("count"), F.count_distinct("file").alias("files"))
    return out.select(F.col("place").cast("long").alias("place"), "kind", "count", "files")


def merge_gaps(gaps: DataFrame) -> DataFrame:
    """kind, count over several reports; an index is stale or missing once."""
    n = F.sum("count")
    return gaps.groupBy("kind").agg(F.when(F.col("kind").isin(*SINGLE), F.least(n, F.lit(1))).otherwise(n).cast("long").alias("count"))


def verification_targets(gaps: DataFrame, uncovered: DataFrame, limit: int = TARGETS) -> DataFrame:
    """file, symbol_id, reason: what to look at, in order, up to the limit."""
    none = F.lit("")
    rows = gaps.filter("count > 0 and file is not null").select("file", none.alias("symbol_id"), F.col("kind").alias("reason")).union(uncovered.select("file", F.coalesce("symbol_id", none), F.lit("no indexed structural test evidence found")))
    return rows.distinct().orderBy("file", "symbol_id", "reason").limit(limit)


def diagnostics_summary(gaps: DataFrame) -> DataFrame:
    """may_be_incomplete, authoritative_negative_results, kinds of a report's gaps."""
    some = F.count_if(F.col("count") > 0) > 0
    return gaps.agg(some.alias("may_be_incomplete"), (~some).alias("authoritative_negative_results"), F.count_distinct(F.when(F.col("count") > 0, F.col("kind"))).alias("kinds"))


def reuse_contributions(previous: DataFrame, fresh: DataFrame, invalid: DataFrame) -> DataFrame:
    """Earlier contributions whose evidence paths (array) are all untouched, and the recomputed ones; a recomputed owner replaces its earlier rows."""
    touched = previous.select("owner_key", F.explode("evidence_paths").alias("path")).join(invalid.select("path"), "path", "left_semi").select("owner_key").distinct()
    kept = previous.join(touched, "owner_key", "left_anti").join(fresh.select("owner_key").distinct(), "owner_key", "left_anti")
    return kept.unionByName(fresh)
