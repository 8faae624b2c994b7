"""Ranking metrics and their comparison with a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """Per case_id: hit_1, hit_3, hit_5, mrr_5, recall_5, recall_10, precision_5, noise_5, judged_5.

    ranked: (case_id, rank, key); judged: (case_id, key, relevant boolean). A key that a case ranks twice counts
    by its first place. Without relevant keys recall is null.
    """
    first = ranked.groupBy("case_id", "key").agg(F.min("rank").alias("rank"))
    rows = first.join(judged.select("case_id", "key", "relevant"), ["case_id", "key"], "left")
    total = judged.groupBy("case_id").agg(F.count_if("relevant").alias("total"))
    hit = lambda k: F.count_if(F.col("relevant") & (F.col("rank") <= k))
    per = rows.groupBy("case_id").agg(
        hit(1).alias("h1"), hit(3).alias("h3"), hit(5).alias("h5"), hit(10).alias("h10"), F.min(F.when(F.col("relevant") & (F.col("rank") <= 5), F.col("rank"))).alias("first_hit"),
        F.count_if(F.col("rank") <= 5).alias("n5"), F.count_if((F.col("rank") <= 5) & ~F.col("relevant")).alias("bad5"), F.count_if((F.col("rank") <= 5) & F.col("relevant").isNotNull()).alias("known5"),
    )
    rows = total.join(per, "case_id", "left").na.fill(0, ["h1", "h3", "h5", "h10", "n5", "bad5", "known5"])
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 9))
    return rows.select(
        "case_id", *[(F.col(f"h{k}") > 0).cast("long").alias(f"hit_{k}") for k in (1, 3, 5)], F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 9).alias("mrr_5"),
        share("h5", "total").alias("recall_5"), share("h10", "total").alias("recall_10"), share("h5", "n5").alias("precision_5"), share("bad5", "n5").alias("noise_5"), share("known5", "n5").alias("judged_5"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over the cases that have a value."""
    return metrics.agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(c), 9).alias(c) for c in metrics.columns if c != "case_id"])


def against_policy(current: DataFrame, baseline: DataFrame, most_increase: float = 0.1) -> DataFrame:
    """(metric, value) against a baseline: metric, value, baseline, passed. Costs may rise by a share, `hits` may not fall."""
    both = current.join(baseline.withColumnRenamed("value", "baseline"), "metric", "full_outer")
    passed = F.when(F.col("value").isNull(), False).when(F.col("baseline").isNull(), True).when(F.col("metric").startswith("hit"), F.col("value") >= F.col("baseline")).otherwise(F.col("value") <= F.col("baseline") * (1 + most_increase))
    return both.select("metric", "value", "baseline", passed.alias("passed"))
