"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target of words and a schedule of weights over the phases of training.
Integrating the schedule gives the words that the source has to deliver by any time; a
document that starts at some cumulative word of its source is read at the time when the
inverse of that integral reaches the word. Documents are range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Target weights by the rank of a source, repeating.
WEIGHTS = (5, 2, 1)
#: Weights over equal phases of training by the rank of a source, repeating: one steady, one early, one late.
SCHEDULES = ((1.0, 1.0, 1.0, 1.0), (4.0, 3.0, 2.0, 1.0), (1.0, 2.0, 3.0, 4.0))
#: No source and no document is read more often.
MOST = 3
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, carried columns and size, the words of the text (null: 0)."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", *carry, words.alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rank, target for each source (null is a source of its own, the last).

    All sources share all words by weight; a target stops at ``most`` times its source's size and the
    excess is shared again, which is the level of water that fills sources in the order of their
    caps per weight. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")), "rank")
    per = per.withColumn("nth", F.row_number().over(order)).withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("open"))
    above = F.col("cap") / F.col("weight") > F.col("level")
    per = per.withColumn("stop", F.min(F.when(above, F.col("nth"))).over(everything))
    per = per.withColumn("last", F.min(F.when(F.col("nth") == F.col("stop"), F.col("level"))).over(everything))
    target = F.when(F.col("stop").isNull() | (F.col("nth") < F.col("stop")), F.col("cap").cast("double")).otherwise(F.col("last") * F.col("weight"))
    return per.select("source", "source_size", "rank", F.round(target, 6).alias("target"))


def _position(share: Column, rank: Column, schedules: tuple[tuple[float, ...], ...]) -> Column:
    """The time in [0, 1] when a source of this rank has delivered this share of its target."""
    phases = len(schedules[0])
    at, each = [], []
    for s in schedules:
        total = sum(s)
        at.append([sum(s[:i]) / total for i in range(phases)])
        each.append([x / total for x in s])
    pick = (F.pmod(rank, F.lit(len(schedules))) + 1).cast("int")
    rows = lambda table: F.element_at(F.array(*[F.array(*[F.lit(x) for x in r]) for r in table]), pick)
    phase = F.greatest(F.size(F.filter(rows(at), lambda x: x <= share)), F.lit(1))
    return (phase - 1 + (share - F.element_at(rows(at), phase)) / F.element_at(rows(each), phase)) / phases


def _placed(rows: DataFrame, sizes: DataFrame, before: Column, bucket_rows: Column, weights, schedules, most) -> DataFrame:
    """Adds source_size, target, passes and position to rows that have source, bucket, size and ``before`` within the bucket."""
    counted = sizes.groupBy("source", "bucket").agg(F.sum(bucket_rows).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each source and bucket; a source has 4096 buckets at most.
    offsets = counted.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    goal = targets(counted.select("source", F.col("words").alias("size")), weights, most)
    offsets = offsets.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("bucket").alias("of_bucket"), "offset", "source_size", "rank", "target")
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket"))).drop("of", "of_bucket")
    return rows.withColumn("start", F.col("offset") + before)


def _passes(most: int) -> Column:
    """A document is read a further time while the middle of that reading is below the target."""
    often = F.ceil((F.col("target") - F.col("start") - F.col("size") / 2) / F.col("source_size"))
    return F.when(F.col("source_size") > 0, F.greatest(F.lit(0), F.least(F.lit(most), often))).otherwise(0).cast("long")


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("draw", F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, position; range-sorted by position, documents not read last.

    taken = passes * size; position is the time of the first reading (null when there is none).
    Documents are drawn in the order of a hash of doc_id, so reruns agree and what is left out is no
    matter of the input's order. Null or empty texts have size 0. Equal (source, doc_id, size) rows
    are counted before the shuffle. An empty table gives no rows.
    """
    rows = _bucketed(sized(docs).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")))
    words = F.col("copies") * F.col("size")
    order = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(words).over(order), F.lit(0))
    rows = _placed(rows.withColumn("before", before), rows, F.col("before"), words, weights, schedules, most)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    rows = rows.withColumn("passes", _passes(most))
    share = (F.col("start") + F.col("size") / 2) / F.col("target")
    position = F.when(F.col("passes") > 0, F.round(_position(share, F.col("rank"), schedules), 9))
    out = rows.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"), "passes", position.alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, most: int = MOST) -> DataFrame:
    """The training stream: doc_id, text, lang, source, n_chars, one row for each reading, range-sorted by position.

    The same decisions as ``mixture``; texts move once to their bucket and once to their position.
    """
    keep = ("text", "lang", "n_chars")
    rows = _bucketed(sized(docs, keep))
    order = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    rows = _placed(rows.withColumn("before", before), _bucketed(sized(docs)), F.col("before"), F.col("size"), weights, schedules, most)
    rows = rows.withColumn("passes", _passes(most)).filter("passes > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("nth"))
    share = (F.col("start") + F.col("nth") * F.col("source_size") + F.col("size") / 2) / F.col("target")
    rows = rows.withColumn("position", _position(share, F.col("rank"), schedules))
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("doc_id", "text", "lang", "source", "n_chars")
