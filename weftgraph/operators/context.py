"""Task context: candidates, ranking, budget, delivery decisions and lifecycles."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evidence kinds by tier, default cost and limits.
REQUIRED = ("explicit_anchor", "explicit_changed_path", "task_exact_resolution")
SUPPORTING = ("graph", "change", "impact", "affected_test")
RETRIEVAL = ("lexical", "semantic")
COST, ITEMS, TOKENS = 256, 20, 4000


def normalize_task(task: str, anchors: list[str] = (), paths: list[str] = ()) -> dict:
    """The task in NFC with single blanks, anchors and paths sorted and distinct, and the identity of all three."""
    clean = lambda x: " ".join(unicodedata.normalize("NFC", x).split())
    listed = lambda xs: sorted({clean(x).replace("\\", "/") for x in xs if clean(x)})
    out = {"task": clean(task), "anchors": listed(anchors), "paths": listed(paths)}
    return out | {"identity": hashlib.sha256(json.dumps(out, sort_keys=True, ensure_ascii=False).encode()).hexdigest()}


def collect_candidates(symbols: DataFrame, lexical: DataFrame, semantic: DataFrame, request: dict) -> DataFrame:
    """(subject, kind, rank, exact, tokens) evidence for a normalised request: anchors, changed paths, exact names in the task, search hits.

    symbols: id, file, name, tokens. lexical and semantic: id, rank.
    """
    words = [w for w in request["task"].replace("`", " ").split() if len(w) > 2]
    hit = lambda column, values, kind: symbols.filter(F.col(column).isin(*values) if values else F.lit(False)).select(F.col("id").alias("subject"), F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("rank"), F.lit(True).alias("exact"), F.col("tokens").cast("long").alias("tokens"))
    out = hit("name", request["anchors"], "explicit_anchor").union(hit("file", request["anchors"], "explicit_anchor")).union(hit("file", request["paths"], "explicit_changed_path"))
    exact = hit("name", words, "task_exact_resolution")
    only = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("subject")).filter("n = 1")
    out = out.union(exact.join(only.select("subject"), "subject", "left_semi").select(*out.columns))
    for rows, kind in ((lexical, "lexical"), (semantic, "semantic")):
        out = out.union(rows.join(symbols.select("id", "tokens"), "id").select(F.col("id").alias("subject"), F.lit(kind), F.col("rank").cast("long"), F.lit(False), F.col("tokens").cast("long")))
    return out


def enriched(evidence: DataFrame, edges: DataFrame, per_subject: int = 5) -> DataFrame:
    """Evidence with up to ``per_subject`` direct neighbours of each required subject as graph evidence, in order of their ids."""
    seeds = evidence.filter(F.col("kind").isin(*REQUIRED)).select("subject").distinct()
    both = edges.select(F.col("from_id").alias("subject"), F.col("to_id").alias("other")).union(edges.select(F.col("to_id"), F.col("from_id")))
    near = both.join(seeds, "subject", "left_semi").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy("other"))).filter(F.col("rank") <= per_subject)
    return evidence.union(near.select(F.col("other").alias("subject"), F.lit("graph").alias("kind"), F.col("rank").cast("long").alias("rank"), F.lit(False).alias("exact"), F.lit(None).cast("long").alias("tokens")))


def compile_context(evidence: DataFrame, max_items: int = ITEMS, max_tokens: int = TOKENS) -> DataFrame:
    """The whole plan: evidence merged, ranked and cut to the budget."""
    return budgeted(ranked(merge_candidates(evidence)), max_items, max_tokens)


def merge_candidates(evidence: DataFrame) -> DataFrame:
    """(subject, kind, rank, exact, tokens) rows into one per subject: kinds, pieces, least rank by kind, exact, tokens."""
    per = evidence.groupBy("subject", "kind").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("pieces"), F.bool_or("exact").alias("exact"), F.max("tokens").alias("tokens"))
    return per.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("kind", "rank", "pieces"))).alias("evidence"), F.sum("pieces").alias("pieces"), F.bool_or("exact").alias("exact"), F.max("tokens").alias("tokens"))


def ranked(candidates: DataFrame) -> DataFrame:
    """rank, subject, priority, signal, tokens: by tier, summed reciprocal ranks, exactness, pieces of evidence, subject."""
    has = lambda kinds: F.exists("evidence", lambda e: e["kind"].isin(*kinds))
    found = F.aggregate("evidence", F.lit(0).cast("long"), lambda acc, e: acc + F.when(e["kind"].isin(*RETRIEVAL), e["pieces"]).otherwise(0))
    priority = F.when(has(REQUIRED), "required").when(has(SUPPORTING), "supporting").when(found > 1, "supporting").otherwise("optional")
    signal = F.aggregate("evidence", F.lit(0.0), lambda acc, e: acc + F.when(e["rank"].isNull(), 0.0).otherwise(e["pieces"] / (60 + e["rank"])))
    tier = F.when(F.col("priority") == "required", 0).when(F.col("priority") == "supporting", 1).otherwise(2)
    order = Window.orderBy(tier, F.desc("signal"), F.desc("exact"), F.desc("pieces"), "subject")
    rows = candidates.withColumn("priority", priority).withColumn("signal", F.round(signal, 12))
    return rows.select(F.row_number().over(order).cast("long").alias("rank"), "subject", "priority", "signal", "tokens")


def budgeted(items: DataFrame, max_items: int = ITEMS, max_tokens: int = TOKENS) -> DataFrame:
    """items with included: required ones always, others while count and tokens allow; a later cheap item may still fit."""
    if max_items <= 0 or max_tokens <= 0:
        raise ValueError("budget limits must be positive integers")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        cost = F.coalesce(x["tokens"].cast("long"), F.lit(COST).cast("long"))
        take = (x["priority"] == "required") | ((acc["n"] < max_items) & (acc["used"] + cost <= max_tokens))
        return F.struct((acc["n"] + take.cast("int")).alias("n"), (acc["used"] + F.when(take, cost).otherwise(F.lit(0))).alias("used"), F.when(take, F.concat(acc["kept"], F.array(x["rank"]))).otherwise(acc["kept"]).alias("kept"))

    one = items.agg(F.sort_array(F.collect_list(F.struct("rank", "subject", "priority", "signal", "tokens"))).alias("items"))
    folded = one.select("items", F.aggregate("items", start, step)["kept"].alias("kept"))
    return folded.select(F.explode("items").alias("x"), "kept").select("x.*", F.array_contains("kept", F.col("x.rank")).alias("included"))


def delivery(reads: DataFrame) -> DataFrame:
    """reads plus mode (full, unchanged, delta, rehydrate) and reason: the first condition that holds decides.

    Columns: has_prior, readable, receipt_id, state, expires_at, now, identity_same, selector_same, content_same,
    snapshot_id, snapshot_same, delta_available, reconstruction_valid.
    """
    c = F.col
    ladder = [
        (~c("has_prior"), "full", "first_read"), (~c("readable"), "rehydrate", "current_read_failed"), (c("receipt_id").isNull(), "rehydrate", "missing_receipt"), (c("state") != "active", "rehydrate", "receipt_not_active"),
        (c("expires_at") <= c("now"), "rehydrate", "receipt_expired"), (~c("identity_same"), "rehydrate", "identity_mismatch"), (~c("selector_same"), "rehydrate", "selector_mismatch"), (c("content_same"), "unchanged", None),
        (c("snapshot_id").isNull(), "rehydrate", "missing_snapshot"), (~c("snapshot_same"), "rehydrate", "snapshot_mismatch"), (~c("delta_available"), "rehydrate", "delta_unavailable"), (~c("reconstruction_valid"), "rehydrate", "reconstruction_failed"),
    ]
    mode, reason = F.lit("delta"), F.lit(None).cast("string")
    for condition, m, r in reversed(ladder):
        holds = F.coalesce(condition, F.lit(False))
        mode, reason = F.when(holds, m).otherwise(mode), F.when(holds, F.lit(r).cast("string")).otherwise(reason)
    return reads.withColumn("mode", mode).withColumn("reason", reason)


@dataclass(frozen=True)
class Lifecycle:
    """One task's state; changes go by the revision that the caller saw."""

    identity: str
    revision: int
    state: str
    expires_at: float


class Lifecycles:
    """Start, refresh and close tasks with optimistic revisions and a time to live."""

    def __init__(self, ttl: float = 900.0):
        self.ttl, self.rows = ttl, {}

    def start(self, task: str, now: float, anchors: list[str] = (), paths: list[str] = ()) -> Lifecycle:
        identity = normalize_task(task, anchors, paths)["identity"]
        row = self.rows.get(identity)
        if row is not None and row.state == "active" and row.expires_at > now:
            return row
        self.rows[identity] = Lifecycle(identity, (row.revision if row else 0) + 1, "active", now + self.ttl)
        return self.rows[identity]

    def _change(self, identity: str, revision: int, now: float, **to) -> Lifecycle:
        row = self.rows.get(identity)
        if row is None or row.state != "active":
            raise ValueError("no such active task")
        if row.expires_at <= now:
            self.rows[identity] = replace(row, state="expired")
            raise ValueError("the task has expired")
        if row.revision != revision:
            raise ValueError("the task has changed since it was read")
        self.rows[identity] = replace(row, revision=revision + 1, **to)
        return self.rows[identity]

    def refresh(self, identity: str, revision: int, now: float) -> Lifecycle:
        return self._change(identity, revision, now, expires_at=now + self.ttl)

    def close(self, identity: str, revision: int, now: float) -> Lifecycle:
        return self._change(identity, revision, now, state="closed")
