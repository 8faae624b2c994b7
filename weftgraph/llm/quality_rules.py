"""Quality rules as learned decision lists.

Sequential covering over labelled statistics: a rule grows by the threshold condition of the
best information gain, is pruned on rows that didn't grow it, and is kept if it is precise
there; the rows it covers are removed and the next rule is grown. The list is emitted as one
ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftgraph.llm.statistics import COUNTS, text_counts, text_statistics
from weftgraph.llm.tokens import chunks
from weftgraph.session import Scratch

#: Labelled rows that rules are learned from at most, the first by a hash of doc_id.
SAMPLE = 50_000
#: What rules may test, as SQL over COUNTS.
TESTS = {
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "exclaim_per_word": "n_exclaim / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "marks_per_char": "n_other_marks / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / (n_lines + 1)",
    "dup_lines_per_line": "n_dup_lines / (n_lines + 1)",
    "repeats_per_word": "n_repeat_words / greatest(n_words, 1)",
    "distinct_per_word": "n_distinct_words / greatest(n_words, 1)",
    "n_words": "n_words",
}
BASE = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


@dataclass
class Rule:
    """A conjunction of (test, at least?, threshold) that rejects what it covers."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, at in self.conditions:
            out &= x[name] >= at if above else x[name] <= at
        return out

    def sql(self) -> str:
        return " and ".join(f"{TESTS[name]} {'>=' if above else '<='} {at!r}D" for name, above, at in self.conditions)


def _best(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, bool, float]] | None:
    """The condition of the highest gain: bad rows kept times the rise of log precision."""
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    before = np.log2(p / (p + n))
    best = None
    for name, values in x.items():
        v, y = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        ends = np.flatnonzero(np.append(v[1:] != v[:-1], True))
        low_p = np.cumsum(y)[ends]
        low_n = ends + 1 - low_p
        for above in (False, True):
            # A threshold lies half way between neighbours.
            cp, cn = (p - low_p[:-1], n - low_n[:-1]) if above else (low_p[:-1], low_n[:-1])
            if not len(cp):
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(cp > 0, cp * (np.log2(cp / np.maximum(cp + cn, 1)) - before), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                at = float((v[ends[i]] + v[ends[i] + 1]) / 2)
                best = (float(gain[i]), (name, above, at))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, precision: float = 0.95, least: int = 3, most: int = 24, longest: int = 4) -> list[Rule]:
    """The decision list. ``grow`` marks the rows that rules grow on; the others prune and judge them."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (left & grow & bad).sum() >= least:
        rule, inside = Rule(), left & grow
        while len(rule.conditions) < longest and (~bad[inside]).any() and (found := _best(x, bad, inside)):
            rule.conditions.append(found[1])
            inside = inside & Rule([found[1]]).covers(x)
        judged = []
        for cut in range(len(rule.conditions), 0, -1):
            hit = Rule(rule.conditions[:cut]).covers(x) & left & ~grow
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            judged.append(((p - n) / max(p + n, 1), p, cut))
        if not judged:
            break
        worth, _, cut = max(judged)
        rule = Rule(rule.conditions[:cut])
        hit = rule.covers(x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if worth < 2 * precision - 1 or p < least or p < precision * (p + n):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over COUNTS: the number (from 1) of the rule that rejects a row, 0 if none."""
    if not rules:
        return F.lit(0)
    return F.expr("case " + " ".join(f"when {r.sql()} then {i}" for i, r in enumerate(rules, 1)) + " else 0 end")


def learned(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the statistics of at most ``sample`` labelled documents that pass the base rules.

    Null ids and labels other than 0 and 1 are left out; of repeated documents at most ``sample`` rows count, in the same
    order. Without labels there are no rules. A list has at most 24 rules of 4 conditions.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null")
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = statistics.filter(f"not ({BASE})").join(marked, "doc_id")
    table = rows.select("doc_id", "quality", *[F.expr(f"cast({e} as double)").alias(k) for k, e in TESTS.items()], (F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0).alias("grow"))
    table = table.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *TESTS).limit(sample).toPandas()
    if table.empty:
        return []
    return learn({k: table[k].to_numpy(float) for k in TESTS}, table.quality.to_numpy() == 0, table.grow.to_numpy(bool))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    base_failed: fewer than 10 words, or over 20 % of them in repeated 5-word windows (null and empty
    texts fail). kept: passes the base and no learned rule rejects it; rule is the number of the one
    that does. Repeated rows get equal results; an empty table gives no rows. Other columns are ignored, whatever their
    names; doc_id must be null or a whole number. Texts are read once.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    statistics = scratch.save(text_statistics(docs))
    failed, rule = F.expr(BASE), verdict(learned(statistics, labels))
    return statistics.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


_STATS = StructType([StructField(c, LongType()) for c in COUNTS])


def _beside(text_at: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(text_at)):
                rows = text_counts(texts)
                part = batch.slice(first, len(texts))
                whole = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([whole, *[pa.array(rows[:, i], pa.int64()) for i in range(len(COUNTS))]], names=["document", *COUNTS])

    return count


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with, whatever their names.

    Null and empty texts fail the base rules and go; repeated rows go or stay together; an empty table gives no rows.
    Documents don't move: rules are learned from the labelled ones first, then all are judged where they are.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    ids = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    # At most SAMPLE ids.
    statistics = scratch.save(text_statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")))
    rule = verdict(learned(statistics, labels))
    rows = docs.mapInArrow(_beside(docs.columns.index("text")), StructType([StructField("document", docs.schema), *_STATS.fields]))
    return rows.filter(~F.expr(BASE) & (rule == 0)).select("document.*")
