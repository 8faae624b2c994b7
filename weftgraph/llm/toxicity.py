"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon of whole words and of word beginnings, hits near second-person
pronouns, capitals, punctuation, and words that only match once look-alike characters are
undone. The lexicon is a short general list and what labelled rows teach. Lexicon and trees are learned from
two thirds of the labelled rows; the isotonic curve is fitted on the rest, whose labels they haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.quality_classifier import held_out
from weftgraph.llm.tokens import LETTERS_LOWER, U, beginning_hashes, chunks, word_hashes
from weftgraph.session import Scratch

#: Labelled rows that the lexicon and the trees are learned from at most, the first by a hash of doc_id.
SAMPLE = 20_000
#: Words and beginnings that a lexicon keeps at most, the best by log odds.
LEXICON = 4_000
#: Toxic rows of each half of the learning rows that must hold an entry, and how many times as often as other rows.
TOLD, ODDS = 3, 8.0
#: Letters of a word's beginning that are looked at.
BEGINNINGS = (4, 5, 6, 7, 8)

# General insults, and pronouns of address, in the corpus languages.
INSULTS = [
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "filthy", "vermin",
    "idiota", "imbécil", "estúpido", "basura", "idiote", "imbécile", "ordure", "crétin", "dummkopf", "abschaum", "trottel", "depp",
]
ADDRESS = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros"]
LOOKALIKES = {ord("0"): "o", ord("1"): "i", ord("3"): "e", ord("4"): "a", ord("5"): "s", ord("7"): "t", ord("@"): "a", ord("$"): "s", ord("!"): "i", ord("*"): "*"}

_UNDONE = LETTERS_LOWER.copy()
for _k, _v in LOOKALIKES.items():
    _UNDONE[_k] = ord(_v)
FEATURES = ("log_words", "hits", "hit_density", "kinds", "begin_hits", "begin_density", "near_address", "address_density", "upper", "exclaim", "marks", "symbols", "undone", "undone_density")


def hashed(words: list[str]) -> np.ndarray:
    return np.unique(word_hashes([w.encode() for w in words], LETTERS_LOWER)[0]) if words else np.zeros(0, U)


@dataclass
class Lexicon:
    words: np.ndarray = field(default_factory=lambda: hashed(INSULTS))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    widths: tuple[int, ...] = BEGINNINGS


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


_ADDRESS = hashed(ADDRESS)


def features(texts: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(texts)
    words, bounds = word_hashes(texts, LETTERS_LOWER)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(n), counts)
    total = lambda mask, of=owner: np.bincount(of[mask], minlength=n).astype(float)
    hit = _within(words, lexicon.words)
    begin = np.zeros(len(words), bool)
    if len(lexicon.begins):
        for hashes in beginning_hashes(texts, LETTERS_LOWER, lexicon.widths):
            begin |= _within(hashes, lexicon.begins)
    at = np.flatnonzero(hit | begin)
    kinds = np.bincount(np.unique(np.column_stack([owner[at], words[at].view(np.int64)]), axis=0)[:, 0], minlength=n) if len(at) else np.zeros(n)
    address = _within(words, _ADDRESS)
    near = np.zeros(len(words), bool)
    for step in range(1, 6):
        near[step:] |= address[:-step] & (owner[step:] == owner[:-step])
        near[:-step] |= address[step:] & (owner[step:] == owner[:-step])
    undone, undone_bounds = word_hashes(texts, _UNDONE)
    undone_owner = np.repeat(np.arange(n), np.diff(undone_bounds))
    plain = total(hit)
    masked = np.maximum(total(_within(undone, lexicon.words), undone_owner) - plain, 0)
    histogram = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts])
    chars = np.maximum(histogram.sum(axis=1), 1)
    of = lambda s: np.sqrt(histogram[:, list(s)].sum(axis=1) / chars)
    size = np.maximum(counts, 1)
    found, starts = plain, total(begin)
    return np.column_stack([
        np.log1p(counts), np.minimum(found, 20), np.sqrt(found / size), np.minimum(kinds, 10), np.minimum(starts, 20), np.sqrt(starts / size), np.minimum(total((hit | begin) & near), 10),
        np.sqrt(total(address) / size), of(range(65, 91)), of(b"!?"), of(b".,;:\"'()-"), of(b"#*$%&|<>@"), np.minimum(masked, 10), np.sqrt(masked / size),
    ])


def _tallied(batches: Iterator[pa.RecordBatch], widths: tuple[int, ...] = BEGINNINGS) -> Iterator[pa.RecordBatch]:
    """Rows (label, half, text): how many texts of either label and half hold each word hash and each beginning."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        key, kind, group = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((kind, key))
        key, kind, group = key[order], kind[order], group[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))))
        counts = [pa.array(np.add.reduceat((group == g).astype(np.int64), first)) for g in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(kind[first], pa.int32()), *counts], names=["key", "kind", *_GROUPS])

    for batch in batches:
        groups = 2 * batch.column(0).to_numpy(zero_copy_only=False) + batch.column(1).to_numpy(zero_copy_only=False)
        for start, texts in chunks(batch.column(2)):
            words, bounds = word_hashes(texts, LETTERS_LOWER)
            begins = beginning_hashes(texts, LETTERS_LOWER, widths)
            for i in range(len(texts)):
                part = slice(bounds[i], bounds[i + 1])
                for kind, values in ((0, words[part]), (1, np.concatenate([b[part] for b in begins]))):
                    values = np.unique(values)
                    values = values[values != 0]
                    held.append((values, np.full(len(values), kind, np.int32), np.full(len(values), groups[start + i], np.int64)))
                    size += len(values)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


_GROUPS = ("good0", "good1", "bad0", "bad1")


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings that toxic rows of (label, half, text) hold far more often than others do, in either half.

    Only those come to the driver that at least TOLD toxic rows of each half hold, ODDS times as often as its other rows, LEXICON
    at most. What is telling in one half by chance isn't in the other.
    """
    rows = {(r.label, r.half): r["rows"] for r in sample.groupBy("label", "half").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if len(rows) < 4:
        return Lexicon()
    odds = [(F.col(f"bad{h}") / rows[1, h]) / ((F.col(f"good{h}") + 0.5) / rows[0, h]) for h in (0, 1)]
    counted = sample.select("label", "half", "text").mapInArrow(_tallied, "key long, kind int, " + ", ".join(f"{g} long" for g in _GROUPS)).groupBy("key", "kind").agg(*[F.sum(g).alias(g) for g in _GROUPS])
    telling = counted.filter((F.least("bad0", "bad1") >= TOLD) & (F.least(*odds) >= ODDS)).withColumn("odds", F.least(*odds))
    best = telling.orderBy(F.desc("odds"), F.desc(F.col("bad0") + F.col("bad1")), "kind", "key").limit(LEXICON).collect()
    of = lambda kind: np.array([r.key for r in best if r.kind == kind], np.int64).view(U)
    return Lexicon(np.union1d(hashed(INSULTS), of(0)), np.sort(of(1)))


@dataclass
class Trees:
    """Boosted trees of depth DEPTH in heap order, on binned features, and a calibration curve."""

    edges: list[np.ndarray]
    base: float
    splits: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        for (feature, cut), leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        if self.curve is None:
            return 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return np.interp(m, *self.curve)


DEPTH = 3


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, penalty: float = 1.0, bins: int = 32) -> Trees:
    """Second-order boosting of logistic loss; every split is the best over binned gradient sums."""
    edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, bins))) for c in x.T]
    edges = [np.unique(np.concatenate((e, [1e-12]))) for e in edges]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(edges, float(np.log(p / (1 - p))))
    b = trees.bins(x)
    width = max(len(e) for e in edges) + 1
    margin = np.full(len(y), trees.base)
    inner = 2**DEPTH - 1
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            local = node - first
            best = np.full(2**level, 1e-6)
            for j in range(x.shape[1]):
                key = local * width + b[:, j]
                gs = np.bincount(key, g, 2**level * width).reshape(-1, width).cumsum(axis=1)
                hs = np.bincount(key, h, 2**level * width).reshape(-1, width).cumsum(axis=1)
                tg, th = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (tg - gs) ** 2 / (th - hs + penalty) - tg**2 / (th + penalty)
                at = gain.argmax(axis=1)
                better = gain[np.arange(2**level), at] > best
                best[better] = gain[np.arange(2**level), at][better]
                feature[first : first + 2**level][better] = j
                cut[first : first + 2**level][better] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf_of = node - inner
        gs, hs = np.bincount(leaf_of, g, 2**DEPTH), np.bincount(leaf_of, h, 2**DEPTH)
        leaf = -rate * gs / (hs + penalty)
        trees.splits.append((feature, cut))
        trees.leaves.append(leaf)
        margin += leaf[leaf_of]
    return trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins and the rising rates to interpolate between."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + m2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fitted(table: pd.DataFrame) -> Trees | None:
    """Trees from the rows that aren't marked to calibrate, calibrated on those that are; None if a label is missing."""
    y, x = table.label.to_numpy(float), table[list(FEATURES)].to_numpy(float)
    if len(set(y)) < 2:
        return None
    part = table.calibrate.to_numpy(bool)
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        return boosted(x, y)
    trees = boosted(x[~part], y[~part])
    trees.curve = isotonic(trees.margin(x[part]), y[part])
    return trees


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                x = features(texts, lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *[pa.array(x[:, j]) for j in range(len(FEATURES))]], names=["doc_id", *FEATURES])

    return run


def _scorer(trees: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(j + 1).to_numpy(zero_copy_only=False) for j in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x) if trees else np.zeros(len(x)))], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Learns from at most ``sample`` labelled rows that aren't held out, the first by a hash of doc_id
    (labels other than 0 and 1 and null ids are left out; of repeated labelled documents at most ``sample`` rows train the
    trees). Null and empty texts get the score of an empty text; repeated rows get equal scores; without labels of both
    kinds every score is 0. Other columns are ignored, whatever their names; doc_id must be null or a whole number.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(~held_out(4, 2))
    marked = scratch.save(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample).withColumn("third", F.pmod(F.xxhash64(F.lit("third"), "doc_id"), F.lit(3))).withColumn("calibrate", F.col("third") == 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # ``marked`` has at most ``sample`` rows of two numbers and a mark.
    rows = texts.join(F.broadcast(marked.filter("not calibrate")), "doc_id").select("label", F.col("third").alias("half"), F.coalesce("text", F.lit("")).alias("text"))
    lexicon = learned_lexicon(scratch.save(rows))
    table = scratch.save(texts.mapInArrow(_featured(lexicon), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)))
    trees = fitted(table.join(F.broadcast(marked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", *FEATURES).limit(sample).toPandas())
    scored = table.select("doc_id", *FEATURES).mapInArrow(_scorer(trees), "doc_id long, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
