"""Quality classifier: a regularised quadratic discriminant on transformed document statistics.

Each class has its mean and a covariance shrunk towards its diagonal and towards the pooled
covariance. A score is the logistic of the difference of the classes' log densities, which
come from Mahalanobis distances through Cholesky factors that are computed once. Densities of real
statistics aren't quite Gaussian and their differences run to thousands, so the logistic is taken of
asinh(difference / 2), which keeps their order and never saturates; its slope and intercept are fitted on
at most SAMPLE labelled rows, and the two weights of shrinkage are chosen by cross-validation on these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.statistics import COUNTS, text_statistics
from weftgraph.session import Scratch

FEATURES = ("log_words", "mean_word", "symbols", "upper", "digits", "exclaim", "stops", "marks", "words_per_line", "dup_lines", "repeats", "distinct", "longest")
_AT = {name: i for i, name in enumerate(COUNTS)}
#: The statistics read as fractions are taken to this power: the square root steadies the variance of a proportion.
POWER = 0.5
#: Labelled rows that slope, intercept and the weights of shrinkage are fitted on at most, the first by a hash of doc_id.
SAMPLE = 20_000
#: Weights of the diagonal and of the pooled covariance to choose from, and the folds of cross-validation.
SHRINK, POOL, FOLDS = (0.05, 0.2, 0.5), (0.1, 0.4, 0.7), 3
#: Bounds of the slope.
SLOPES = (0.05, 5.0)


def transform(counts: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS; finite for empty texts."""
    c = {name: counts[:, i].astype(float) for name, i in _AT.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), c["n_lines"] + 1
    return np.column_stack([
        np.log1p(c["n_words"]), np.minimum(c["word_chars"] / words, 40),
        (c["n_symbols"] / chars) ** POWER, (c["n_upper"] / chars) ** POWER, (c["n_digits"] / chars) ** POWER, (c["n_exclaim"] / chars) ** POWER,
        (c["n_stops"] / words) ** POWER, (c["n_other_marks"] / chars) ** POWER, np.log1p(c["n_words"] / lines),
        (c["n_dup_lines"] / lines) ** POWER, (c["n_repeat_words"] / words) ** POWER,
        (c["n_distinct_words"] + 1) / (words + 1) * np.log1p(words), np.log1p(c["longest_word"]),
    ])


@dataclass
class Quadratic:
    """Per class: log prior plus log determinant, mean and the inverse of the Cholesky factor."""

    constants: list[float]
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        logs = [c - 0.5 * (((x - m) @ inverse.T) ** 2).sum(axis=1) for c, m, inverse in zip(self.constants, self.means, self.inverses, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.arcsinh(self.difference(x) / 2) + self.intercept)))

    def loss(self, x: np.ndarray, label: np.ndarray) -> float:
        p = np.clip(self.score(x), 1e-9, 1 - 1e-9)
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    def calibrate(self, x: np.ndarray, label: np.ndarray) -> None:
        """Slope and intercept by damped Newton steps of logistic regression; rows of one label leave them alone.

        Targets are drawn in by one row of either label, so that the likelihood has a maximum for separable rows too.
        """
        good, bad = float((label == 1).sum()), float((label == 0).sum())
        if not good or not bad:
            return
        target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        d = np.column_stack([np.arcsinh(self.difference(x) / 2), np.ones(len(x))])

        def cost(b: np.ndarray) -> float:
            z = d @ b
            return float((np.logaddexp(0, z) - target * z).sum())

        b = np.array([1.0, 0.0])
        now = cost(b)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(d @ b)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 1e-9 * len(d) * np.eye(2), d.T @ (target - p))
            size = 1.0
            while size > 1e-6 and cost(b + size * step) > now:
                size /= 2
            after = cost(b + size * step)
            if not after < now - 1e-9 * len(d):
                break
            b, now = b + size * step, after
        self.slope, self.intercept = float(np.clip(b[0], *SLOPES)), float(b[1])


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, pool: float) -> Quadratic:
    """From each class's count, sum and sum of outer products. A class without rows gets the other's shape and no prior."""
    d = len(FEATURES)
    total = sum(m[0] for m in moments.values())
    if not total:
        return Quadratic([0.0, 0.0], [np.zeros(d)] * 2, [np.eye(d)] * 2)
    covariances, means = {}, {}
    for k, (n, s, ss) in moments.items():
        means[k] = s / n
        covariances[k] = ss / n - np.outer(means[k], means[k])
    pooled = sum(moments[k][0] / total * covariances[k] for k in covariances)
    floor = 1e-4 + 1e-3 * np.diag(pooled).mean()
    constants, centres, inverses = [], [], []
    for k in (0, 1):
        own = covariances.get(k, pooled)
        shape = (1 - pool) * own + pool * pooled
        shape = (1 - shrink) * shape + shrink * np.diag(np.diag(shape)) + floor * np.eye(d)
        factor = np.linalg.cholesky(shape)
        inverses.append(np.linalg.inv(factor))
        centres.append(means.get(k, np.mean(list(means.values()), axis=0)))
        constants.append(float(np.log((moments[k][0] if k in moments else 0) / total + 1e-6) - np.log(np.diag(factor)).sum()))
    return Quadratic(constants, centres, inverses)


def moments_of(x: np.ndarray, label: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    return {k: (float(len(own)), own.sum(axis=0), own.T @ own) for k in (0, 1) if len(own := x[label == k])}


def chosen(x: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[float, float]:
    """The (shrink, pool) of the least loss on rows that the model hasn't seen; the first of the grid without rows to tell."""
    losses = {}
    for shrink in SHRINK:
        for pool in POOL:
            each = []
            for f in range(FOLDS):
                seen, new = fold != f, fold == f
                if len(set(label[seen].tolist())) < 2 or not new.any():
                    continue
                model = fit(moments_of(x[seen], label[seen]), shrink, pool)
                model.calibrate(x[seen], label[seen])
                each.append(model.loss(x[new], label[new]))
            losses[shrink, pool] = float(np.mean(each)) if each else 0.0
    return min(losses, key=lambda k: (losses[k], k))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: count, sums and sums of products, flattened."""
    sums: dict[int, np.ndarray] = {}
    d = len(FEATURES)
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = transform(np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))]))
        for k in np.unique(label).tolist():
            own = x[label == k]
            sums[k] = sums.get(k, np.zeros(1 + d + d * d)) + np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["label", "at", "value"])


def class_moments(statistics: DataFrame, labels: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Moments of all labelled rows; what comes to the driver is 2 * (1 + d + d * d) sums."""
    d = len(FEATURES)
    rows = statistics.join(labels, "doc_id").select("label", *COUNTS)
    out: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(_moments, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r.label, np.zeros(1 + d + d * d))[r.at] = r.value
    return {k: (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)) for k, v in out.items()}


def held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id as text has the remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _scorer(model: Quadratic):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = transform(np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Learns from all labelled rows that aren't held out (labels other than 0 and 1, null labels and null
    ids are left out; several labels of a document each count). Null and empty texts are scored by the
    statistics of an empty text; without any label every score is 0.5. Repeated rows get equal scores, and repeated labelled
    rows each count. Other columns are ignored, whatever their names; doc_id must be null or a whole number. Texts
    are read once: statistics are written, learned from and scored. Means and covariances are those of all labelled rows; at
    most ``sample`` of them, the first by a hash of doc_id, fit the four numbers that are left.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    statistics = scratch.save(text_statistics(docs))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(3, 1))
    table = statistics.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "label", *COUNTS).limit(sample).select("label", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).alias("fold"), *COUNTS).toPandas()
    x, label = transform(table[list(COUNTS)].to_numpy().reshape(len(table), len(COUNTS))), table.label.to_numpy(float)
    model = fit(class_moments(statistics, marked), *chosen(x, label, table.fold.to_numpy()))
    model.calibrate(x, label)
    scored = statistics.select("doc_id", *COUNTS).mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
