"""Statistics of whole texts, in numpy passes over UTF-8 bytes.

Words are `[^\\x20\\x09-\\x0D]+`. A text's byte histogram gives its character classes; word
hashes give repeats and distinct words; lines are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.tokens import _LANES, BLANKS, SHINGLE, U, chunks, lut, mix, word_hashes

#: Counted characters, as a row of 256 byte weights each.
_CODE_POINTS = np.array([1 if b < 0x80 or b >= 0xC0 else 0 for b in range(256)], np.int64)
_WORD_CHARS = _CODE_POINTS.copy()
_WORD_CHARS[list(BLANKS)] = 0


def _of(characters: bytes) -> np.ndarray:
    row = np.zeros(256, np.int64)
    row[list(characters)] = 1
    return row


#: Characters of `[#*$%&|<>]`.
_SYMBOLS = _of(b"#*$%&|<>")
_CLASSES = {
    "word_chars": _WORD_CHARS,
    "n_symbols": _SYMBOLS,
    "n_upper": _of(bytes(range(65, 91))),
    "n_digits": _of(bytes(range(48, 58))),
    "n_exclaim": _of(b"!?"),
    "n_stops": _of(b".,;:"),
    "n_other_marks": _of(b"\"'()-/@[\\]^_`{}~+="),
    "n_lines": _of(b"\n"),
}
COUNTS = ("n_words", *_CLASSES, "n_dup_lines", "n_repeat_words", "n_distinct_words", "longest_word")
DDL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
_WEIGHTS = np.stack(list(_CLASSES.values()), axis=1)
_PLAIN = lut(BLANKS, False)
_PLAIN[0] = 255


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


def _per_text(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element how often its text holds it, and whether it is the first of its kind (in some order)."""
    salted = mix(keys + owner.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(salted)
    ordered = salted[order]
    first = np.ones(len(order), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(order)))
    times = np.empty(len(order), np.int64)
    times[order] = np.repeat(counts, counts)
    lead = np.zeros(len(order), bool)
    lead[order[at]] = True
    return times, lead


def text_counts(texts: list[bytes]) -> np.ndarray:
    """One row of COUNTS for each text."""
    words, bounds = word_hashes(texts, _PLAIN)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n)
    histogram = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts])
    classes = histogram @ _WEIGHTS
    whole = max(0, len(words) - SHINGLE + 1)
    covered = np.zeros(len(words) + 1, np.int64)
    if whole:
        inside = np.flatnonzero(owner[:whole] == owner[SHINGLE - 1 :])
        windows = sum(words[j : j + whole] * _LANES[j] for j in range(SHINGLE))
        again = inside[_per_text(windows[inside], owner[inside])[0] > 1]
        np.add.at(covered, again, 1)
        np.subtract.at(covered, again + SHINGLE, 1)
    repeated = np.cumsum(covered)[:-1] > 0
    distinct = _per_text(words, owner)[1] if len(words) else np.zeros(0, bool)
    total = lambda mask: np.bincount(owner[mask], minlength=len(texts))
    longest = [max(map(len, t.split()), default=0) for t in texts]
    dups = [duplicate_lines(t) for t in texts]
    return np.column_stack([n, classes, dups, total(repeated), total(distinct), longest])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(batch.column(1)):
            rows = text_counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *[pa.array(rows[:, i], pa.int64()) for i in range(len(COUNTS))]], names=["doc_id", *COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row's whole text; null texts count as empty. Other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count, DDL)
