"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about SHARD_WORDS words in one task. Its words become
symbols: each word of the benchmark has its own; any run of other words is one separator,
since no phrase can reach over it. Test phrases (windows of 13 words) are searched backward
through wavelet ranks, their occurrences are located by sampled suffix positions, and the
spans of a document are merged. Phrases with a word that the shard hasn't are not searched.
Documents never move: the one scan is all that is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftgraph.llm.fm_index import FMIndex
from weftgraph.llm.tokens import CHUNK, LETTERS_LOWER, U, chunks, word_hashes
from weftgraph.session import Scratch, ship

WINDOW = 13
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text that go to the tasks at a time, each such block in a pass over the documents; results don't depend on it.
BLOCK_BYTES = 16_000_000
#: Phrases that are searched at a time in a shard's index.
SEARCHED = 100_000
#: Ids of contaminated documents that may be broadcast (8 MB); more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


class Phrases:
    """Distinct windows of benchmark items as stretches of ``symbols`` (1 is the separator, 0 is no symbol), and the items that own them."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int = WINDOW):
        self.window = window
        hashes, sizes = [np.zeros(0, U)], []
        for _, part in chunks(pa.array([(t or "").encode() for t in texts], pa.large_binary()), CHUNK):
            words, bounds = word_hashes(part, LETTERS_LOWER)
            hashes.append(words)
            sizes += np.diff(bounds).tolist()
        words, n = np.concatenate(hashes), np.array(sizes, np.int64)
        self.vocabulary = np.unique(words)
        self.symbols = (np.searchsorted(self.vocabulary, words) + 2).astype(np.int32)
        counts = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        owner = np.repeat(np.array(ids, np.int64), counts)
        self.starts = np.repeat(np.cumsum(n) - n, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.lengths = np.repeat(np.minimum(n, window), counts)
        rows = np.ascontiguousarray(self.patterns(np.arange(len(owner))).astype(np.int32))
        _, first, kind = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
        self.starts, self.lengths = self.starts[first], self.lengths[first]
        # Windows with the same owners share one list of them.
        order = np.lexsort((owner, kind))
        kind, owner = kind[order], owner[order]
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
        kind, owner = kind[new], owner[new]
        edges = np.searchsorted(kind, np.arange(len(first) + 1)).tolist()
        known: dict[bytes, int] = {}
        self.owned = np.array([known.setdefault(owner[a:b].tobytes(), len(known)) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.int64)
        self.owners = [np.frombuffer(x, np.int64) for x in known]
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.vocabulary >> U(48)).astype(np.int64)] = True

    def patterns(self, which: np.ndarray) -> np.ndarray:
        """Right-aligned symbol rows of these windows."""
        at = np.arange(self.window)[None, :] + (self.starts[which] + self.lengths[which] - self.window)[:, None]
        out = self.symbols[np.clip(at, 0, max(0, len(self.symbols) - 1))].astype(np.int64) if len(which) else np.zeros((0, self.window), np.int64)
        out[at < self.starts[which][:, None]] = 0
        return out

    def within(self, present: np.ndarray) -> np.ndarray:
        """The windows all of whose symbols are present."""
        absent = np.concatenate(([0], np.cumsum(~present[self.symbols])))
        return np.flatnonzero(absent[self.starts + self.lengths] == absent[self.starts])

    def symbols_of(self, words: np.ndarray) -> np.ndarray:
        """Symbols of hashed words; 1 where the benchmark hasn't the word."""
        out = np.ones(len(words), np.int64)
        maybe = np.flatnonzero(self.known[(words >> U(48)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == words[maybe]
        out[maybe[same]] = at[same] + 2
        return out

    def items(self, which: np.ndarray) -> list[int]:
        """The items that own any of these windows, ascending; owners are merged list by list, so memory goes with the result."""
        out = np.zeros(0, np.int64)
        for k in np.unique(self.owned[which]).tolist():
            out = np.union1d(out, self.owners[k])
        return out.tolist()


def shard_hits(words: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each document (its words' symbols) the merged hit spans [start, end) in words and the items found."""
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator stands before each document
    full = np.ones(int(begins[-1]), np.int64)
    for begin, w in zip(begins.tolist(), words, strict=False):
        full[begin + 1 : begin + 1 + len(w)] = w
    out: list[tuple[list[tuple[int, int]], list[int]]] = [([], []) for _ in words]
    present = np.zeros(len(phrases.vocabulary) + 2, bool)
    present[full] = True
    wanted = phrases.within(present)
    if not len(wanted):
        return out
    kept = np.flatnonzero((full != 1) | np.concatenate(([True], full[:-1] != 1)))
    index = FMIndex(full[kept], len(phrases.vocabulary) + 1)
    rise = np.zeros(len(full) + 1, np.int64)
    pairs = []
    for first in range(0, len(wanted), SEARCHED):
        which = wanted[first : first + SEARCHED]
        lo, hi = index.search(phrases.patterns(which), phrases.lengths[which])
        found = np.flatnonzero(hi > lo)
        counts = hi[found] - lo[found]
        rows = np.repeat(lo[found] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        at = kept[index.locate(rows)]
        pattern = np.repeat(which[found], counts)
        rise += np.bincount(at, minlength=len(rise)) - np.bincount(at + phrases.lengths[pattern], minlength=len(rise))
        pairs.append(np.unique(np.column_stack([np.searchsorted(begins, at, side="right") - 1, pattern]), axis=0))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(rise) > 0).astype(np.int8), [0]))))
    doc = np.searchsorted(begins, edges[::2], side="right") - 1
    for d, s, e in zip(doc.tolist(), (edges[::2] - begins[doc] - 1).tolist(), (edges[1::2] - begins[doc] - 1).tolist(), strict=True):
        out[d][0].append((s, e))
    both = np.concatenate(pairs)
    if not len(both):
        return out
    both = both[np.argsort(both[:, 0], kind="stable")]
    cuts = np.flatnonzero(np.diff(both[:, 0], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(both)], strict=True):
        out[int(both[a, 0])][1].extend(phrases.items(both[a:b, 1]))
    return out


_HITS = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64())),
])
_HITS_DDL = "doc_id long, text_key binary, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _scanner(phrases: Phrases):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        place: list[int] = []  # of each document among the shard's distinct texts
        seen: dict[bytes, int] = {}
        words: list[np.ndarray] = []
        keys: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hits = shard_hits(words, phrases)
            columns = [ids, [keys[p] for p in place], [len(words[p]) for p in place], [[{"start": s, "end": e} for s, e in hits[p][0]] for p in place], [hits[p][1] for p in place]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HITS, strict=True)], schema=_HITS)

        for batch in batches:
            column = batch.column(0).to_pylist()
            for first, texts in chunks(batch.column(1)):
                hashed, bounds = word_hashes(texts, LETTERS_LOWER)
                symbols = phrases.symbols_of(hashed)
                for i, text in enumerate(texts):
                    if text not in seen:
                        seen[text] = len(words)
                        words.append(symbols[bounds[i] : bounds[i + 1]].astype(np.int32))
                        keys.append(hashlib.blake2b(hashed[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest())
                        size += len(words[-1])
                    ids.append(column[first + i])
                    place.append(seen[text])
                if size >= SHARD_WORDS:
                    yield flush()
                    ids, place, seen, words, keys, size = [], [], {}, [], [], 0
        if ids:
            yield flush()

    return scan


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged, in words, [start, end)), items (ids with an occurring window, ascending).

    Null or wordless texts have no words and no hits; repeated rows give repeated results; items
    without id or words are no phrases; items of one id count as one; other columns are ignored.
    The benchmark goes to the tasks in blocks of about ``block_bytes``, each a pass over the documents; the passes'
    rows meet by doc_id and a digest of the words, and rows that are equal in both are equal in their results.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    blocks = -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // block_bytes)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    passes = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        passes.append(texts.mapInArrow(_scanner(Phrases([r.item_id for r in rows], [r.text for r in rows], window)), _HITS_DDL))
    if blocks == 1:
        return passes[0].drop("text_key")
    every = None
    for block, one in enumerate(passes):
        # Equal rows of a pass are counted first, so a key meets one row for each pass.
        one = one.groupBy("doc_id", "text_key", "n_words").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count(F.lit(1)).alias("rows"))
        every = one if every is None else every.unionByName(one)
    merged = every.groupBy("doc_id", "text_key", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("rows").alias("rows"))
    last = "element_at(acc, -1)"
    join = f"""aggregate(all_spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
        case when size(acc) > 0 and s.start <= {last}.end
             then concat(slice(acc, 1, size(acc) - 1), array(struct({last}.start as start, greatest({last}.end, s.end) as end)))
             else concat(acc, array(s)) end)"""
    return merged.select("doc_id", "n_words", F.expr(join).alias("spans"), "items", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row")).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    contaminated: n_hit > 0 and 20 * n_hit >= n_words. items_sha256 is the lowercase hex digest of the
    ids as strings, sorted as strings, comma-joined (of the empty string without items).
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = occurrences(docs, benchmark).withColumn("n_hit", hit)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@F.pandas_udf(StringType())
def cut_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text without its spans of words; what stands between spans stays as it is."""
    import re

    out = []
    for t, cuts in zip(text, spans, strict=True):
        if t is None or cuts is None or not len(cuts):
            out.append(t)
            continue
        words = [m.span() for m in re.finditer(_WORD, t.translate({c: c + 32 for c in range(65, 91)}))]
        left, parts = 0, []
        for cut in cuts:
            parts.append(t[left : words[cut["start"]][0]])
            left = words[cut["end"] - 1][1]
        out.append("".join([*parts, t[left:]]))
    return pd.Series(out, dtype=object)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, columns as they came. Documents with fewer hits stay whole.

    All rows of a contaminated doc_id go; rows without doc_id have no name to be struck by, so they stay. Repeated
    rows stay repeated, null and empty texts stay; a column named hit_id or like any of the operator's own is no matter.
    """
    found = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("__hit_id")).distinct()
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = scratch.save(found)
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    return docs.join(found, F.col("doc_id").cast("long") == F.col("__hit_id"), "left_anti")
