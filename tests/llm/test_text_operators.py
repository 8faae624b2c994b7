"""Operators on whole texts against brute force over small fixtures."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import chat_format, decontaminate, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, sharding, toxicity
from weftgraph.llm.fm_index import FMIndex, suffix_array
from weftgraph.llm.statistics import COUNTS, text_counts
from weftgraph.llm.tokens import LETTERS_LOWER, WORDS_LOWER, beginning_hashes, shingle_sets, word_hashes

DDL = "doc_id long, text string, lang string, source string, n_chars long, n long, cls string, slot int, label int, score double, host string"
BLANK = r"[^\x20\x09-\x0D]+"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions beneath old stone towers near misty rivers".split()


def prose(seed, n):
    g = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(g.integers(60)) for i in g.integers(len(WORDS), size=n))


def rows():
    """Copies, near copies, null and empty texts, repeated rows, a long text, ties, odd white space."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    far = " ".join(words[:60]) + " " + prose(2, 60)
    texts = [(1, base), (2, base), (3, near), (4, far), (5, None), (6, ""), (7, " \t\n\x0b "), (8, "one two three"), (9, "ONE two three"), (10, prose(3, 3000)), (11, base.upper().replace(" ", "\n")), (12, "a\x00b c d e f g"), (2, base), (2, near), (None, base), (13, "é ü é ü é ü é ü é ü é ü"), (14, "x " * 40)]
    return [(i, t, "en", None if i == 5 else f"s{(i or 0) % 3}", 0, 7, "c", 1, 1, 0.5, "h") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2, 3) for i in range(1, 15)] + [(None, 1, 0, 1), (3, None, None, 1), (4, 7, 7, 1)], "doc_id long, quality int, toxic int, score int")


def words(text, lower=True):
    text = text or ""
    return re.findall(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(data):
    sets = [shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if data[i][0] is None or data[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min(groups[find(i)]) if d is not None else None) for i, ((d, _), s) in enumerate(zip(data, sets))), key=str)


def test_ngram_join_equals_brute_force(docs):
    got = ngram_join.similarity_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components([(r[0], r[1]) for r in rows()])


def test_ngram_join_finds_links_at_the_threshold(spark):
    g = np.random.default_rng(5)
    data = []
    for k in range(60):
        n = int(g.integers(5, 260))
        base = [f"w{k}_{i}" for i in range(n)]
        data.append((len(data), " ".join(base)))
        for _ in range(3):
            copy = list(base)
            for at in g.integers(0, n, size=max(1, n // int(g.integers(25, 80)))):
                copy[at] = f"y{g.integers(1 << 40)}"
            data.append((len(data), " ".join(copy)))
    got = ngram_join.similarity_components(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(data)


@pytest.mark.parametrize("pairs", [4, 0])
def test_ngram_join_pairs_large_groups_across_components(spark, monkeypatch, pairs):
    """Texts that share a long passage but are no copies, with copies among them, in small blocks; by pairs or by whole sets within cells."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    comparer = ngram_join._comparer
    monkeypatch.setattr(ngram_join, "_comparer", lambda: _with_pairs(comparer(), pairs))
    passage = prose(9, 90)
    data = [(i, passage + " " + prose(100 + i // 2, 40 if i % 2 else 42)) for i in range(40)]
    got = ngram_join.similarity_components(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(data)


def _with_pairs(compare, pairs):
    def run(batches):
        from weftgraph.llm import ngram_join

        ngram_join.CELL_PAIRS = pairs
        yield from compare(batches)

    return run


def test_crowded_cells_are_linked_on_whole_sets():
    """What a task gets when its pairs are too many: a forest of the true links, none of the others."""
    texts = [prose(31, 300).split() for _ in range(1)] + []
    base = texts[0]
    texts = [" ".join([*base[: 7 * i], f"n{i}", *base[7 * i + 1 :]]) for i in range(12)] + [" ".join([*base[:150], *prose(40 + i, 150).split()]) for i in range(6)]
    sets = list(ngram_join.shingle_sets([t.encode() for t in texts]))
    n = len(texts)
    columns = [[5] * n, [0] * n, [0] * n, [0] * n, [ngram_join.short(ngram_join.digest(x)) for x in sets], list(range(n)), texts]
    batch = pa.RecordBatch.from_pydict({str(i): c for i, c in enumerate(columns)})
    links = [(a, b) for out in ngram_join._link_cells([batch.slice(0, 9), batch.slice(9)]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    at = {ngram_join.digest(x): i for i, x in enumerate(sets)}
    assert len(links) == 11 and all(at[a] < 12 and at[b] < 12 and ngram_join.linked(sets[at[a]], sets[at[b]]) for a, b in links) and len({x for p in links for x in p}) == 12


def test_dense_sketches_tell_long_sets_apart():
    """From 100 to 20,000 shingles: unrelated sets are refused, similar ones pass, also where sketches differ in width."""
    g = np.random.default_rng(11)
    for n in (100, 1000, 2300, 3000, 4100, 20_000):
        a, b = (np.unique(g.integers(1 << 62, size=n, dtype=np.uint64)) for _ in range(2))
        c = np.unique(np.concatenate([a[: int(0.9 * n)], g.integers(1 << 62, size=n // 20, dtype=np.uint64)]))
        for x, y, near in ((a, b, False), (a, c, True)):
            p, q = (ngram_join.dense_sketch(s)[None, :] for s in (x, y))
            longs = min(p.shape[1], q.shape[1])
            differ = int(np.bitwise_count((ngram_join.folded(p, longs) ^ ngram_join.folded(q, longs)).view(np.uint64)).sum())
            assert (9 * differ <= len(x) + len(y)) == near and (not near or differ <= len(np.setxor1d(x, y)))


def test_pairs_at_the_threshold_share_a_part():
    """Recall of the pigeonhole step on sets of up to 20,000 shingles, for pairs just above the threshold: 0.999 at least."""
    g = np.random.default_rng(12)
    met = total = 0
    for n, times in ((60, 400), (250, 300), (1000, 300), (5000, 80), (20_000, 20)):
        for _ in range(times):
            both = np.unique(g.integers(1 << 62, size=n, dtype=np.uint64))
            own = max(1, len(both) // 4)  # shared / union = 0.8 with the rest split over the sides
            x = np.sort(np.concatenate([both, g.integers(1 << 62, size=own // 2, dtype=np.uint64)]))
            y = np.sort(np.concatenate([both, g.integers(1 << 62, size=own - own // 2, dtype=np.uint64)]))
            if ngram_join.linked(x, y):
                total += 1
                met += len(np.intersect1d(ngram_join.part_keys(x), ngram_join.part_keys(y))) > 0
    assert total > 1000 and met >= 0.999 * total


def test_components_of_chains_and_stars(spark):
    from weftgraph.session import Scratch

    name = lambda k, i: f"{k:02d}{(i * 7919) % 1009:04d}".encode()
    links = [(name(0, i), name(0, i + 1)) for i in range(900)] + [(name(1, 0), name(1, i)) for i in range(1, 300)] + [(name(2, 1), name(2, 2))]
    got = {r.cls: r.root for r in ngram_join.components(spark.createDataFrame(links, "a binary, b binary").repartition(7), Scratch(spark, "test")).collect()}
    for k in range(3):
        own = {x for p in links for x in p if x.startswith(f"{k:02d}".encode())}
        assert {x for x in own if x not in got} == {min(own)} and all(bytes(got[x]) == min(own) for x in own - {min(own)})


def test_ngram_join_of_long_texts(spark):
    """Texts of 3,000 to 6,000 words with near copies, against brute force."""
    data = []
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(3000 + 250 * k)]
        for c in range(4):
            copy = list(base)
            for at in range(c, len(copy), (61, 47, 31, 23)[c]):
                copy[at] = f"y{k}q{c}q{at}"
            data.append((len(data), " ".join(copy)))
    got = ngram_join.similarity_components(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r[:3]) for r in got), key=str) == brute_components(data)
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == brute_links(data)


def brute_links(data):
    """For each row with how many other sets its own is similar, over rows with a doc_id."""
    kinds = {frozenset(shingles(t)) for d, t in data if d is not None} - {frozenset()}
    links = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in kinds) for a in kinds}
    return sorted(((d, links.get(frozenset(shingles(t)), 0)) for d, t in data), key=str)


@pytest.mark.parametrize("block", [8, 512])
def test_ngram_join_counts_every_link(spark, docs, monkeypatch, block):
    """Near copies of one text in one part or several, a chain whose ends aren't similar, and the odd rows."""
    monkeypatch.setattr(ngram_join, "COUNT_BLOCK", block)
    base = prose(21, 300).split()
    data = [(i, " ".join([*base[: 5 * i], f"copy{i}", *base[5 * i + 1 :]])) for i in range(40)]
    data += [(100 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))) for i in range(12)]
    for rows_, table in ((data, spark.createDataFrame(data, "doc_id long, text string")), ([(r[0], r[1]) for r in rows()], docs)):
        got = ngram_join.similarity_components(table).select("doc_id", "n_links").collect()
        assert sorted((tuple(r) for r in got if r[0] is not None), key=str) == [x for x in brute_links(rows_) if x[0] is not None]


def test_ngram_join_of_nothing(nothing):
    assert ngram_join.similarity_components(nothing).collect() == []
    assert ngram_join.one_of_each(nothing).collect() == []


def test_one_of_each_keeps_the_smallest(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[1, rows()[0][1]] == 1 and not any(d in (2, 3, 11) for d, _ in got)
    assert {d for d, _ in got} == {1, 4, 5, 6, 7, 8, 10, 12, 13, 14, None}


def test_sketch_distance_never_exceeds_the_difference():
    a, b = shingle_sets([prose(1, 400).encode(), (prose(1, 300) + " " + prose(8, 90)).encode()])
    differ = len(np.setxor1d(a, b))
    assert np.bitwise_count((ngram_join.dense_sketch(a) ^ ngram_join.dense_sketch(b)).view(np.uint64)).sum() <= differ


def test_word_hashes_follow_the_word_patterns():
    text = "A\tb\x0bc é\x00d x\r\ny  Zz9"
    for table, pattern in ((WORDS_LOWER, BLANK), (LETTERS_LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        found = re.findall(pattern, low)
        hashes, bounds = word_hashes([text.encode(), b"", low.encode()], table)
        assert np.diff(bounds).tolist() == [len(found), 0, len(found)]
        assert (hashes[: len(found)] == hashes[len(found) :]).all() and len(set(hashes.tolist())) == len(set(found))


def test_suffix_array_and_search():
    g = np.random.default_rng(0)
    text = g.integers(1, 5, size=400)
    text[100:200] = text[200:300]
    closed = np.append(text, 0)
    assert suffix_array(closed, 3).tolist() == sorted(range(401), key=lambda i: closed[i:].tolist())
    index = FMIndex(text, 4)
    for size in (1, 3, 7, 30):
        for start in (0, 17, 150, 390 - size):
            pattern = text[start : start + size]
            lo, hi = index.search(pattern[None, :], np.array([size]))
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == pattern).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def brute_contamination(data, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in data:
        w, hit, found = cut(t), set(), set()
        for length in {len(k) for k in windows}:
            for k in range(len(w) - length + 1):
                if (own := windows.get(tuple(w[k : k + length]))) is not None:
                    hit |= set(range(k, k + length))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 500)
    base = rows()[0][1].split()
    items = [(10, " ".join(base[10:40])), (9, " ".join(base[20:45]).upper()), (2, "one, TWO-three"), (3, None), (4, "..."), (None, base[0]), (10, "é ü é"), (5, prose(77, 30))]
    got = decontaminate.occurrences(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    want = brute_contamination([(r[0], r[1]) for r in rows()], items)
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    if block > 60:
        full = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).drop("spans").collect()
        assert sorted((tuple(r) for r in full), key=str) == want


@pytest.mark.parametrize("block", [2_000_000, 1000])
def test_contamination_heeds_the_order_of_words(spark, block):
    """Two rows of one doc_id with the same words, only one with the phrase; owners of a shared window and a long text too."""
    shared = prose(5, 13)
    data = [(1, "x y aa bb"), (1, "bb x y aa"), (1, "x y aa bb"), (2, prose(6, 30_000) + " " + shared + " " + prose(7, 5000)), (None, "aa bb")]
    items = [(1, "aa bb"), (7, "unknown words here"), *[(100 + i, shared + f" tail{i}") for i in range(50)]]
    got = decontaminate.occurrences(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    want = brute_contamination(data, items)
    assert sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in got), key=str) == sorted((w[:4] for w in want), key=str)


def test_contamination_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, none).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.clean_documents(docs, none).count() == docs.count()


def test_spans_are_cut(spark):
    df = spark.createDataFrame([("Keep THIS, drop-these two; keep.", [(2, 5)]), ("all", []), (None, None)], "text string, spans array<struct<start:long,end:long>>")
    assert [r[0] for r in df.select(decontaminate.cut_spans("text", "spans")).collect()] == ["Keep THIS, ; keep.", "all", None]


def brute_counts(text):
    t = text or ""
    w = words(t, lower=False)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(words(line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_counts_equal_brute_force():
    texts = [r[1] for r in rows()] + ["a b\na b\n\n\na b\n \n \n", "é # | é\né # | é", "a b c d e f a b c d e f a b c d e", "z " * 7]
    counts = text_counts([(t or "").encode() for t in texts])
    at = [COUNTS.index(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert [tuple(c[at]) for c in counts] == [brute_counts(t) for t in texts]


def test_judged_and_kept(docs, labels, nothing):
    got = quality_rules.judged(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    clashing = docs.withColumnsRenamed({"n": "n_words", "cls": "document", "slot": "word_chars"})
    assert quality_rules.kept_documents(clashing, labels).columns == clashing.columns
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judged(nothing, labels).collect() == [] and quality_rules.kept_documents(nothing, labels.limit(0)).collect() == []


def test_rules_are_learned_and_emitted(spark):
    g = np.random.default_rng(3)
    n = 600
    x = {k: g.random(n) for k in quality_rules.TESTS}
    bad = (x["symbols_per_char"] > 0.7) | ((x["upper_per_char"] > 0.6) & (x["exclaim_per_word"] > 0.6))
    rules = quality_rules.learn(x, bad, np.arange(n) % 3 > 0)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= r.covers(x)
    assert (hit == bad).mean() > 0.97 and 1 < len(rules) < 8
    row = spark.createDataFrame([(100, 1000, 900) + (0,) * (len(COUNTS) - 3)], ", ".join(f"{c} long" for c in COUNTS))
    rule = quality_rules.Rule([("symbols_per_char", True, 0.5), ("n_words", False, 200.0)])
    assert row.select(quality_rules.verdict([rule, rule]).alias("v")).first().v == 1 and row.select(quality_rules.verdict([]).alias("v")).first().v == 0


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.mark.parametrize("run, modulus, remainder, threshold", [(quality_classifier.quality_scores, 3, 1, 0.5), (toxicity.toxicity_scores, 4, 2, 0.3)])
def test_scores_are_whole(docs, labels, nothing, run, modulus, remainder, threshold):
    for marks in (labels, labels.limit(0)):
        got = run(docs, marks).collect()
        assert len(got) == docs.count()
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
            assert r.doc_id is None or r.held_out == (crc(r.doc_id) % modulus == remainder)
    assert run(nothing, labels).collect() == []


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    d, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    q = quality_classifier.quality_scores(d, marks).join(marks, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    t = toxicity.toxicity_scores(d, marks).join(marks, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert q > 0.97 and t[0] > 0.97 and t[1] > 0.9


def test_quadratic_scores_are_log_density_differences():
    g = np.random.default_rng(1)
    d = len(quality_classifier.FEATURES)
    a, b = g.normal(size=(400, d)), g.normal(1.0, 2.0, size=(300, d))
    moments = {k: (float(len(x)), x.sum(axis=0), x.T @ x) for k, x in enumerate((a, b))}
    model = quality_classifier.fit(moments, shrink=0.0, pool=0.0)
    x = g.normal(size=(5, d))
    logs = []
    for k, rows_ in enumerate((a, b)):
        n, s, ss = moments[k]
        c = ss / n - np.outer(s / n, s / n)
        pooled = sum(m[0] / 700 * (m[2] / m[0] - np.outer(m[1] / m[0], m[1] / m[0])) for m in moments.values())
        c = c + (1e-4 + 1e-3 * np.diag(pooled).mean()) * np.eye(d)
        e = x - s / n
        logs.append(np.log(n / 700) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    assert np.allclose(model.difference(x), logs[1] - logs[0], rtol=1e-6, atol=1e-4)


def test_quadratic_scores_keep_the_order_of_differences():
    """Also for labels that a line separates, where the slope has to stay finite."""
    g = np.random.default_rng(6)
    d = len(quality_classifier.FEATURES)
    x = np.concatenate([g.normal(size=(3000, d)), g.normal(4.0, 3.0, size=(3000, d))])
    label = np.repeat([0.0, 1.0], 3000)
    fold = np.arange(6000) % quality_classifier.FOLDS
    model = quality_classifier.fit(quality_classifier.moments_of(x, label), *quality_classifier.chosen(x, label, fold))
    model.calibrate(x, label)
    score, difference = model.score(x), model.difference(x)
    assert 0.05 <= model.slope <= 5 and abs(model.intercept) < 20 and len(np.unique(score)) > 5900
    assert (np.diff(score[np.argsort(difference)]) >= 0).all() and ((score >= 0.5) == (label == 1)).mean() > 0.99


def test_quality_scores_take_many_values(spark):
    d, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = [r.score for r in quality_classifier.quality_scores(d, marks).collect()]
    assert len(set(got)) > 0.8 * len(set(r.text for r in d.collect())) and 0 < min(got) and max(got) < 1


def test_beginnings_are_letters():
    texts = ["Жаба жабами abcdef abc été étés".encode(), b"", "жаб".encode()]
    four = beginning_hashes(texts, LETTERS_LOWER, (3,))[0]
    assert four[2] != 0 and [bool(x) for x in four] == [True, True, True, False, False, True, False]
    assert beginning_hashes(["жабы".encode()], LETTERS_LOWER, (3,))[0][0] == four[1] == beginning_hashes(["жабо".encode()], LETTERS_LOWER, (3,))[0][0] and four[0] != four[1]


def test_isotonic_curve_rises():
    g = np.random.default_rng(2)
    m = g.normal(size=500)
    y = (g.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at, rate = toxicity.isotonic(m, y)
    assert (np.diff(at) > 0).all() and (np.diff(rate) > 0).all() and abs(np.interp(0, at, rate) - 0.5) < 0.2


def test_trees_learn_an_interaction():
    g = np.random.default_rng(4)
    x = np.zeros((2000, len(toxicity.FEATURES)))
    x[:, :3] = g.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    trees = toxicity.boosted(x, y)
    assert ((trees.score(x) > 0.5) == (y == 1)).mean() > 0.97


def test_shards_law_and_slots(docs, nothing):
    got = sharding.shard_table(docs).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"key"}
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert all(len(v) == 1 for v in by_id.values())
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard_table(nothing).collect() == []
    wide = sharding.sharded_documents(docs).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in wide) == Counter((i, t, next(iter(by_id[i]))[0]) for i, t, *_ in rows())
    assert sorted((r.shard, r.slot) for r in wide) == sorted((r.shard, r.slot) for r in got)


def test_growth_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(20000).selectExpr("id as doc_id", "cast(null as string) as text")
    got = sharding.keyed(ids).groupBy("shard", "grown_shard").count().collect()
    sizes, moved = Counter(), 0
    for r in got:
        assert r.grown_shard in (r.shard, 8)
        sizes[r.shard] += r["count"]
        moved += r["count"] * (r.grown_shard == 8)
    assert max(sizes.values()) < 1.15 * min(sizes.values()) and abs(moved - 20000 / 9) < 250
    heavy = tuple(sharding.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 0 else 1.0) for x in sharding.EIGHT)
    both = ids.select(sharding.shard_of(ids.doc_id.cast("string"), sharding.EIGHT).alias("was"), sharding.shard_of(ids.doc_id.cast("string"), heavy).alias("now")).groupBy("was", "now").count().collect()
    moves = {(r.was, r.now): r["count"] for r in both if r.was != r.now}
    assert sum(r["count"] for r in both if r.now == 0) > 5000
    # A changed weight draws keys along its path only: into its region, within it into its rack, within that to the shard.
    region, rack = {0, 1, 2, 3}, {0, 1}
    for was, now in moves:
        assert now in region if was not in region else now in rack if was not in rack else now == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixture_meets_targets(spark, docs, nothing):
    got = mixing.mixture(docs).collect()
    sizes = Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += len(words(t))
    want = brute_targets(dict(sizes))
    source = {i: s for i, _, _, s, *_ in rows()}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-4 and 0 <= r.taken <= 3 * r["size"]
        assert (r.position is None) == (r.passes == 0)
        taken[s] += r.taken
        longest[s] = max(longest[s], r["size"])
    assert len(got) == docs.count() and all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixture(docs.repartition(3)).collect()))
    stream = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert stream == Counter(x for r in got for x in [r.doc_id] * r.passes)
    assert mixing.mixture(nothing).collect() == [] and mixing.mixed_documents(nothing).collect() == []


def test_lines_that_a_site_repeats_go(spark):
    page = lambda lines: "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "<script>var x</script><!-- c --></body></html>"
    data = [(i, f"http://A.example.com:80/{i}", page(["Menu", f"own {i} &amp; more", "<b>Menu</b>"]), "x") for i in range(8)]
    data += [(20 + i, f"https://b.example.com/{i}", page(["Menu" if i == 0 else f"t{i}", "rare"][: 1 + (i < 1)]), "x") for i in range(6)]
    data += [(30, None, page(["Menu"]), "x"), (31, "nonsense", None, "x"), (32, "http://c.example.com", "", "x"), (0, "http://a.example.com/0", data[0][2], "x")]
    got = {}
    for r in line_dedup.deduplicated(spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got[0]) == 2 and got[1][0].text == "own 1 & more" and got[1][0].n_dropped == 2 and got[1][0].host == "a.example.com"
    assert got[20][0].text == "Menu\nrare" and got[30][0].text == "Menu" and got[31][0].n_lines == 0 and got[32][0].text == ""
    assert line_dedup.deduplicated(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_rotation_gives_each_speaker_a_view(spark):
    data = [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi <|assistant|> all", 9), (1, 2, "bob", "yo", 9), (1, 3, "ann", None, 9), (1, 3, "ann", None, 9), (1, 4, None, "?", 9), (2, 0, "system", "alone", 9), (None, 0, "ann", "lost", 9), (3, None, "u", "x", 9), (4, 300, "u", "late", 9), (4, 1, "u", "early", 9)]
    got = {(r.conv_id, r.speaker): r for r in chat_format.rotated(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, piece int")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "u"), (4, "u")}
    ann = got[1, "ann"]
    assert ann.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |assistant|> all<|end|>\n<|user:bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n<|user:unknown|>\n?<|end|>\n"
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["hi < |assistant|> all<|end|>", "<|end|>"] and ann.n_turns == 5 and ann.n_spoken == 2
    assert [got[1, "bob"].text[m.start : m.end] for m in got[1, "bob"].masks] == ["yo<|end|>"] and got[4, "u"].text.index("early") < got[4, "u"].text.index("late")
    assert chat_format.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def brute_rotation(data):
    safe = lambda x: (x or "").replace("<|", "< |")
    turns = sorted({(c, t, r or "unknown", safe(x)) for c, t, r, x in data if c is not None}, key=lambda v: (v[0], v[1] is not None, v[1] or 0, hashlib.md5(f"{v[2]}|{v[3]}".encode()).hexdigest(), v[2:]))
    out = {}
    for c, s in {(v[0], v[2]) for v in turns if v[2] != "system"}:
        text, masks = "", []
        for _, _, r, x in [v for v in turns if v[0] == c]:
            text += "<|" + ("assistant" if r == s else "system" if r == "system" else "user:" + safe(r)) + "|>\n"
            if r == s:
                masks.append((len(text), len(text) + len(x) + 7))
            text += x + "<|end|>\n"
        out[c, s] = (text, masks)
    return out


@pytest.mark.parametrize("turns, rows_", [(256, 1024), (7, 5), (1, 1)])
def test_rotation_of_long_dialogues_is_whole(spark, turns, rows_):
    """600 turns, 700 turns without a number, 500 of one number: each speaker gets one row with the system turn, however work is split."""
    roles = ["ann", "bob", "cäc"]
    data = [(1, 0, "system", "be kind"), (2, None, "system", "be brief"), *[(1, i, roles[i % 3], f"say {i} é") for i in range(1, 600)], *[(2, None, roles[i % 2], f"x{i}") for i in range(700)], *[(3, 5, roles[i % 3], f"y{i}" * (i % 9)) for i in range(500)], (4, -300, "ann", "before"), (4, None, "bob", None)]
    got = chat_format.rotated(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), turns, rows_).collect()
    assert {(r.conv_id, r.speaker): (r.text, [(m.start, m.end) for m in r.masks]) for r in got} == brute_rotation(data) and len(got) == 3 + 2 + 3 + 2
    assert all(r.n_turns == len(r.messages) and r.n_spoken == sum(m.learn for m in r.messages) for r in got)


def test_fixed_tables_are_json_plain():
    assert json.dumps(sorted(toxicity.INSULTS)) and len(toxicity.INSULTS) < 200
