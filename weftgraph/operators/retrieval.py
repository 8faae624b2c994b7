"""Retrieval: lexical search, BM25, vector search, rank fusion, context budget, document building."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that a query drops.
STOP_WORDS = ["a", "an", "and", "are", "do", "does", "how", "in", "is", "it", "of", "on", "the", "to", "used", "uses", "using", "what", "where", "which"]
RRF_K = 60
CHUNK_LINES, OVERLAP = 120, 20
MOST_TOKENS = 4000
BM25_K, BM25_B = 1.2, 0.75


def query_tokens(query: str) -> list[str]:
    """Distinct words of letters, digits, _ and $ (which is stripped), without stop words, in order."""
    words = [w.replace("$", "") for w in re.findall(r"[\w$]+", query)]
    return list(dict.fromkeys(w for w in words if w and w.lower() not in STOP_WORDS))


def identifier_parts(name: Column) -> Column:
    """Lower-cased parts of an identifier: camel humps and runs of letters and digits."""
    humps = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.filter(F.transform(F.split(humps, r"[^\p{L}\p{N}]+"), lambda x: F.lower(x)), lambda x: x != "")


def parts_of(token: str) -> list[str]:
    humps = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=\d)(?=[A-Z])", " ", token)
    return [p.lower() for p in re.split(r"[\W_]+", humps) if p]


def search_terms(query: str) -> list[str]:
    """Tokens in lower case, and the parts of those that have several."""
    out: list[str] = []
    for token in query_tokens(query):
        parts = parts_of(token)
        out += [token.lower(), *(parts if len(parts) > 1 else [])]
    return list(dict.fromkeys(out))


def owner_names(query: str) -> list[str]:
    """Tokens and all joined runs of neighbouring tokens, lower-cased: what an owner may be called."""
    tokens = [t.lower() for t in query_tokens(query)]
    return list(dict.fromkeys(tokens + ["".join(tokens[i:j]) for i in range(len(tokens)) for j in range(i + 2, len(tokens) + 1)]))


def _coverage(text: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0)) / float(len(terms))


def lexical_scores(documents: DataFrame, query: str) -> DataFrame:
    """Matching documents with exact_name, name_coverage, file_coverage, content_coverage and score (lower is better)."""
    terms = search_terms(query)
    if not terms:
        return documents.withColumns({c: F.lit(0.0) for c in ("exact_name", "name_coverage", "file_coverage", "content_coverage", "score")}).limit(0)
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("content", "file", "symbol_name", "qualified_name")]
    hit = F.greatest(*[f.contains(t) for f in fields for t in terms])
    name, qualified = fields[2], fields[3]
    owner = F.when(F.instr(qualified, ".") > 0, F.substring_index(qualified, ".", 1)).otherwise(F.lit(""))
    owned = owner.isin(*owner_names(query)) if owner_names(query) else F.lit(False)
    names = sum(((name.contains(t) | (owned & qualified.contains(t))).cast("int") for t in terms), F.lit(0)) / float(len(terms))
    rows = documents.filter(hit).withColumns({
        "exact_name": (name.isin(*terms) | qualified.isin(*terms)).cast("double"), "name_coverage": names.cast("double"),
        "file_coverage": _coverage(F.col("file"), terms), "content_coverage": _coverage(F.col("content"), terms),
    })
    return rows.withColumn("score", -(4 * F.col("exact_name") + 2 * F.col("name_coverage") + F.col("file_coverage") + 0.5 * F.col("content_coverage")))


LEXICAL_ORDER = ("exact_name", "name_coverage", "file_coverage", "content_coverage")


def lexical_search(documents: DataFrame, query: str, limit: int = 20, file_prefix: str | None = None) -> DataFrame:
    """rank, document_id, file, score and the coverages of the best documents.

    A query of one bare identifier that names several logical targets exactly is ambiguous: its rows
    score 0 and come by file and line, and those that it names share a rank group. So do methods of one name and
    score that the rest of the query tells apart by the same parts of their owners' names.
    """
    rows = lexical_scores(documents, query)
    if file_prefix:
        rows = rows.filter(F.col("file").startswith(file_prefix))
    order = [*[F.desc(c) for c in LEXICAL_ORDER], F.col("file"), F.col("start_line"), F.col("document_id")]
    bare = bare_identifier(query)
    group = F.lit(None).cast("string")
    if bare and ambiguous_targets(documents.filter(F.col("file").startswith(file_prefix)) if file_prefix else documents, bare) > 1:
        order, group = order[4:], F.when(names_exactly(bare), F.lit(f"bare-exact:{bare}"))
        rows = rows.withColumn("score", F.lit(0.0))
    top = rows.orderBy(*order).limit(max(0, limit)).withColumn("owner_group", owner_group(query))
    # At most ``limit`` rows are left here.
    several = F.count(F.lit(1)).over(Window.partitionBy("owner_group")) > 1
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "document_id", "file", "start_line", "score", *LEXICAL_ORDER, F.coalesce(group, F.when(several, F.col("owner_group"))).alias("rank_group"))


def bare_identifier(query: str) -> str | None:
    """The query as one identifier, lower-cased and without $; None where it isn't one."""
    return (query.strip().replace("$", "").lower() or None) if re.fullmatch(r"(?:[^\W\d]|\$)[\w$]*", query.strip()) else None


def names_exactly(bare: str) -> Column:
    """Whether a document's symbol or qualified name is the identifier, or begins with it as a word."""
    plain = lambda c: F.lower(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("$"), F.lit("")))
    out = F.lit(False)
    for c in ("symbol_name", "qualified_name"):
        out = out | (plain(c) == bare) | plain(c).startswith(bare + " ")
    return out


def owner_group(query: str) -> Column:
    """What methods share whose owners the query names alike: name, the parts of the query that the owner alone has, and score; null for others."""
    asked = list(dict.fromkeys(p for t in query_tokens(query) for p in parts_of(t)))
    if not asked:
        return F.lit(None).cast("string")
    own, whole = identifier_parts(F.coalesce("symbol_name", F.lit(""))), identifier_parts(F.coalesce("qualified_name", F.lit("")))
    evidence = F.array_sort(F.filter(F.array(*[F.lit(p) for p in asked]), lambda p: ~F.array_contains(own, p) & F.array_contains(whole, p)))
    holds = (F.col("symbol_type") == "method") & (F.size(F.array_distinct(whole)) > F.size(F.array_distinct(own))) & (F.size(evidence) > 0)
    return F.when(holds, F.concat_ws(":", F.lit("owner-context"), F.lower("symbol_name"), F.array_join(evidence, "+"), F.col("score").cast("string")))


def logical_targets(rows: DataFrame) -> DataFrame:
    """Islands of overlapping line ranges of one file and symbol: file, symbol_name, island, start_line, end_line, chunks."""
    key = ["file", "symbol_name", "qualified_name", "symbol_type"]
    order = Window.partitionBy(*key).orderBy("start_line", F.desc("end_line"), "document_id")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start_line") > before), 1).otherwise(0)
    rows = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("chunks"))


def ambiguous_targets(documents: DataFrame, bare: str) -> int:
    return logical_targets(documents.filter(names_exactly(bare))).limit(2).count()


def _equals(word: str):
    return lambda x: x == word


def bm25(documents: DataFrame, query: str, limit: int = 20, text: str = "content", k: float = BM25_K, b: float = BM25_B) -> DataFrame:
    """rank, document_id, score by BM25 over whole words; one pass for lengths and term counts, one row of statistics."""
    terms = [t.lower() for t in query_tokens(query)]
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    rows = documents.select("document_id", words.alias("words")).select("document_id", F.size("words").alias("length"), *[F.size(F.filter("words", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k + 1) / (tf + k * (1 - b + b * F.col("length") / F.col("mean")))
    hit = F.greatest(*[F.col(f"tf{i}") > 0 for i in range(len(terms))]) if len(terms) > 1 else (F.col("tf0") > 0 if terms else F.lit(False))
    top = scored.filter(hit).select("document_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "document_id").limit(max(0, limit))
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "document_id")).cast("long").alias("rank"), "document_id", "score")


#: Weights of a document's fields.
FIELD_WEIGHTS = {"symbol_name": 4.0, "qualified_name": 3.0, "file": 1.5, "content": 1.0}


def bm25_fields(documents: DataFrame, query: str, limit: int = 20, weights: dict[str, float] | None = None, k: float = BM25_K, b: float = BM25_B) -> DataFrame:
    """rank, document_id, score by BM25 over several fields: a term's frequency is the weighted sum over the fields, a document's length that of all fields.

    The inverse frequency is ln((n - df + 0.5) / (df + 0.5)), one millionth at least, df counting documents with the term in any field.
    """
    weights = weights or FIELD_WEIGHTS
    terms = [t.lower() for t in query_tokens(query)]
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    words = documents.select("document_id", *[split(c).alias(f"w_{c}") for c in weights])
    tf = [sum((F.size(F.filter(f"w_{c}", _equals(t))) * w for c, w in weights.items()), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = words.select("document_id", sum((F.size(f"w_{c}") for c in weights), F.lit(0)).alias("length"), *tf)
    if not terms:
        return rows.limit(0).select(F.lit(0).cast("long").alias("rank"), "document_id", F.lit(0.0).alias("score"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf_, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        score = score + idf * tf_ * (k + 1) / (tf_ + k * (1 - b + b * F.col("length") / F.col("mean")))
    hit = F.array_max(F.array(*[F.col(f"tf{i}") for i in range(len(terms))])) > 0
    top = rows.filter(hit).crossJoin(F.broadcast(stats)).select("document_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "document_id").limit(max(0, limit))  # stats is one row
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "document_id")).cast("long").alias("rank"), "document_id", "score")


def vector_search(vectors: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """rank, point_id, score by cosine in doubles; vectors of another length or of norm 0 are skipped. Brute force, in the JVM."""
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
    wide = F.transform("vector", lambda x: x.cast("double"))
    rows = vectors.filter(F.size("vector") == len(q)).select("point_id", wide.alias("v"))
    rows = rows.select("point_id", total(F.zip_with("v", F.array(*[F.lit(x) for x in q]), lambda a, b: a * b)).alias("dot"), F.sqrt(total(F.transform("v", lambda a: a * a))).alias("norm"))
    if not norm:
        rows = rows.limit(0)
    top = rows.filter("norm > 0").select("point_id", F.round(F.col("dot") / (F.col("norm") * norm), 9).alias("score")).orderBy(F.desc("score"), "point_id").limit(max(0, limit))
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "point_id")).cast("long").alias("rank"), "point_id", "score")


def fused(vector: DataFrame, lexical: DataFrame, limit: int = 20, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) and (key, rank, rank_group): key, vector_rank, lexical_rank, score, rank.

    Lexical rows of one rank group share the rank of their first. Equal scores keep the order of insertion: vector rows first.
    """
    shared = F.when(F.col("rank_group").isNotNull(), F.min("rank").over(Window.partitionBy("rank_group"))).otherwise(F.col("rank"))
    lex = lexical.select("key", shared.alias("lexical_rank"), F.col("rank").alias("place"))
    rows = vector.select("key", F.col("rank").alias("vector_rank")).join(lex, "key", "full_outer")
    score = F.coalesce(1 / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("lexical_rank")), F.lit(0.0))
    order = [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("place"), F.col("key")]
    top = rows.withColumn("score", F.round(score, 12)).orderBy(*order).limit(max(0, limit))
    return top.select("key", "vector_rank", "lexical_rank", "score", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def token_count(text: Column) -> Column:
    """Words between white space; 0 for blank text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def context_block(nth: Column, score: Column) -> Column:
    """A document's block in the rendered context; documents have file, symbol_name, symbol_type, start_line, end_line, content."""
    known = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    lines = [
        F.concat(F.lit("## Context "), nth.cast("string")), F.concat(F.lit("File: "), known("file", "unknown")), F.concat(F.lit("Symbol: "), known("symbol_name", "unknown")), F.concat(F.lit("Type: "), known("symbol_type", "unknown")),
        F.concat(F.lit("Lines: "), known("start_line", "?"), F.lit("-"), known("end_line", "?")), F.concat(F.lit("Score: "), F.format_string("%.4f", score)), F.lit(""), F.coalesce("content", F.lit("")),
    ]
    return F.concat_ws("\n", *lines)


#: Tokens of what stands between two blocks: one rule.
BETWEEN = 1


def rendered_context(documents: DataFrame) -> DataFrame:
    """(context): the blocks of the ranked documents (rank, score and what `context_block` reads) with a rule between them."""
    block = F.struct("rank", context_block(F.row_number().over(Window.orderBy("rank")), F.col("score")).alias("block"))
    return documents.select(block.alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n---\n\n").alias("context"))


def greedy_budget(items: DataFrame, budget: int = MOST_TOKENS) -> DataFrame:
    """(rank, tokens) of blocks into rank, tokens, included: tokens of the context rendered with the item, and whether it is taken.

    An item is tested with what is used plus the whole rendering it would make, which counts what is used twice; a later
    small item may fit where an earlier one didn't. The items are a ranked list of at most some hundreds (retrieval's limits), folded in one row.
    """
    ordered = items.agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), F.col("tokens").cast("long").alias("tokens")))).alias("items"))
    decided = "array<struct<rank:bigint,tokens:bigint,included:boolean>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as {decided})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        rendered = acc["used"] + x["tokens"] + F.when(acc["used"] > 0, BETWEEN).otherwise(0)
        fits = acc["used"] + rendered <= budget
        return F.struct(F.when(fits, rendered).otherwise(acc["used"]).cast("long").alias("used"), F.concat(acc["out"], F.array(F.struct(x["rank"].alias("rank"), rendered.cast("long").alias("tokens"), fits.alias("included")))).alias("out"))

    return ordered.select(F.explode(F.aggregate("items", start, step)["out"]).alias("x")).select("x.*")


def split_chunks(documents: DataFrame, lines: int = CHUNK_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of long documents: document_id, chunk, start_line, end_line, content."""
    step = lines - overlap
    split = documents.withColumn("all_lines", F.split("content", "\n"))
    n = F.size("all_lines")
    starts = F.when(n <= lines, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1 - overlap, F.lit(step)))
    rows = split.select("document_id", "start_line", "all_lines", F.posexplode(starts).alias("chunk", "at"))
    last = F.least(F.col("at") + lines, F.size("all_lines"))
    return rows.select("document_id", F.col("chunk").cast("long").alias("chunk"), (F.col("start_line") + F.col("at")).cast("long").alias("start_line"), (F.col("start_line") + last - 1).cast("long").alias("end_line"), F.array_join(F.slice("all_lines", F.col("at") + 1, F.lit(lines)), "\n").alias("content"))


def searchable_identifier(name: Column) -> Column:
    """The identifier followed by its parts."""
    return F.concat_ws(" ", name, F.array_join(identifier_parts(name), " "))


def snippet(text: Column, width: int = 160) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def embedding_text(kind: Column, name: Column, file: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.concat_ws(" ", kind, name), F.concat(F.lit("File: "), file), content)


def missing_vectors(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents whose embedding text has no stored vector yet, by hash of the text."""
    return documents.withColumn("text_hash", F.sha2("embedding_text", 256)).join(vectors.select("text_hash").distinct(), "text_hash", "left_anti")


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """(key, source, rank) rows into one per key: sources (distinct, sorted), best rank."""
    return chunks.groupBy("key").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.min("rank").alias("rank"))


def inspect_retrieval(documents: DataFrame, vectors: DataFrame, query: str, vector: list[float], top_k: int = 20, rerank: int = 5, budget: int = MOST_TOKENS, scores: DataFrame | None = None, related: DataFrame | None = None) -> DataFrame:
    """All stages in one table: key, sources, vector_rank, lexical_rank, fused_rank, reranked (the first ``rerank``), place, tokens, included.

    scores: (key, rerank_score), as `sources.scip.rerank` gives them; the first ``rerank`` of the fused results come by them, best first, the
    others as they were. related: (key, nth) documents around the results, as `traverse.expand` finds them; those that aren't
    results themselves follow them. The budget goes by place. At most 50 results and the related ones are numbered.
    """
    top_k = max(1, min(50, top_k))
    lex = lexical_search(documents, query, top_k).select(F.col("document_id").alias("key"), "rank", "rank_group")
    vec = vector_search(vectors, vector, top_k).select(F.col("point_id").alias("key"), "rank")
    rows = fused(vec, lex, top_k).select("key", "vector_rank", "lexical_rank", F.col("rank").alias("fused_rank"))
    rows = rows.withColumn("reranked", F.col("fused_rank") <= rerank)
    rows = rows.join(scores.select("key", "rerank_score"), "key", "left") if scores is not None else rows.withColumn("rerank_score", F.lit(None).cast("double"))
    order = [F.desc("reranked"), F.when(F.col("reranked"), F.col("rerank_score")).desc_nulls_last(), "fused_rank"]
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    if related is not None:
        rows = rows.join(related.select("key", F.col("nth").cast("long").alias("nth")), "key", "full_outer")
        rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("place"), "nth", "key")).cast("long")).withColumn("reranked", F.coalesce("reranked", F.lit(False)))
    else:
        rows = rows.withColumn("nth", F.lit(None).cast("long"))
    rows = rows.withColumn("sources", F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), name) for c, name in (("vector_rank", "vector"), ("lexical_rank", "lexical"), ("nth", "graph"))])))
    # The block's number and score are one token each, whatever they are; a key without a document renders as an empty block.
    blocks = rows.select("place", F.col("key").alias("document_id")).join(documents, "document_id", "left").select(F.col("place").alias("rank"), token_count(context_block(F.lit(1), F.lit(0.0))).alias("tokens"))
    kept = greedy_budget(blocks, budget).withColumnRenamed("rank", "place")
    return rows.join(kept, "place").select("key", "sources", "vector_rank", "lexical_rank", "fused_rank", "reranked", "place", "tokens", "included")
