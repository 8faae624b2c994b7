"""Registered retrieval queries over documents and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import read_table
from weftgraph.operators import evaluation as ev
from weftgraph.operators import retrieval as rt
from weftgraph.session import ship

QUERY = "onThereeder the shou"
WORDS = "thnd erth shou"
#: A language and a source that owns documents in it.
OWNED = "en src3"
DIMENSIONS = 64


def lexical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as lexical documents: source is the file, lang the symbol."""
    ship(spark)
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("document_id"), F.col("source").alias("file"), F.col("lang").alias("symbol_name"), F.concat_ws(".", "source", "lang").alias("qualified_name"), F.lit("function").alias("symbol_type"), F.col("text").alias("content"), F.lit(1).alias("start_line"), (F.col("n_chars") % 7 + 1).cast("int").alias("end_line"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return read_table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("point_id"), F.col("embedding").alias("vector"), "label")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: the first row's, a fixed number of values."""
    return vectors(spark, sf_dir).orderBy("point_id").first().vector


def queries() -> dict:
    docs, vec = lexical_documents, vectors

    def hybrid(spark: SparkSession, d: str) -> DataFrame:
        lex = rt.lexical_search(docs(spark, d), QUERY, 50).select(F.col("document_id").alias("key"), "rank", "rank_group")
        near = rt.vector_search(vec(spark, d), first_vector(spark, d), 50).select(F.col("point_id").alias("key"), "rank")
        return rt.fused(near, lex, 60)

    def metrics(spark: SparkSession, d: str) -> DataFrame:
        v = vec(spark, d)
        ranked = rt.vector_search(v, first_vector(spark, d), 20).select(F.lit(0).cast("long").alias("case_id"), "rank", F.col("point_id").alias("key"))
        label = v.orderBy("point_id").limit(1).select(F.col("label").alias("wanted"))
        judged = v.crossJoin(F.broadcast(label)).select(F.lit(0).cast("long").alias("case_id"), F.col("point_id").alias("key"), (F.col("label") == F.col("wanted")).alias("relevant"))
        return ev.ranking_metrics(ranked, judged)

    def budget(spark: SparkSession, d: str) -> DataFrame:
        found = rt.lexical_search(docs(spark, d), QUERY, 40).select("rank", "document_id")
        block = rt.token_count(rt.context_block(F.lit(1), F.lit(0.0)))
        return rt.greedy_budget(found.join(docs(spark, d), "document_id").select("rank", block.alias("tokens")))

    def owners(spark: SparkSession, d: str) -> DataFrame:
        """Documents as methods of their source: equal names and scores with the same evidence of the owner share a group."""
        methods = docs(spark, d).withColumn("symbol_type", F.lit("method"))
        return rt.lexical_search(methods, OWNED, 50).select("rank", "document_id", "rank_group")

    return {
        "lexical_search": lambda s, d: rt.lexical_search(docs(s, d), QUERY, 50).drop("rank_group").withColumn("score", F.round("score", 9)),
        "lexical_ambiguous": lambda s, d: rt.lexical_search(docs(s, d), "en", 50).select("rank", "document_id", "score", "rank_group"),
        "lexical_owner_groups": owners,
        "lexical_bm25": lambda s, d: rt.bm25(docs(s, d), WORDS, 50),
        "lexical_bm25_fields": lambda s, d: rt.bm25_fields(docs(s, d), f"{WORDS} en src3", 50),
        "vector_search": lambda s, d: rt.vector_search(vec(s, d), first_vector(s, d), 50),
        "hybrid_search": hybrid,
        "context_budget": budget,
        "inspect_retrieval": lambda s, d: rt.inspect_retrieval(docs(s, d), vec(s, d), QUERY, first_vector(s, d)).withColumn("sources", F.array_join("sources", " ")),
        "ranking_metrics": metrics,
        "logical_targets": lambda s, d: rt.logical_targets(docs(s, d).withColumn("start_line", F.col("document_id").cast("int") % 50).withColumn("end_line", F.col("start_line") + F.col("end_line"))).select("file", "symbol_name", "start_line", "end_line", "chunks"),
        "split_chunks": lambda s, d: rt.split_chunks(docs(s, d).withColumn("content", F.replace("content", F.lit(" "), F.lit("\n")))).select("document_id", "chunk", "start_line", "end_line", F.length("content").cast("long").alias("chars")),
        "identifier_parts": lambda s, d: read_table(s, d, "part").select("p_partkey", rt.searchable_identifier(F.concat(F.initcap("p_name"), F.lit("HTTPServer2"), F.col("p_brand"))).alias("terms")),
    }


_DOCS = """
    docs as (select lpad(doc_id::varchar, 10, '0') as document_id, source as file, lang as symbol_name, source || '.' || lang as qualified_name, 'function' as symbol_type, text as content, 1 as start_line, (n_chars % 7 + 1)::int as end_line from documents)"""


def _lexical(query: str) -> str:
    terms = rt.search_terms(query)
    owners = ", ".join(f"'{o}'" for o in rt.owner_names(query))
    some = " or ".join(f"contains(lower({c}), '{t}')" for t in terms for c in ("content", "file", "symbol_name", "qualified_name"))
    cover = lambda c: "(" + " + ".join(f"contains(lower({c}), '{t}')::int" for t in terms) + f") / {float(len(terms))!r}::double"
    names = "(" + " + ".join(f"(contains(lower(symbol_name), '{t}') or (split_part(lower(qualified_name), '.', 1) in ({owners}) and contains(lower(qualified_name), '{t}')))::int" for t in terms) + f") / {float(len(terms))!r}::double"
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{_DOCS}, scored as (
        select *, (lower(symbol_name) in ({listed}) or lower(qualified_name) in ({listed}))::int::double as exact_name, {names} as name_coverage, {cover("file")} as file_coverage, {cover("content")} as content_coverage from docs where {some}),
        lex as (select row_number() over (order by exact_name desc, name_coverage desc, file_coverage desc, content_coverage desc, file, start_line, document_id) as rank, *,
            round(-(4 * exact_name + 2 * name_coverage + file_coverage + 0.5 * content_coverage), 9) as score from scored)"""


_VEC = f"""
    q as (select embedding::double[] as q from embeddings order by vec_id limit 1),
    near as (select row_number() over (order by score desc, point_id) as rank, * from (
        select lpad(vec_id::varchar, 10, '0') as point_id, label, round(list_cosine_similarity(embedding::double[], q), 9) as score from embeddings, q where len(embedding) = {DIMENSIONS}))"""


def _block() -> str:
    """Tokens of a document's block: its heading (3), file, symbol, type, lines (2), score (2) and content."""
    words = lambda c: f"case when trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')), ' ')) end"
    named = lambda c: f"1 + {words(f"coalesce({c}, 'unknown')")}"
    return f"(3 + {named('file')} + {named('symbol_name')} + {named('symbol_type')} + 4 + {words('content')})::bigint"


def _fold(rows: str, rank: str) -> str:
    """fold(rank, tokens, included, used): the greedy choice over blocks numbered from 1."""
    render = "(used + block + (used > 0)::int)"
    return f"""fold(rank, tokens, included, used) as (
        select 0::bigint, 0::bigint, false, 0::bigint
        union all select f.rank + 1, {render}::bigint, used + {render} <= {rt.MOST_TOKENS}, case when used + {render} <= {rt.MOST_TOKENS} then {render} else used end::bigint from fold f join {rows} on {rows}.{rank} = f.rank + 1)"""


def _fields_sql(query: str) -> str:
    terms = [t.lower() for t in rt.query_tokens(query)]
    k, b = rt.BM25_K, rt.BM25_B
    words = ", ".join(f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') as w_{c}" for c in rt.FIELD_WEIGHTS)
    tf = ", ".join("(" + " + ".join(f"len(list_filter(w_{c}, lambda x: x = '{t}')) * {w}::double" for c, w in rt.FIELD_WEIGHTS.items()) + f") as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * {k + 1} / (tf{i} + {k} * (1 - {b} + {b} * length / mean))" for i in range(len(terms)))
    return f"""
        with {_DOCS}, w as (select document_id, {words} from docs), t as (select document_id, ({" + ".join(f"len(w_{c})" for c in rt.FIELD_WEIGHTS)})::double as length, {tf} from w),
        s as (select count(*)::double as n, avg(length) as mean, {df} from t)
        select row_number() over (order by score desc, document_id) as rank, * from (select document_id, round(({score})::double, 9) as score from t, s where greatest({", ".join(f"tf{i}" for i in range(len(terms)))}) > 0) order by rank limit 50"""


def oracle_sql() -> dict[str, str]:
    terms = [t.lower() for t in rt.query_tokens(WORDS)]
    k, b = rt.BM25_K, rt.BM25_B
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {k + 1} / (tf{i} + {k} * (1 - {b} + {b} * length / mean))" for i in range(len(terms)))
    some = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return {
        "lexical_search": f"with {_lexical(QUERY)} select rank, document_id, file, start_line, score, exact_name, name_coverage, file_coverage, content_coverage from lex order by rank limit 50",
        "lexical_ambiguous": f"""
            with {_lexical('en')}, exact as (select * from docs where lower(symbol_name) = 'en' or starts_with(lower(symbol_name), 'en ') or lower(qualified_name) = 'en' or starts_with(lower(qualified_name), 'en ')),
            targets as (select count(distinct file) as n from exact)
            select row_number() over (order by file, start_line, document_id) as rank, document_id, 0.0::double as score, case when n > 1 and document_id in (select document_id from exact) then 'bare-exact:en' end as rank_group
            from scored, targets order by rank limit 50""",
        "lexical_owner_groups": f"""
            with {_lexical(OWNED)}, top as (select * from lex order by rank limit 50),
            parts as (select *, list_filter(string_split(lower(symbol_name), '-'), lambda x: x <> '') as own, list_filter(regexp_split_to_array(lower(qualified_name), '[^a-z0-9]+'), lambda x: x <> '') as whole from top),
            held as (select *, list_sort(list_filter({rt.query_tokens(OWNED)!r}, lambda p: not list_contains(own, p) and list_contains(whole, p))) as evidence from parts),
            keyed as (select rank, document_id, case when len(list_distinct(whole)) > len(list_distinct(own)) and len(evidence) > 0 then concat_ws(':', 'owner-context', lower(symbol_name), array_to_string(evidence, '+'), score::varchar) end as k from held)
            select rank, document_id, case when count(*) over (partition by k) > 1 then k end as rank_group from keyed""",
        "context_budget": f"""
            with recursive {_lexical(QUERY)}, top as (select *, {_block()} as block from lex order by rank limit 40), {_fold("top", "rank")}
            select rank, tokens, included from fold where rank > 0""",
        "inspect_retrieval": f"""
            with recursive {_lexical(QUERY)}, {_VEC}, l as (select document_id as key, rank from lex order by rank limit 20), v as (select point_id as key, rank from near order by rank limit 20),
            f as (select coalesce(l.key, v.key) as key, v.rank as vector_rank, l.rank as lexical_rank, round(coalesce(1 / (60 + v.rank), 0.0) + coalesce(1 / (60 + l.rank), 0.0), 12) as score from l full join v using (key)),
            ranked as (select *, row_number() over (order by score desc, vector_rank nulls last, lexical_rank nulls last, key) as fused_rank from f),
            top as (select r.*, {_block()} as block from ranked r left join docs on document_id = key where fused_rank <= 20), {_fold("top", "fused_rank")}
            select key, trim(case when vector_rank is null then '' else 'vector ' end || case when lexical_rank is null then '' else 'lexical' end) as sources, vector_rank, lexical_rank, fused_rank, fused_rank <= 5 as reranked, fused_rank as place, tokens, included from top join fold on fold.rank = fused_rank""",
        "identifier_parts": """
            with n as (select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || 'HTTPServer2' || p_brand as n from part),
            h as (select *, regexp_split_to_array(regexp_replace(n, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+') as h from n)
            select p_partkey, n || ' ' || array_to_string(list_filter(list_transform(h, lambda x: lower(x)), lambda x: x <> ''), ' ') as terms from h""",
        "lexical_bm25": f"""
            with {_DOCS}, w as (select document_id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') as w from docs),
            t as (select document_id, len(w)::double as length, {tf} from w), s as (select count(*)::double as n, avg(length) as mean, {df} from t)
            select row_number() over (order by score desc, document_id) as rank, * from (select document_id, round(({score})::double, 9) as score from t, s where {some}) order by rank limit 50""",
        "lexical_bm25_fields": _fields_sql(f"{WORDS} en src3"),
        "vector_search": f"with {_VEC} select rank, point_id, score from near order by rank limit 50",
        "hybrid_search": f"""
            with {_lexical(QUERY)}, {_VEC}, l as (select document_id as key, rank from lex order by rank limit 50), v as (select point_id as key, rank from near order by rank limit 50),
            f as (select coalesce(l.key, v.key) as key, v.rank as vector_rank, l.rank as lexical_rank, round(coalesce(1 / (60 + v.rank), 0.0) + coalesce(1 / (60 + l.rank), 0.0), 12) as score from l full join v using (key))
            select *, row_number() over (order by score desc, vector_rank nulls last, lexical_rank nulls last, key) as rank from f order by rank limit 60""",
        "ranking_metrics": f"""
            with {_VEC}, want as (select label from embeddings order by vec_id limit 1), r as (select n.rank, n.label = w.label as relevant from near n, want w where n.rank <= 20),
            t as (select count(*) as total from embeddings e, want w where e.label = w.label)
            select 0::bigint as case_id, max((relevant and rank <= 1)::int)::bigint as hit_1, max((relevant and rank <= 3)::int)::bigint as hit_3, max((relevant and rank <= 5)::int)::bigint as hit_5,
                round(coalesce(1 / min(rank) filter (relevant and rank <= 5), 0.0), 9) as mrr_5, round(count(*) filter (relevant and rank <= 5) / any_value(total), 9) as recall_5, round(count(*) filter (relevant and rank <= 10) / any_value(total), 9) as recall_10,
                round(count(*) filter (relevant and rank <= 5) / count(*) filter (rank <= 5), 9) as precision_5, round(count(*) filter (not relevant and rank <= 5) / count(*) filter (rank <= 5), 9) as noise_5, 1.0::double as judged_5 from r, t""",
        "logical_targets": f"""
            with {_DOCS}, d as (select file, symbol_name, document_id, document_id::int % 50 as start_line, document_id::int % 50 + end_line as end_line from docs),
            f as (select *, case when start_line > max(end_line) over w or max(end_line) over w is null then 1 else 0 end as fresh from d window w as (partition by file, symbol_name order by start_line, end_line desc, document_id rows between unbounded preceding and 1 preceding)),
            i as (select *, sum(fresh) over (partition by file, symbol_name order by start_line, end_line desc, document_id rows unbounded preceding) as island from f)
            select file, symbol_name, min(start_line) as start_line, max(end_line) as end_line, count(*) as chunks from i group by file, symbol_name, island""",
        "split_chunks": f"""
            with {_DOCS}, l as (select document_id, string_split(replace(content, ' ', chr(10)), chr(10)) as l from docs),
            c as (select document_id, l, unnest(case when len(l) <= 120 then [0] else range(0, len(l) - 20, 100) end) as pos from l)
            select document_id, pos // 100 as chunk, 1 + pos as start_line, least(pos + 120, len(l)) as end_line, length(array_to_string(l[pos + 1 : pos + 120], chr(10)))::bigint as chars from c""",
    }
