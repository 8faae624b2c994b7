"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from weftgraph.llm import line_dedup as lines
from weftgraph.llm import mixing as m
from weftgraph.llm.sharding import EIGHT, Leaf, grown, levels


def _descend(leaves: tuple[Leaf, ...], key: str, label: str) -> list[str]:
    """Common table expressions that end in {label}3(doc_key, node): the shard of each key."""
    out, above = [], f"(select distinct {key} as doc_key, 0 as node from documents)"
    for depth, children in enumerate(levels(leaves), 1):
        rows = ", ".join(f"({parent}, '{name}', {weight!r}::double, {number})" for parent, c in enumerate(children) for name, weight, number in c)
        out.append(f"""{label}{depth} as (
            select doc_key, arg_min(number, (draw, number)) as node from (
                select a.doc_key, c.number, -ln((('0x' || substr(md5(c.name || '|' || a.doc_key), 1, 12))::bigint::double + 1) / {float(16**12)!r}) / c.weight as draw
                from {above} a join (values {rows}) c(parent, name, weight, number) on c.parent = a.node)
            group by doc_key)""")
        above = f"{label}{depth}"
    return out


def sharding() -> str:
    key = "coalesce(doc_id::varchar, '')"
    ctes = _descend(EIGHT, key, "now") + _descend(grown(EIGHT), key, "next")
    return f"""
        with crc as (select list(x order by i) as t from (
            select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) as x from range(256) r(i))),
        base as (
            select doc_id, {key} as doc_key, coalesce(text, '') as body, hex(encode(coalesce(text, ''))) as h from documents),
        sums as (
            select doc_id, doc_key, length(h) // 2 + 1 as size,
                xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
                    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as text_crc32
            from base, crc),
        {", ".join(ctes)}
        select s.doc_id, s.size, s.text_crc32, 'key' as law, now3.node as shard,
            row_number() over (partition by now3.node order by substr(md5(s.doc_key || '|' || s.text_crc32 || '|' || s.size), 1, 3), s.doc_id nulls first, s.text_crc32, s.size) - 1 as slot,
            next3.node as grown_shard
        from sums s join now3 using (doc_key) join next3 using (doc_key)"""


def mixing() -> str:
    weight = "[" + ", ".join(map(str, m.WEIGHTS)) + "]"
    at = "[" + ", ".join("[" + ", ".join(repr(sum(s[:i]) / sum(s)) for i in range(len(s))) + "]" for s in m.SCHEDULES) + "]::double[][]"
    each = "[" + ", ".join("[" + ", ".join(repr(x / sum(s)) for x in s) + "]" for s in m.SCHEDULES) + "]::double[][]"
    phases = len(m.SCHEDULES[0])
    return f"""
        with sized as (
            select doc_id, source, md5('mix|' || coalesce(doc_id::varchar, '')) as draw,
                len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
        per as (
            select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as rank from sized group by source),
        caps as (
            select *, {weight}[(rank % {len(m.WEIGHTS)})::int + 1]::bigint as weight, source_size * {m.MOST} as cap from per),
        ordered as (
            select *, row_number() over o as nth, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::double as full_,
                sum(weight) over (o rows between current row and unbounded following)::double as open_, sum(source_size) over ()::double as total
            from caps window o as (order by cap::double / weight, rank)),
        levels as (select *, (total - full_) / open_ as level from ordered),
        stop as (select min(nth) filter (cap::double / weight > level) as stop from levels),
        goal as (
            select source, source_size, rank, round(case when stop is null or nth < stop then cap::double else (select level from levels where nth = stop) * weight end, 6) as target
            from levels, stop),
        placed as (
            select s.*, g.source_size, g.rank, g.target,
                coalesce(sum(size) over (partition by s.source order by draw, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
            from sized s join goal g on s.source is not distinct from g.source),
        passed as (
            select *, case when source_size > 0 then greatest(0, least({m.MOST}, ceil((target - start - size / 2) / source_size)))::bigint else 0 end as passes from placed),
        shared as (select *, (start + size / 2) / target as share, ({at})[(rank % {len(m.SCHEDULES)})::int + 1] as at_, ({each})[(rank % {len(m.SCHEDULES)})::int + 1] as each_ from passed),
        phased as (select *, greatest(len(list_filter(at_, lambda x: x <= share)), 1) as phase from shared)
        select doc_id, size, source_size, target, passes * size as taken, passes,
            case when passes > 0 then round((phase - 1 + (share - at_[phase]) / each_[phase]) / {phases}, 9) end as position
        from phased"""


def line_dedup() -> str:
    text = "regexp_replace(coalesce(html, ''), '<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'gis')"
    text = f"regexp_replace({text}, '</?(?:{lines.BREAKS})\\b[^>]*>', chr(10), 'gi')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, sign in lines.ENTITIES:
        quoted = sign.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    return f"""
        with cut as (
            select row_number() over () as page, page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) as host,
                list_filter(list_transform(string_split(trim(regexp_replace({text}, '[\\x00-\\x09\\x0B-\\x20]+', ' ', 'g')), chr(10)), lambda x: trim(x)), lambda x: x <> '') as body
            from pages),
        every as (select page, host, unnest(body) as line, unnest(range(len(body))) as nth from cut),
        total as (select host, count(*) as pages from cut group by host),
        common as (
            select host, line from every join total using (host) where host <> ''
            group by host, line, pages having count(distinct page) >= {lines.LEAST} and count(distinct page) > {lines.RATIO!r}::double * pages),
        kept as (select page, string_agg(line, chr(10) order by nth) as text, count(*) as n from every anti join common using (host, line) group by page)
        select page_id, host, len(body)::bigint as n_lines, len(body) - coalesce(n, 0) as n_dropped, coalesce(text, '') as text
        from cut left join kept using (page)"""


def chat() -> str:
    return """
        with turns as (
            select *, md5(role || '|' || body) as tie from (
                select distinct conv_id, turn::bigint as turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as body
                from conversations where conv_id is not null)),
        speakers as (select distinct conv_id, coalesce(role, 'unknown') as speaker from conversations where conv_id is not null and coalesce(role, 'unknown') <> 'system'),
        heads as (
            select conv_id, speaker, turn, role, tie, body, role = speaker as own,
                '<|' || case when role = speaker then 'assistant' when role = 'system' then 'system' else 'user:' || replace(role, '<|', '< |') end || '|>' || chr(10) as head
            from turns join speakers using (conv_id)),
        placed as (
            select *, coalesce(sum(length(head) + length(body) + 8) over (partition by conv_id, speaker order by turn nulls first, tie, role, body rows between unbounded preceding and 1 preceding), 0)::bigint + length(head) as start
            from heads)
        select conv_id, speaker, count(*) as n_turns, count(*) filter (own) as n_spoken,
            string_agg(head || body || '<|end|>' || chr(10), '' order by turn nulls first, tie, role, body) as text,
            coalesce(string_agg(start || '-' || (start + length(body) + 7), ',' order by start) filter (own), '') as mask_spans
        from placed group by conv_id, speaker"""
