"""Queries of the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.ann import op5_ann
from gridloom.llm.decontaminate import op2_decontaminate
from gridloom.llm.jaccard_join import op7_jaccard_join
from gridloom.llm.language_id import op10_language_id
from gridloom.llm.line_dedup import op8_line_dedup
from gridloom.llm.lm_score import op3_lm_score
from gridloom.llm.minhash import op12_minhash
from gridloom.llm.mix_sources import op9_mix_sources
from gridloom.llm.prefix_trie import op11_prefix_trie
from gridloom.llm.source_audit import op13_source_audit
from gridloom.llm.suffix_dedup import op6_suffix_dedup
from gridloom.llm.token_counts import op1_token_counts
from gridloom.llm.warc import op4_warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_lm_score, op4_warc, op5_ann, op6_suffix_dedup, op7_jaccard_join, op8_line_dedup, op9_mix_sources, op10_language_id, op11_prefix_trie, op12_minhash, op13_source_audit, pipeline)}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": rf"""
        with item as (select item_id::varchar i, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
        win as (select distinct i, least(10, len(w)) k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') t
                from (select i, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from item where len(w) > 0)),
        doc as (select row_number() over () r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        place as (select r, w, unnest(range(1, len(w) + 1)) p from doc where len(w) > 0),
        cut as (select r, p, k, array_to_string(w[p:p + k - 1], ' ') t from place, (select distinct k from win) where p + k - 1 <= len(w)),
        hit as (select r, p, win.k, i from cut join win using (k, t)),
        words as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + k)) q from hit) group by r),
        items as (select r, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct r, i from hit) group by r)
        select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
               sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from doc left join words using (r) left join items using (r)""",
    "op7_jaccard_join": rf"""
        with recursive doc as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') w from documents),
        sh as (select distinct doc_id, array_to_string(w[p:p + 2], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) p from doc where len(w) > 0)),
        n as (select doc_id, count(*) n from sh group by 1),
        common as (select s from sh group by s having count(*) > 1),
        few as (select sh.doc_id, s from sh join common using (s)),
        pair as (select a.doc_id x, b.doc_id y, count(*) c from few a join few b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        link as (select x, y from pair join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
        reach as (select doc_id a, doc_id b from documents union select reach.a, link.y from reach join link on reach.b = link.x),
        comp as (select a, min(b) c from reach group by a)
        select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id from documents left join n using (doc_id) join comp on a = doc_id""",
    "op4_warc": r"""
    with d as (select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, list_aggregate(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') b, min(page_id) over (partition by coalesce(html, '')) f from pages)
    select page_id, payload_bytes, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(b, i + 1, 1)::int * 16 + substr(b, i + 2, 1)::int * 8 + substr(b, i + 3, 1)::int * 4 + substr(b, i + 4, 1)::int * 2 + substr(b, i + 5, 1)::int, 1)
    for i in range(0, 160, 5)], 'string_agg', '') payload_digest, case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to from d""",
    "op6_suffix_dedup": r"""
    with doc as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
    seg as (select r, q, substr(h, 2000 * q + 1, 2398) s, least(1000, n - 199 - 1000 * q) m from (select r, h, len(h) // 2 n, unnest(range(0, (len(h) // 2000 + 1)::bigint)) q from doc)),
    win as (select r, 1000 * q + i p, md5_number(substr(s, 2 * i + 1, 400)) k from (select r, q, s, unnest(range(0, m::bigint)) i from seg where m > 0)),
    dup as (select k from win group by k having count(*) > 1),
    hit as (select r, p, p > 200 + lag(p) over (partition by r order by p) is not false fresh from win semi join dup using (k)),
    span as (select r, min(p) a, max(p) + 200 b from (select r, p, sum(fresh::int) over (partition by r order by p) i from hit) group by r, i),
    gap as (select r, h, coalesce(lag(b) over w, 0) e, a, last_value(b) over (partition by r order by a rows between unbounded preceding and unbounded following) z from span join doc using (r) window w as (partition by r order by a)),
    kept as (select r, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' order by a) || any_value(substr(h, 2 * z + 1)) k from gap group by r),
    sums as (select r, sum(b - a)::bigint n_removed, count(*) n_spans from span group by r)
    select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(k, h))) kept_sha256
    from doc left join sums using (r) left join kept using (r)""",
    "op8_line_dedup": r"""
    with doc as (select row_number() over () r, doc_id, text from documents),
    ln as (select r, doc_id, no, lines[no] line from (select r, doc_id, lines, unnest(range(1, len(lines) + 1)) no from (select r, doc_id, string_split(text, chr(10)) lines from doc where text is not null))),
    own as (select *, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \t\v\f\r]+'), lambda w: w <> ''))) w from ln),
    sets as (select row_number() over () s, w, len(w) n, min({'d': doc_id, 'no': no}) f from own where len(w) > 0 and doc_id is not null group by w),
    tok as (select s, n, unnest(w) t from sets), cnt as (select t, count(*) c from tok group by t),
    ranked as (select s, n, t, row_number() over (partition by s order by c, t) k from tok join cnt using (t)),
    pair as (select distinct a.s x, b.s y from ranked a join tok b using (t) where a.k <= a.n - ceil(0.8 * a.n) + 1 and a.s <> b.s and 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
    near as (select x, y from pair join sets a on a.s = x join sets b on b.s = y where 180 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n)),
    best as (select s, least(any_value(sets.f), min(o.f)) f from sets left join (select x s, f from near join sets on sets.s = y union all select y s, f from near join sets on sets.s = x) o using (s) group by s),
    kept as (select r, string_agg(line, chr(10) order by no) k from own left join sets using (w) left join best using (s) where best.f is null or doc_id is null or not best.f < {'d': doc_id, 'no': no} group by r)
    select doc_id, (case when text is null then 0 else len(string_split(text, chr(10))) end)::bigint n_lines, case when text is null then 0 else octet_length(encode(coalesce(k, ''))) end::bigint kept_bytes,
    case when text is not null then sha256(coalesce(k, '')) end kept_sha256 from doc left join kept using (r)""",
    "op11_prefix_trie": r"""
    with src as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce("text", '')) p, {'r': coalesce(role, ''), 't': coalesce("text", '')} u from conversations where conv_id is not null),
    len as (select conv_id, count(*) n, (list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: list_concat([ascii(x)::ubigint], list_transform(range(8), lambda i: 999::ubigint))))),
        lambda a, x: case when x = 999 then xor(a >> 1, 3988292384::ubigint * (a & 1)) else xor(a, x) end)) c from src group by conv_id),
    h as (select conv_id, n, xor(c, 4294967295::ubigint)::bigint % 4 h from len),
    conv as (select h.conv_id, list_concat(coalesce((select list(u order by p) from src where src.conv_id = h.conv_id - h.conv_id % 20 and p <= h), []), coalesce((select list(u order by p) from src where src.conv_id = h.conv_id and p > h), [])) s from h),
    mem as (select conv_id, d, s[1:d] k, len(s) = d ends from (select conv_id, s, unnest(range(0, len(s) + 1)) d from conv)),
    node as (select d, k, min(conv_id) c, count(*) n, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') e, case when d = 0 then 0 else len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) end w from mem group by d, k),
    kids as (select d - 1 d, k[1:d - 1] k, count(*) m from node where d > 0 group by all),
    whole as (select node.*, coalesce(m, 0) m from node left join kids using (d, k)),
    up as (select a d, k[1:a] k, count(*) filter (m = 0) leaves, sum((n - 1) * w) saved from (select *, unnest(range(0, d + 1)) a from whole) group by all)
    select x.c conv_id, x.d "depth", p.c parent_conv_id, x.n n_convs, x.m n_children, leaves n_leaves, saved::bigint saved_tokens, sha256(x.e) ends_sha256
    from whole x join up using (d, k) left join node p on p.d = x.d - 1 and p.k = x.k[1:x.d - 1]""",
    "op12_minhash": r"""
    with recursive doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    sh as (select distinct doc_id, array_to_string(w[p:p + 1], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) p from doc where len(w) > 0)),
    n as (select doc_id, count(*) n from sh group by 1),
    common as (select s from sh group by s having count(*) > 1),
    few as (select sh.doc_id, s from sh join common using (s)),
    pair as (select a.doc_id x, b.doc_id y, count(*) c from few a join few b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
    link as (select x, y from pair join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
    reach as (select doc_id a, doc_id b from documents union select reach.a, link.y from reach join link on reach.b = link.x),
    comp as (select a, min(b) c from reach group by a)
    select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, doc_id = c kept from documents left join n using (doc_id) join comp on a = doc_id""",
    "op13_source_audit": r"""
    with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
    tok as (select r, lang, source, unnest(w) t from d),
    kept as (select lang, t from tok group by lang, t having count(distinct r) >= 3),
    cnt as (select lang, source, t, count(*)::hugeint n from tok semi join kept using (lang, t) group by lang, source, t),
    grp as (select lang, source, coalesce(sum(n), 0)::hugeint n from (select distinct lang, source from d) left join cnt using (lang, source) group by lang, source),
    voc as (select lang, count(t)::hugeint v from (select distinct lang from d) left join kept using (lang) group by lang),
    p as (select lang, source, t, coalesce(c.n, 0) n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (grp.n + v) p from grp join voc using (lang) join kept using (lang) left join cnt c using (lang, source, t)),
    q as (select lang, t, 1 + (1000000000 * (sum(n) + 1)::hugeint) // (any_value(a) + any_value(v)) q from p join (select lang, sum(n)::hugeint a from grp group by lang) using (lang) join voc using (lang) group by lang, t),
    pair as (select a.lang, a.source, b.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint "value" from grp a join grp b on a.lang = b.lang and a.source <> b.source
        left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.t = x.t where x.t is null or y.t is not null group by all),
    term as (select lang, source, t item, ((p - q) * (p - q) // q)::bigint "value" from p join q using (lang, t) where n > 0 and p > q),
    ranked as (select *, 'pair' part, row_number() over (partition by lang, source order by "value" desc, item)::int "rank" from pair
        union all select *, 'term' part, row_number() over (partition by lang, source order by "value" desc, item)::int "rank" from term qualify "rank" <= 200)
    select lang, source, part, item, "value", "rank" from ranked""",
}
