"""Registered queries of the corpus operators: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decision_list, decontam, language_id, linededup, pseudonyms, ranked_search, repair, rule_ensemble, sharding, simhash, substring, toxicity
from docloom.llm.common import documents, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.apply_quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP3_SQL = """
with lines as (
    select doc_id, source, pos, line, trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) as body
    from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
          from documents where text is not null)),
spread as (select body from lines where length(body) >= 12 group by body having count(distinct source) >= 8),
marked as (select doc_id, pos, line, body in (select body from spread) as hit from lines),
kept as (select doc_id, count_if(hit) as n_hit, string_agg(line, chr(10) order by pos) filter (not hit) as text from marked group by doc_id)
select d.doc_id,
    case when d.text is null then 0 else length(string_split(d.text, chr(10))) end as n_lines,
    coalesce(n_hit, 0) as n_removed,
    sha256(case when n_hit > 0 then coalesce(k.text, '') else d.text end) as text_sha256
from documents d left join kept k using (doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"), keep=("doc_id",))


#: The key of the registered query; a real run takes its own from a secret store.
DEMO_KEY = "pseudonym key of the registered query"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: Every window of 35 words as a string, counted over all documents.
OP6_SQL = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n from d),
win as (select r, i, w, case when i + 34 <= n then string_agg(w, ' ') over (partition by r order by i rows between current row and 34 following) end as s from w),
again as (select s from win where s is not null group by s having count(*) > 1),
hit as (select win.r, win.i, win.w, again.s is not null as h from win left join again using (s)),
covered as (select r, i, w, max(h::int) over (partition by r order by i rows between 34 preceding and current row) = 1 as gone from hit),
kept as (select r, count_if(gone) as n_removed, string_agg(w, ' ' order by i) filter (not gone) as text from covered group by r)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from d left join kept k using (r)
"""


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path(), with_ids=False).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: Every alignment of every item with every text, by the words they share.
OP8_SQL = """
with dw as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as p from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null)),
iw as (
    select item_id, unnest(w) as w, generate_subscripts(w, 1) as q, len(w) as n
    from (select distinct item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from benchmark where text is not null and item_id is not null) where len(w) >= 8),
a as (
    select doc_id, item_id, p - q as start_word, count(*) as n_matched, any_value(n) as n_item_words
    from dw join iw using (w) group by doc_id, item_id, p - q having count(*) >= 0.8 * any_value(n)),
r as (select *, row_number() over (partition by doc_id, item_id order by n_matched desc, start_word) as r from a)
select doc_id, item_id, start_word, n_matched, n_item_words, n_matched / n_item_words as similarity from r where r = 1
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


#: DuckDB has no crc32: its table by rule, eight shifts of each byte, and the sum of an ASCII text by it.
CRC32_TABLE = "bits as (select x, x as c, 0 as k from range(256) r(x) union all select x, xor(c >> 1, 3988292384 * (c & 1)), k + 1 from bits where k < 8), crc as (select list(c order by x) as tab from bits where k = 8)"


def crc32_sql(text: str) -> str:
    return f"xor(4294967295, list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def _repair_sql() -> str:
    """The same dynamic programme over strings: a state's value is its cost in eight digits and then its audit."""
    edit = lambda v, cost, letter: f"(case when {v} is not null then printf('%08d', {v}[:8]::bigint + {cost}) || {v}[9:] || '{letter}' end)"
    kept = lambda v, initial: f"(case when not must and left(role, 1) = '{initial}' then {edit(v, 'cut', 'K')} end)"
    held = lambda v: f"(case when not must then {edit(v, '2 + cut', 'R')} end)"
    user = lambda f: ", ".join(f(v) for v in ("v0", "v1", "v3"))

    def insert(source: str) -> str:
        for _ in range(2):
            keep = "* exclude (v2, v3)"
            source = f"(select {keep}, least(v2, {user(lambda v: edit(v, 2, 'I'))}) as v2, v3 from {source})"
            source = f"(select {keep}, v2, least(v3, {edit('v2', 2, 'I')}) as v3 from {source})"
        return source

    start = "(select s.*, r.role, r.must, r.cut from step s join placed r on r.conv is not distinct from s.conv and r.i = s.i + 1)"
    row = f"""select conv, i + 1 as i, {edit('v0', 3, 'D')} as v0, least({edit('v1', 3, 'D')}, {kept('v0', 's')}) as v1,
        least({edit('v2', 3, 'D')}, {user(lambda v: kept(v, 'u'))}, {user(held)}) as v2, least({edit('v3', 3, 'D')}, {kept('v2', 'a')}, {held('v2')}) as v3 from {insert(start)}"""
    return f"""
with recursive {CRC32_TABLE},
raw as (
    select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d from conversations, crc),
hurt as (
    select conv, turn, case when d = 4 then 'user' else role end as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when d = 3 then [1, 2] else [1] end) as copy from raw where d <> 0),
told as (
    select *, row_number() over w as i, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as last,
        left(lag(role) over w, 1) || left(role, 1) as pair from hurt window w as (partition by conv order by turn nulls first, role, text)),
seen as (select *, row_number() over (partition by conv, role, text order by i) > 1 as again from told),
placed as (select *, last = '' or again as must, (last not in ('', '.', '!', '?') and not again)::bigint as cut from seen),
step as (
    select distinct conv, 0::bigint as i, '00000000' as v0, null::varchar as v1, null::varchar as v2, null::varchar as v3 from raw
    union all {row}),
ends as (select conv, least(v0, v3) as v from {insert("(select * from step qualify i = max(i) over (partition by conv))")}),
edits as (select conv, unnest(generate_series(1, length(v) - 8)) as k, v from ends),
named as (select conv, k, v[8 + k] as e, count(*) filter (v[8 + k] <> 'I') over (partition by conv order by k) as i, count(*) filter (v[8 + k] <> 'D') over (partition by conv order by k desc) as behind from edits),
lines as (
    select n.conv, k, case when e = 'K' then p.role when behind % 2 = 1 then 'assistant' else 'user' end || ':' || case when e = 'I' then '' else p.text end as line
    from named n left join placed p on p.conv is not distinct from n.conv and p.i = n.i where e <> 'D'),
hashed as (select conv, sha256(string_agg(line, chr(10) order by k)) as h from lines group by conv),
counted as (
    select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(last = '') as blank, count_if(last <> '' and again) as duplicate, sum(cut)::bigint as truncated,
        count_if(pair not in ('su', 'ua', 'au')) as illegal from placed group by conv)
select e.conv as conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, v[:8]::bigint as cost, v[9:] as audit, coalesce(h, sha256('')) as repaired_sha256
from ends e left join counted c on c.conv is not distinct from e.conv left join hashed h on h.conv is not distinct from e.conv
"""


OP12_SQL = _repair_sql()


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: Every document that shares a term with an item is scored.
OP13_SQL = """
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws
    from documents),
sizes as (select r, doc_id, len(ws)::bigint as n from d where len(ws) > 0),
totals as (select count(*)::bigint as nn, sum(n)::bigint as ll from sizes),
counts as (select r, t, count(*)::bigint as tf from (select r, unnest(ws) as t from d) group by r, t),
terms as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t
    from benchmark),
weights as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, totals where t in (select t from terms) group by t, nn),
scored as (
    select item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
    from terms join counts using (t) join weights using (t) join sizes using (r), totals group by item_id, r),
placed as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored join sizes using (r) where score > 0)
select item_id, rank::integer as rank, doc_id, score from placed where rank <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_language_id": op11_language_id,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op8_decontamination": OP8_SQL, "op12_conversation_repair": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
