"""Registered text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.sources.tables import items, read

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("token_cost", """select doc_id as item_id, ceil(round(han * 0.6 + (length(text) - han) * 0.25, 6))::bigint as tokens, ceil((120 * (length(text) - a) + 25 * a) / 100.0)::bigint as context_tokens from
  (select doc_id, text, length(text) - length(regexp_replace(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]', '', 'g')) as han, length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) as a from documents)""")
def token_cost(spark, d):
    return items(spark, d).select("item_id", tx.token_estimate(F.col("content")).alias("tokens"), tx.context_tokens(F.col("content")).alias("context_tokens"))


@register("title_norm", "select p_partkey, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) as k from part")
def title_norm(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.title_key(F.col("p_name")).alias("k"))


@register("collapse_space", "select doc_id as item_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as h from documents")
def collapse_space(spark, d):
    return items(spark, d).select("item_id", F.md5(tx.collapse_space(F.col("content")).cast("binary")).alias("h"))


@register("sanitize_query", "select conv_id, turn, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as q from conversations where role = 'user'")
def sanitize_query(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", tx.sanitize_query(F.col("text")).alias("q"))


@register("content_hash", "select doc_id as item_id, sha256(text) as h, substr(sha256(text), 1, 16) as audit from documents")
def content_hash(spark, d):
    h = tx.content_hash(F.col("content"))
    return items(spark, d).select("item_id", h.alias("h"), F.substring(h, 1, 16).alias("audit"))


@register("url_domain", "select page_id, lower(regexp_extract(case when contains(url, '://') then split_part(url, '://', -1) else url end, '^([^/:?#]*)', 1)) as domain from pages")
def url_domain(spark, d):
    return read(spark, d, "pages").select("page_id", tx.url_domain(F.col("url")).alias("domain"))


@register("levenshtein_similarity", """select a.page_id as a, b.page_id as b, round(1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)), 6) as sim from pages a join pages b on b.page_id = a.page_id + 1""")
def levenshtein_similarity(spark, d):
    """Similarity of the whole addresses of neighbouring pages."""
    t = read(spark, d, "pages").select("page_id", "url")
    p, q = t.toDF("a", "x"), t.select(F.col("page_id").alias("b"), F.col("url").alias("y"), (F.col("page_id") - 1).alias("a"))
    return p.join(q, "a").select("a", "b", F.round(tx.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("sim"))


@register("html_text", """with p as (select page_id, html from pages), a as (select page_id, html, regexp_replace(html, '<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'gis') as x from p), b as (select page_id, html, regexp_replace(regexp_replace(x, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs') as x from a)
  select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title, md5(trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) as h from b""")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"), F.md5(tx.html_text(F.col("html")).cast("binary")).alias("h"))


@register("safe_cells", "select c_custkey, case when regexp_matches(c_acctbal::varchar, '^[=+\\-@]') then '''' || cast(c_acctbal as varchar) else cast(c_acctbal as varchar) end as cell from customer")
def safe_cells(spark, d):
    return read(spark, d, "customer").select("c_custkey", tx.safe_cell(F.col("c_acctbal").cast("string")).alias("cell"))


@register("needs_ocr", "select doc_id as item_id, length(regexp_replace(text, '\\s', '', 'g')) < 100 as needs_ocr from documents")
def needs_ocr(spark, d):
    return items(spark, d).select("item_id", tx.needs_ocr(F.col("content")).alias("needs_ocr"))


@register("chunk_windows")
def chunk_windows(spark, d):
    """Level-2 chunks of every item, one row each."""
    out = items(spark, d).select("item_id", F.posexplode(tx.chunks("content")).alias("chunk_idx", "chunk"))
    return out.select("item_id", "chunk_idx", F.length("chunk").alias("n_chars"), F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_hash"))


@register("section_paths")
def section_paths(spark, d):
    """Level-1 sections of every item with their heading path."""
    out = items(spark, d).select("item_id", F.explode(tx.sections("content")).alias("s"))
    return out.select("item_id", "s.section_idx", F.array_join("s.path", " > ").alias("path"), F.length("s.content").alias("n_chars"), F.md5(tx.breadcrumb(F.col("s.path"), F.col("s.content")).cast("binary")).alias("h"))


@register("outline_lines", """with l as (select doc_id as item_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, trim(unnest(string_split(text, chr(10))), ' ') as t from documents), x as (select *, lower(t) as low from l where t <> ''),
  k as (select item_id, pos, case when low in ('table of contents', 'contents') or (contains(t, '....') and regexp_matches(t, '(?:^|\\s)[0-9]+$')) then 'toc'
   when strlen(t) <= 120 and not regexp_matches(t, '[;{}]$') and (regexp_matches(t, '^#{1,6}\\s+\\S') or regexp_matches(t, '^[0-9]+(\\.[0-9]+)*\\.?\\s+[\\p{Lu}\\p{Lo}]')) then 'section'
   when regexp_matches(low, '^(error|warning|symptom|cause|solution)[: ]') then 'troubleshooting' when regexp_matches(t, '^(GET|POST|PUT|PATCH|DELETE)\\s+/') then 'api_reference'
   when regexp_matches(t, '^([0-9]+[.)]|[-*]|step\\s+[0-9]+)\\s') then 'procedure_step' when regexp_matches(t, '^(\\$|>|#!|sudo |git |cargo |pip |npm |docker )') then 'command'
   when regexp_matches(t, '^[A-Za-z_][\\w.-]*\\s*[=:]\\s*\\S') then 'config' when regexp_matches(t, '^\\|.*\\|$|\\t.*\\t') then 'table_row' else 'paragraph' end as kind from x)
  select kind, count(*) as n from k group by kind""")
def outline_lines(spark, d):
    lines = items(spark, d).select("item_id", F.explode(F.split("content", "\n")).alias("t")).where(F.trim("t") != "")
    return lines.groupBy(tx.line_kind(F.col("t"), F.lit("")).alias("kind")).agg(F.count("*").alias("n"))


@register("extractive_summary", """with s as (select doc_id as item_id, unnest(regexp_extract_all(text, '[^.]+\\.')) as s, generate_subscripts(regexp_extract_all(text, '[^.]+\\.'), 1) as pos from documents where text is not null),
  r as (select *, count(*) over (partition by item_id) as n, row_number() over (partition by item_id order by length(s) desc, pos) as r from s)
  select item_id, count(*) as n_kept, md5(string_agg(s, '' order by pos)) as h from r where r <= ceil(0.2 * n) group by item_id""")
def extractive_summary(spark, d):
    from docloom.operators.compress import extract_top

    # a split is linear in the text; a regular expression for sentences would scan an unended tail once for each of its characters
    parts = F.split("content", r"\.")
    ended = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    sentences = items(spark, d).select("item_id", F.posexplode(F.transform(ended, lambda x: F.concat(x, F.lit(".")))).alias("pos", "s"))
    out = extract_top(sentences, "item_id", "pos", "s", F.length("s"), 0.2)
    return out.select("item_id", "n_kept", F.md5(F.col("summary").cast("binary")).alias("h"))


@register("pii_counts", """select doc_id as item_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as n_email, len(regexp_extract_all(text, '\\(\\d{3}\\) \\d{3}-\\d{4}')) as n_phone, len(regexp_extract_all(text, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}')) as n_ip from documents""")
def pii_counts(spark, d):
    count = lambda p: F.size(F.regexp_extract_all("content", F.lit(p), F.lit(0)))
    return items(spark, d).select("item_id", count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("n_email"), count(r"\(\d{3}\) \d{3}-\d{4}").alias("n_phone"), count(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}").alias("n_ip"))


@register("pii_redacted")
def pii_redacted(spark, d):
    """Texts with personal data replaced by numbered placeholders, and their counts by kind."""
    from docloom.functions.privacy import detect, redact

    it = items(spark, d).withColumn("spans", detect("content"))
    return it.where(F.size("spans") > 0).select("item_id", redact("content", "spans").alias("redacted"), F.transform("spans", lambda s: s["kind"]).alias("kinds"))
