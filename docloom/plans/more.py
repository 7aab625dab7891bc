"""Registered queries on streams, graphs, layout and memory, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import entities as en
from docloom.functions import privacy as pr
from docloom.functions import text as tx
from docloom.functions.reliability import reliability
from docloom.operators import graph, layout
from docloom.plans.rollups import USAGE
from docloom.sources.tables import items, read, vectors
from docloom.streaming import usage as st

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("stream_daily_usage", f"select strftime(make_timestamp(ts_s // 86400 * 86400 * 1000000), '%Y-%m-%d') as day, kind, count(*) as n, count(*) filter (kind = 'error') as n_failed, round(sum(value), 4) as value from ({USAGE}) group by 1, 2")
def stream_daily_usage(spark, d):
    out = st.drain_sums(st.event_stream(spark, d), st.windowed_usage, ["w", "kind"])
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "n", "n_failed", F.round("value", 4).alias("value"))


@register("stream_breach_streaks", f"""with e as (select *, sum(case when kind = 'error' then 0 else 1 end) over (partition by agent order by ts_us, id) as island from (select event_id as id, user_id as agent, event_type as kind, epoch_us(ts) as ts_us from events)),
  r as (select agent, island, count(*) filter (kind = 'error') as len from e group by agent, island), l as (select agent, max(island) as last from e group by agent)
  select r.agent, max(len) filter (island = last) as streak, max(len) as longest, max(len) >= 3 as disabled, (select count(*) from e where e.agent = r.agent) as n from r join l using (agent) group by r.agent""")
def stream_breach_streaks(spark, d):
    return st.latest(spark, st.drain(st.breach_streaks(st.event_stream(spark, d)), "update"), ["agent"]).drop("n_late")


@register("stream_upserts", f"select agent, max_by(kind, id) as kind, max(id) as id from ({USAGE}) group by agent")
def stream_upserts(spark, d):
    import uuid

    from docloom.sources.shared import shared_folder

    folder = f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}"
    st.drain(st.event_stream(spark, d).select("agent", "kind", "id"), "append", st.merge_sink(spark, folder, ["agent"], "id"))
    versions = spark.read.parquet(folder)
    last = versions.agg(F.max("version").alias("v"))
    return versions.join(F.broadcast(last), F.col("version") == F.col("v")).select("agent", "kind", "id")


@register("duplicate_groups", """with recursive d as (select page_id as i, sha256(html) as h, lower(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}]', '', 'g')) as t from pages), e as (select d.i as a, min(x.i) as b from d join d x using (h) group by d.i union select d.i, min(x.i) from d join d x using (t) where t <> '' group by d.i),
  s as (select a, b from e where a <> b union select b, a from e where a <> b), r(n, c) as (select a, a from s union select s.b, r.c from r join s on s.a = r.n) select n as item_id, min(c) as group_id from r group by n""")
def duplicate_groups(spark, d):
    """Pages linked by equal contents or equal whole titles."""
    p = read(spark, d, "pages").select(F.col("page_id").alias("item_id"), tx.content_hash(F.col("html")).alias("h"), tx.title_key(tx.html_title(F.col("html"))).alias("t"))
    return graph.dedup_groups(p, "h", "t")


@register("similar_vectors", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cosine from embeddings a join embeddings b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4")
def similar_vectors(spark, d):
    """Every vector whose id is divisible by 50 against all vectors."""
    return graph.similar_pairs(vectors(spark, d), 0.4, queries=F.col("item_id") % 50 == 0).select("a", "b", F.round("cosine", 5).alias("cosine"))


@register("density_clusters")
def density_clusters(spark, d):
    """Density clusters of the vectors; -1 is noise."""
    return graph.density_clusters(vectors(spark, d), 0.3, 3)


@register("html_structure", """select page_id, len(regexp_extract_all(html, '(?is)<p\\b[^>]*>')) as n_paragraphs, len(regexp_extract_all(html, '(?is)<a\\b[^>]*>')) as n_links, len(regexp_extract_all(html, '(?is)<tr\\b[^>]*>')) as n_rows from pages""")
def html_structure(spark, d):
    count = lambda tag: F.size(F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0)))
    return read(spark, d, "pages").select("page_id", count("p").alias("n_paragraphs"), count("a").alias("n_links"), count("tr").alias("n_rows"))


@register("page_scenes", "select case when regexp_matches(lower(url), 'invoice|receipt|发票|收据') then 'receipt' when regexp_matches(lower(url), 'card|名片') then 'card' when regexp_matches(lower(url), 'licen[cs]e|执照') then 'licence' when regexp_matches(lower(url), 'table|表') then 'table' else 'document' end as scene, count(*) as n from pages group by 1")
def page_scenes(spark, d):
    return read(spark, d, "pages").groupBy(layout.scene(F.col("url")).alias("scene")).agg(F.count("*").alias("n"))


@register("line_table", """with l as (select doc_id as doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as text from documents), b as (select doc, line, (line // 2) * 10.0 as y0, (line // 2) * 10.0 + 8 as y1 from l)
  select doc, count(distinct y0) as n_rows, count(*) as n_lines from b group by doc""")
def line_table(spark, d):
    lines = items(spark, d).select(F.col("item_id").alias("doc"), F.posexplode(F.split("content", "\n")).alias("line", "text"))
    boxed = lines.select("doc", "line", "text", (F.floor(F.col("line") / 2) * 10.0).alias("y0"), (F.floor(F.col("line") / 2) * 10.0 + 8).alias("y1"), (F.col("line") % 2 * 100.0).alias("x0"), (F.col("line") % 2 * 100.0 + 50).alias("x1"))
    return layout.table_rows(boxed).groupBy("doc").agg(F.countDistinct("row").alias("n_rows"), F.count("*").alias("n_lines"))


@register("entity_rows")
def entity_rows(spark, d):
    """Money, date, organisation and person mentions of every item with byte offsets."""
    return items(spark, d).select("item_id", F.explode(en.entities("content")).alias("e")).select("item_id", "e.*")


DEED = ["丁晓明，于 ", " 在北京协和医院和中国银行支付", "元。"]


@register("entities_of_deeds", f"""with t as (select doc_id, '2024-03-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as day, n_chars::varchar || '元' as money from documents)
  select doc_id as item_id, 'person' as kind, '丁晓明' as value, 0 as byte_start from t union all select doc_id, 'date', day, 16 from t
  union all select doc_id, 'organization', '在北京协和医院和中国银行', 27 from t union all select doc_id, 'money', money, 69 from t""")
def entities_of_deeds(spark, d):
    """The four kinds of entities in a sentence made for each document."""
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    text = F.concat(F.lit(DEED[0]), day, F.lit(DEED[1]), F.col("n_chars").cast("string"), F.lit(DEED[2]))
    found = read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.explode(en.entities(text)).alias("e"))
    return found.select("item_id", "e.kind", "e.value", "e.byte_start")


@register("reply_reliability", """with t as (select doc_id, '2024-03-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as day, n_chars::varchar as money from documents),
  f as (select doc_id, (case when day <> '2024-03-15' then 1 else 0 end) + (case when money <> '500' then 1 else 0 end) as n_contradictions, (case when day <> '2024-03-15' then 1 else 0 end) + (case when not starts_with('500', money) then 1 else 0 end) as n_unsupported from t)
  select doc_id as item_id, case when doc_id % 2 = 0 then 'grounded' else 'fabricated' end as citation, n_contradictions, n_unsupported,
  round(1 - (case when doc_id % 2 = 0 then 0 else 0.2 end) - 0.5 * n_contradictions / 2 - 0.3 * n_unsupported / 4, 6) as confidence from f""")
def reply_reliability(spark, d):
    """A reply made for each document, held against a chunk with another date and amount."""
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    cited = F.when(F.col("doc_id") % 2 == 0, "report").otherwise("nowhere")
    reply = F.concat(F.lit("报告时间："), day, F.lit("。借款金额为 ¥"), F.col("n_chars").cast("string"), F.lit("。[item:"), cited, F.lit("]"))
    chunks = F.array(F.struct(F.lit("report").alias("item_id"), F.lit("报告时间：2024-03-15。借款金额为 ¥500。").alias("text")))
    r = read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), reliability(reply, chunks).alias("r"))
    return r.select("item_id", F.col("r.citations")[0]["status"].alias("citation"), F.size("r.contradictions").alias("n_contradictions"), F.size("r.hallucinations").alias("n_unsupported"), F.round("r.confidence", 6).alias("confidence"))


@register("email_spans", r"""select item_id, value, count(*) as n from (select doc_id as item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as value from documents) group by all""")
def email_spans(spark, d):
    """E-mail spans of the detectors."""
    s = items(spark, d).select("item_id", F.explode(pr.detect("content")).alias("s")).where("s.kind = 'EMAIL'")
    return s.groupBy("item_id", F.col("s.value").alias("value")).agg(F.count("*").alias("n"))


@register("hashed_embeddings")
def hashed_embeddings(spark, d):
    """The stand-in embedding of every item, rounded."""
    return items(spark, d).select("item_id", F.transform(en.hashed_embedding("content"), lambda x: F.round(x, 6)).alias("embedding"))


@register("dates_found", """with m as (select doc_id as item_id, unnest(regexp_extract_all(text, '(\\d{4}-\\d{2}-\\d{2})')) as d from documents) select item_id, d as day from m where try_cast(d as date) is not null""")
def dates_found(spark, d):
    return items(spark, d).select("item_id", F.explode(en.dates(F.col("content"))).alias("day"))


@register("grounding_checks", """with u as (select conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w, role from conversations), a as (select conv_id, turn, w from u where role = 'assistant'), q as (select conv_id, turn + 1 as turn, w from u)
  select a.conv_id, a.turn, case when len(list_intersect(a.w, q.w)) >= 3 then 'grounded' when len(list_intersect(a.w, q.w)) >= 1 then 'weak' else 'fabricated' end as verdict,
  round(case when len(a.w) = 0 and len(q.w) = 0 then 1 else 2.0 * len(list_intersect(a.w, q.w)) / (len(list_distinct(a.w)) + len(list_distinct(q.w))) end, 6) as f1 from a join q using (conv_id, turn)""")
def grounding_checks(spark, d):
    u = read(spark, d, "conversations").select("conv_id", "turn", "role", tx.tokens(F.col("text")).alias("w"))
    a = u.where("role = 'assistant'").drop("role")
    q = u.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("s"))
    return a.join(q, ["conv_id", "turn"]).select("conv_id", "turn", en.grounding(F.col("w"), F.col("s")).alias("verdict"), F.round(en.token_f1(F.col("w"), F.col("s")), 6).alias("f1"))


@register("turn_diffs")
def turn_diffs(spark, d):
    """Line diff of each turn against the one before."""
    u = read(spark, d, "conversations").select("conv_id", "turn", "text")
    before = u.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    hunks = u.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.posexplode(en.line_diff("old", "text")).alias("pos", "h"))
    return hunks.select("conv_id", "turn", "pos", "h.kind", F.length("h.text").alias("n_chars"))
