"""Registered retrieval queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import retrieval as op
from docloom.sources.shared import shared_folder
from docloom.sources.tables import items, read, vectors

QUERIES, SQL = {}, {}
TERMS = ["license", "apache", "nicht", "hein"]
#: A fixed query vector, made by rule.
QUERY = [((7 * i + 3) % 13 - 6) / 10 for i in range(64)]
VEC = "[" + ",".join(f"{x}::double" for x in QUERY) + "]"
COS = f"list_cosine_similarity(embedding::double[], {VEC})"


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(sorted(TERMS)))
_DF = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(TERMS)))
_SCORE = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(TERMS)))
_HIT = " or ".join(f"tf{i} > 0" for i in range(len(TERMS)))
BM25_CTE = f"""w as (select doc_id as item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents), r as (select item_id, coalesce(len(w), 0) as n, {_TF} from w),
 s as (select count(*) filter (n > 0) as docs, avg(n) filter (n > 0) as mean, {_DF} from r), b as (select item_id, round({_SCORE}, 6) as score from r, s where {_HIT})"""


@register("bm25_top10", f"with {BM25_CTE} select item_id, score, row_number() over (order by score desc, item_id)::int as rank from b order by score desc, item_id limit 10")
def bm25_top10(spark, d):
    return op.bm25(items(spark, d), TERMS, 10)


@register("bm25_indexed_top10", SQL["bm25_top10"])
def bm25_indexed_top10(spark, d):
    """The same search from stored postings."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    op.build_index(items(spark, d), folder)
    return op.bm25_indexed(spark, folder, TERMS, 10)


@register("hybrid_indexed")
def hybrid_indexed(spark, d):
    """Hybrid search with its lexical channel from stored postings; its SQL is that of hybrid_search."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    op.build_index(items(spark, d), folder)
    return op.hybrid(items(spark, d), vectors(spark, d), TERMS, QUERY, index=folder)


@register("inverted_index", """with w as (select doc_id as item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents), l as (select item_id, count(*) as length from w group by 1)
  select term, item_id, count(*) as tf, any_value(length)::int as length from w join l using (item_id) group by term, item_id""")
def inverted_index(spark, d):
    return op.postings(items(spark, d))


@register("vector_topk", f"select vec_id as item_id, round({COS}, 6) as score, row_number() over (order by round({COS}, 6) desc, vec_id)::int as rank from embeddings order by 2 desc, 1 limit 20")
def vector_topk(spark, d):
    return op.nearest(vectors(spark, d), QUERY, 20)


@register("vector_min_score", f"select vec_id as item_id, round({COS}, 6) as score, row_number() over (order by round({COS}, 6) desc, vec_id)::int as rank from embeddings where round({COS}, 6) >= 0.2 order by 2 desc, 1 limit 100")
def vector_min_score(spark, d):
    return op.nearest(vectors(spark, d), QUERY, 100, 0.2)


RANKS = f"""{BM25_CTE}, t as (select item_id, score, row_number() over (order by score desc, item_id) as rank from b order by score desc, item_id limit 50),
 v as (select vec_id as item_id, round({COS}, 6) as score from embeddings), vr as (select item_id, score, row_number() over (order by score desc, item_id) as rank from v order by score desc, item_id limit 50),
 f as (select item_id, round(sum(s), 8) as score from (select item_id, 0.6 / (60 + rank) as s from vr union all select item_id, 0.4 / (60 + rank) from t) group by item_id)"""


@register("rrf_fusion", f"with {RANKS} select item_id, score, row_number() over (order by score desc, item_id)::int as rank from f order by score desc, item_id limit 20")
def rrf_fusion(spark, d):
    return op.fuse(op.nearest(vectors(spark, d), QUERY, 50), op.bm25(items(spark, d), TERMS, 50), 20)


@register("merge_lists", f"with {RANKS}, m as (select item_id, score, rank::int as rank, 0 as list from t union all select item_id, score, rank::int, 1 from vr), o as (select *, row_number() over (partition by item_id order by list, rank) as r from m) select item_id, score, list, rank from o where r = 1 order by list, rank limit 60")
def merge_lists(spark, d):
    return op.merge_lists(op.bm25(items(spark, d), TERMS, 50), op.nearest(vectors(spark, d), QUERY, 50), 60)


RERANK = f"{RANKS}, top as (select * from f order by score desc, item_id limit 20), rr as (select item_id, round(0.7 * coalesce({COS}, 0) + 0.3 * score, 6) as score from top left join embeddings on vec_id = item_id)"


@register("cosine_rerank", f"with {RERANK} select item_id, score from rr")
def cosine_rerank(spark, d):
    v = vectors(spark, d)
    return op.rerank(op.fuse(op.nearest(v, QUERY, 50), op.bm25(items(spark, d), TERMS, 50), 20), v, QUERY)


@register("budget_split", f"with {RERANK} select item_id, score, case when sum(score) over () > 0 then greatest(floor(2000 * score / sum(score) over ()), 100) else greatest(floor(2000 / count(*) over ()), 100) end::bigint as alloc from rr")
def budget_split(spark, d):
    return op.budget_split(cosine_rerank(spark, d))


_LANG = """case when n = 0 then 'mixed' when n - length(regexp_replace(x, '[\\x{4E00}-\\x{9FFF}]', '', 'g')) >= 0.3 * n then 'zh' when n - length(regexp_replace(x, '[A-Za-z]', '', 'g')) >= 0.7 * n then 'en' else 'mixed' end"""


@register("lang_detect", f"select doc_id as item_id, {_LANG} as language from (select doc_id, regexp_replace(text, '\\s', '', 'g') as x, length(regexp_replace(text, '\\s', '', 'g')) as n from documents)")
def lang_detect(spark, d):
    return items(spark, d).select("item_id", tx.language(F.col("content")).alias("language"))


def _boost() -> str:
    w = {t: (4 if any(c.isdigit() for c in t) else 2 if len(t) >= 6 else 1) for t in TERMS}
    f = {t: f"case when contains(lower(text), '{t}') then 1 else 0 end" for t in TERMS}
    return f"(0.45 * ({' + '.join(f.values())}) / {len(TERMS)} + least(0.05 * ({' + '.join(f'{f[t]} * {w[t]}' for t in TERMS)}), 0.55))"


@register("coverage_boost", f"select doc_id as item_id, round({_boost()}, 6) as boost from documents")
def coverage_boost(spark, d):
    return items(spark, d).select("item_id", F.round(op.coverage_boost(F.col("content"), TERMS), 6).alias("boost"))


@register("hybrid_search", f"""with {RERANK}, x as (select item_id, rr.score + {_boost()} as s, {_LANG.replace('x,', 'sx,')} as language from (select *, length(sx) as n from (select *, regexp_replace(text, '\\s', '', 'g') as sx from documents)) d join rr on rr.item_id = d.doc_id),
  p as (select item_id, round(case when language = 'zh' then s * 0.3 else s end, 6) as score from x), q as (select item_id, score, row_number() over (order by score desc, item_id)::int as rank from p order by score desc, item_id limit 10)
  select item_id, score, rank, case when sum(score) over () > 0 then greatest(floor(2000 * score / sum(score) over ()), 100) else greatest(floor(2000 / count(*) over ()), 100) end::bigint as alloc from q""")
def hybrid_search(spark, d):
    return op.hybrid(items(spark, d), vectors(spark, d), TERMS, QUERY)


SQL["hybrid_indexed"] = SQL["hybrid_search"]


@register("history_pack", """with c as (select conv_id, turn, ceil(length(text) / 4.0)::bigint + 8 as cost from conversations), u as (select *, sum(cost) over (partition by conv_id order by turn desc rows unbounded preceding)::bigint as used from c) select conv_id, turn, cost, used from u where used <= 600""")
def history_pack(spark, d):
    turns = read(spark, d, "conversations")
    return op.pack_history(turns, "conv_id", "turn", F.ceil(F.length("text") / 4), 600).select("conv_id", "turn", "cost", "used")


@register("first_per_item", """with h as (select label as item_id, vec_id as chunk, round(embedding[1]::double, 6) as score from embeddings), r as (select *, row_number() over (partition by item_id order by score desc, chunk) as r from h) select item_id, chunk, score from r where r = 1""")
def first_per_item(spark, d):
    v = read(spark, d, "embeddings").select(F.col("label").alias("item_id"), F.col("vec_id").alias("chunk"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return op.first_per_item(v)


_WEIGHTS = {"base": 0.1, "privacy": 0.2, "exact": 1.5, "lang": 0.3, "vector": 0.8, "bm25": 0.6, "recency": 0.4, "level": 0.5}


@register("feature_score", """select vec_id as item_id, round(case when label = 9 then -1e6 else 0.3 + greatest(embedding[1]::double, 0) + case when vec_id % 5 = 0 then 1.5 else 0 end + case when vec_id % 2 = 0 then 0.3 else 0 end
  + 0.8 * least(1, greatest(0, embedding[2]::double)) + 0.6 / sqrt(vec_id % 50 + 1) + 0.4 / (1 + (vec_id % 90) / 30) + 0.5 * case vec_id % 3 when 1 then 0.45 when 2 then 1.0 else 0.20 end end, 6) as score from embeddings""")
def feature_score(spark, d):
    v = read(spark, d, "embeddings")
    e = lambda i: F.col("embedding")[i].cast("double")
    i = F.col("vec_id")
    f = v.select(i.alias("item_id"), (F.col("label") != 9).alias("privacy_allowed"), e(0).alias("base"), (i % 5 == 0).alias("exact"), F.lit(False).alias("entity"), F.lit(False).alias("domain"), (i % 2 == 0).alias("lang"), F.lit(False).alias("citation"), e(1).alias("vector"), (i % 50).alias("bm25_rank"), (i % 90).alias("days"), (i % 3).alias("level"))
    return f.select("item_id", F.round(op.feature_score(_WEIGHTS), 6).alias("score"))


@register("hit_metrics", f"""with q as (select label as query, vec_id as item_id, round({COS}, 6) as s from embeddings), r as (select query, item_id, row_number() over (partition by query order by s desc, item_id) as rank from q), g as (select label as query, vec_id as item_id from embeddings where vec_id % 7 = 0)
  select g.query, max(case when rank <= 10 then 1 else 0 end) as hit, round(count(*) filter (rank <= 10) / count(*), 6) as recall, round(coalesce(max(1.0 / rank) filter (rank <= 10), 0), 6) as rr from g left join r using (query, item_id) group by g.query""")
def hit_metrics(spark, d):
    v = vectors(spark, d).select(F.col("domain").alias("query"), "item_id", F.round(vx.cosine(F.col("embedding"), F.lit(QUERY)), 6).alias("s"))
    r = v.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "item_id")))
    return op.hit_metrics(r.select("query", "item_id", "rank"), v.where("item_id % 7 = 0").select("query", "item_id"), 10)


@register("substring_fallback", """select doc_id as item_id, case when contains(lower(source), 'src1') then 0.35 else 0.30 end as score from documents where contains(lower(source), 'src1') or contains(lower(text), 'apache license')""")
def substring_fallback(spark, d):
    title, body = F.contains(F.lower("source_type"), F.lit("src1")), F.contains(F.lower("content"), F.lit("apache license"))
    return items(spark, d).where(title | body).select("item_id", F.when(title, F.lit(0.35)).otherwise(F.lit(0.30)).alias("score"))


@register("query_intents", """select conv_id, turn, case when regexp_matches(lower(text), '总结|概括|摘要|summary|summarize|overview') then 'summary' when regexp_matches(lower(text), '对比|区别|差异|compare|contrast|difference') then 'comparison'
  when regexp_matches(lower(text), '查找资料|查找手册|引用来源|source lookup|manual lookup|locate source|locate manual') then 'lookup' when regexp_matches(lower(text), '排查|故障|诊断|不通|修复|解决|error|fail|fix|troubleshoot|diagnos') then 'diagnostic' else 'general' end as intent,
  regexp_matches(text, '[`"“/._0-9]|\\(\\)|::') as precise from conversations""")
def query_intents(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.query_intent(F.col("text")).alias("intent"), tx.is_precise(F.col("text")).alias("precise"))
