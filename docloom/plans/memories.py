"""Registered queries over memories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import memory
from docloom.sources.tables import items, read, vectors

QUERIES, SQL = {}, {}
NOW = 1705000000
DAY, TODAY = 86400, NOW - NOW % 86400
MONDAY = TODAY - ((TODAY // DAY + 3) % 7) * DAY
CONFIDENCE = 0.3


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TOKENS = "ceil((120 * (length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g'))) + 25 * length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g'))) / 100.0)::bigint"


@register("tiered_context", f"""with q as (select conv_id as query_id, case conv_id % 3 when 0 then 'what came last week: ' || text when 1 then 'overview of ' || text else text end as text, conv_id % 3 as k from (select conv_id, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as r from conversations) where r = 1),
  s as (select query_id, case when k = 1 or regexp_matches(lower(text), '总结|概括|概述|overview|summar') then 'overview' when k = 0 then 'recall' when len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) <= 6 and not regexp_matches(text, '[`"“/._0-9]|\\(\\)|::') then 'overview' else 'precise' end as shape from q),
  m as (select vec_id as memory_id, case when label % 2 = 0 then 'episodic' else 'semantic' end as kind, {TODAY} - (vec_id % 20) * {DAY} as ws, {TODAY} - (vec_id % 20) * {DAY} + {DAY} as we, vec_id % 7 = 0 as cold, coalesce(text, '') as summary from embeddings left join documents on doc_id = vec_id),
  c as (select s.query_id, shape, e.vec_id as memory_id, round(list_cosine_similarity(e.embedding::double[], v.embedding::double[]), 6) as score from s join embeddings v on v.vec_id = s.query_id, embeddings e where shape <> 'precise'),
  n as (select *, row_number() over (partition by query_id order by score desc, memory_id) as r from c), f as (select n.query_id, shape, memory_id, score, summary, row_number() over (partition by n.query_id order by score desc, memory_id) as rank from n join m using (memory_id)
    where r <= 12 and not cold and kind = case shape when 'recall' then 'episodic' else 'semantic' end and (shape <> 'recall' or ws < {MONDAY} and we > {MONDAY - 7 * DAY})),
  h as (select * from f where rank <= 3), sure as (select query_id from h group by query_id having max(score) >= {CONFIDENCE}), t as (select query_id, shape, case when query_id not in (select query_id from sure) then 'L0' when shape = 'recall' then 'L2' else 'L3' end as tier from s),
  b as (select t.query_id, t.shape, tier, rank as pos, 'memory' as source, memory_id as id, score, case t.shape when 'recall' then '情景记忆' else '知识主题记忆' end as title, summary as content from h join t using (query_id) where tier <> 'L0'
    union all select t.query_id, t.shape, tier, case when tier = 'L0' then d.r else 4 end, 'item', d.doc_id, 1.0 / d.r, d.source, coalesce(d.text, '') from t join (select *, doc_id - query_id as r from documents join s on doc_id in (query_id + 1, query_id + 2)) d on d.query_id = t.query_id where tier = 'L0' or d.r = 1),
  k as (select *, {_TOKENS.format("coalesce(title, '')")} + {_TOKENS.format("content")} as tokens from b)
  select query_id, shape, tier, row_number() over (partition by query_id order by pos, id)::int as pos, source, id, score, tokens, sum(tokens) over (partition by query_id)::bigint as total from k""")
def tiered_context(spark, d):
    """The context of each conversation's first turn, as a question about the documents: their vectors make the memories."""
    from pyspark.sql.window import Window

    first = read(spark, d, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("r = 1")
    text = F.coalesce("text", F.lit(""))
    lead = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("what came last week: "), text)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("overview of "), text)).otherwise(text)
    v = vectors(spark, d)
    questions = first.select(F.col("conv_id").alias("query_id"), lead.alias("text")).join(v.select(F.col("item_id").alias("query_id"), "embedding"), "query_id", "left")
    start = F.lit(TODAY) - F.col("item_id") % 20 * DAY
    texts = items(spark, d).select("item_id", "content", "source_type")
    memories = v.join(texts, "item_id", "left").select(
        F.col("item_id").alias("memory_id"), F.when(F.col("domain") % 2 == 0, "episodic").otherwise("semantic").alias("kind"), start.alias("window_start"), (start + DAY).alias("window_end"),
        (F.col("item_id") % 7 == 0).alias("cold"), F.lit(False).alias("superseded"), F.coalesce("content", F.lit("")).alias("summary"),
    )
    near = texts.select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), F.col("source_type").alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    results = near.select((F.col("item_id") - F.col("rank")).alias("query_id"), "rank", "item_id", "title", "content", (1 / F.col("rank")).alias("score"))
    return memory.assemble(questions, memories, v.select("item_id", "embedding"), results, NOW, CONFIDENCE)
