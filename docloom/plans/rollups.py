"""Registered roll-up queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import rollups as op
from docloom.sources.tables import items, read, usage_events, vectors

USAGE = """select event_id as id, (epoch_us(ts) // 1000000)::bigint as ts_s, user_id as agent, event_type as kind, value, (props::json->>'k')::bigint as item from events"""
QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


START, END = 1704412800, 1705622400


@register("usage_summary", f"""with u as ({USAGE}) select count(*) as n_events, round(coalesce(sum(value), 0), 4) as total_value, count(*) filter (kind = 'error') as n_errors,
  round(coalesce(sum(value) filter (kind = 'click') / nullif(sum(value), 0), 0), 6) as click_share from u where ts_s between {START} and {END}""")
def usage_summary(spark, d):
    return op.usage_summary(usage_events(spark, d), START, END)


@register("agent_health", f"""with u as ({USAGE}) select agent, count(*) as n_total, count(*) filter (kind = 'error') as n_failed,
  round(count(*) filter (kind = 'error') / count(*), 6) as failure_rate from u where agent is not null group by agent""")
def agent_health(spark, d):
    return op.failure_rates(usage_events(spark, d), ["agent"])


@register("popular_items", f"with u as ({USAGE}) select item, count(*) as n from u where item is not null and kind = 'click' group by item order by n desc, item limit 20")
def popular_items(spark, d):
    return op.popular(usage_events(spark, d).where("kind = 'click'"), "item", 20)


@register("missed_queries", f"with u as ({USAGE}) select item, count(*) as n from u where item is not null and kind = 'error' group by item having count(*) >= 3 order by n desc, item limit 50")
def missed_queries(spark, d):
    return op.popular(usage_events(spark, d).where("kind = 'error'"), "item", 50, 3)


@register("items_by_source", "select source as source_type, count(*) as n from documents group by 1")
def items_by_source(spark, d):
    return op.counts_by(items(spark, d), "source_type")


@register("entity_df", """with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents)
  select term, count(*) as df from t group by term having count(*) >= 20""")
def entity_df(spark, d):
    return op.term_frequency(items(spark, d).select("item_id", "content"), F.array_distinct(tx.tokens(F.col("content")))).where("df >= 20")


@register("distinct_items_with_terms", "select count(distinct doc_id) as n_items from documents where regexp_matches(text, '[0-9]')")
def distinct_items_with_terms(spark, d):
    return items(spark, d).where(F.col("content").rlike("[0-9]")).agg(F.countDistinct("item_id").alias("n_items"))


@register("tag_histogram", """with t as (select doc_id, 'quality' as dim, quality::varchar as val from labels union all select doc_id, 'toxic', toxic::varchar from labels)
  select dim, val, count(distinct doc_id) as n from t group by dim, val""")
def tag_histogram(spark, d):
    return tags(spark, d).groupBy("dim", "val").agg(F.countDistinct("doc_id").alias("n"))


def tags(spark, d):
    return read(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "dim", "val").withColumn("val", F.col("val").cast("string"))


@register("item_states", """select o_custkey, count(*) as n_total, count(*) filter (o_orderstatus = 'P') as n_pending, count(*) filter (o_orderstatus = 'F') as n_done from orders group by o_custkey""")
def item_states(spark, d):
    return op.item_states(read(spark, d, "orders"), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", "o_custkey")


@register("classifier_summary", """select event_type as kind, count(*) as n, count(*) filter (value / 100 < 0.3) as n_low, round(avg(value / 100), 6) as mean_confidence from events group by event_type""")
def classifier_summary(spark, d):
    return op.classifier_summary(read(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("value") / 100).alias("c")), "kind", "c")


@register("term_variants", """with w as (select unnest(regexp_extract_all(text, '[\\p{L}]+')) as s from documents), c as (select lower(s) as term_key, s, count(*) as n from w group by 1, 2),
  r as (select *, row_number() over (partition by term_key order by n desc, s) as rn from c)
  select term_key, count(*) as n_spellings, sum(n)::bigint as total, max(s) filter (rn = 1) as preferred from r group by term_key having count(*) > 1""")
def term_variants(spark, d):
    words = read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("s"))
    return op.term_variants(words, "s", F.lower("s"))


@register("signal_buckets", f"""with u as ({USAGE}) select lower(trim(kind || ' ' || (item % 10))) as pattern, count(*) as n from u where ts_s >= {END} - 7 * 86400 and item is not null group by 1 having count(*) >= 3""")
def signal_buckets(spark, d):
    signals = usage_events(spark, d).where("item is not null").withColumn("q", F.concat_ws(" ", "kind", (F.col("item") % 10).cast("string")))
    return op.signal_buckets(signals, "q", "ts_s", END, 7, 3)


@register("cooccurrence_expansion", f"""with u as ({USAGE}), b as (select agent as k, list(distinct item) as toks, count(*) as w from u where item is not null group by agent),
  e as (select k, unnest(toks) as t from b), l as (select distinct a.k, c.k as other from e a join e c using (t) where a.k <> c.k),
  s as (select l.k, m.t as token, sum(b.w)::bigint as weight from l join e m on m.k = l.other join b on b.k = l.other where not exists (select 1 from e where e.k = l.k and e.t = m.t) group by 1, 2),
  r as (select *, row_number() over (partition by k order by weight desc, token) as rank from s) select k, token, weight, rank from r where rank <= 8""")
def cooccurrence_expansion(spark, d):
    u = usage_events(spark, d).where("item is not null")
    buckets = u.groupBy(F.col("agent").alias("k")).agg(F.collect_set("item").alias("toks"), F.count("*").alias("w"))
    return op.cooccurrence_expansion(buckets, "k", "toks", "w")


@register("cooccurrence_edges", f"""with u as (select distinct agent, item from ({USAGE}) where item is not null) select a.item as a, b.item as b, count(*) as weight from u a join u b using (agent) where a.item < b.item group by 1, 2 having count(*) >= 2""")
def cooccurrence_edges(spark, d):
    return op.cooccurrence_edges(usage_events(spark, d).where("item is not null"), "agent", "item").where("weight >= 2")


@register("day_buckets", f"""with u as (select id, ts_s // 86400 as day from ({USAGE})), r as (select *, row_number() over (partition by day order by id) as r, count(*) over (partition by day) as n from u)
  select day, max(n) as n_chunks, count(*) as n_taken, min(id) as first_id, max(id) as last_id from r where r <= 50 and n >= 5 and day < (select max(day) from u) group by day order by day limit 4""")
def day_buckets(spark, d):
    return op.day_buckets(usage_events(spark, d), "ts_s", "id")


@register("promotions", f"""with u as ({USAGE}), m as (select item as id, count(*) as access, ({END} - min(ts_s)) / 86400.0 as days, count(distinct agent) as n_chunks, min(ts_s) as created_at, md5(item::varchar) as first_hash
  from u where item is not null and ts_s < {END} group by item), s as (select *, round(1.0 * access + 2.0 / (1 + 0.1 * days) + 0.5 * ln(greatest(n_chunks, 1)), 6) as score from m)
  select id, access, round(days, 6) as days, n_chunks, created_at, first_hash, score from s where access >= 3 and score >= 4.0 order by score desc, created_at, first_hash, id limit 200""")
def promotions(spark, d):
    u = usage_events(spark, d).where(f"item is not null and ts_s < {END}")
    m = u.groupBy(F.col("item").alias("id")).agg(F.count("*").alias("access"), ((F.lit(END) - F.min("ts_s")) / 86400).alias("days"), F.countDistinct("agent").alias("n_chunks"), F.min("ts_s").alias("created_at"))
    return op.promotions(m.withColumn("first_hash", F.md5(F.col("id").cast("string").cast("binary")))).withColumn("days", F.round("days", 6))


@register("token_bill", "select sum(least(length(text), 2000))::bigint as actual, sum(length(text))::bigint as naive, round(greatest(0, 1 - sum(least(length(text), 2000)) / sum(length(text))), 6) as saved from documents")
def token_bill(spark, d):
    return op.token_bill(items(spark, d).select(F.least(F.length("content"), F.lit(2000)).alias("a"), F.length("content").alias("n")), "a", "n")


@register("seed_stats", "select event_type as kind, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(value) as n from events group by 1")
def seed_stats(spark, d):
    return op.seed_stats(usage_events(spark, d), "kind", "value")


@register("majority_dimension", "with s as (select vec_id as item_id, len(embedding) as dim from embeddings), t as (select dim from s group by dim order by count(*) desc, dim desc limit 1) select item_id, dim, dim = (select dim from t) as clean from s")
def majority_dimension(spark, d):
    return op.majority_dimension(vectors(spark, d), F.size("embedding")).select("item_id", "dim", "clean")


@register("mean_vector", "with e as (select label as domain, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select domain, i, avg(x) as x from e group by 1, 2) select domain, i, round(x, 6) as mean from m")
def mean_vector(spark, d):
    out = op.mean_vector(vectors(spark, d), "domain", "embedding")
    return out.select("domain", F.posexplode("mean").alias("i", "mean")).withColumn("i", F.col("i") + 1)


@register("claim_support", """with c as (select lower(regexp_replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}]', '', 'g')) as claim, regexp_extract(url, '://([^/]+)', 1) as host, page_id from pages)
  select claim, count(distinct host) as n_refs, min(page_id) as title, count(distinct host) >= 2 as confirmed from c group by claim""")
def claim_support(spark, d):
    """Whole page titles as claims, supported by the hosts that carry them."""
    c = read(spark, d, "pages").select(tx.title_key(tx.html_title(F.col("html"))).alias("claim"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id")
    return op.claim_support(c, "claim", "host", "page_id", "page_id")


@register("dominant_kind", "select event_type as kind, count(*) as n from events group by 1 order by 2 desc, 1 limit 1")
def dominant_kind(spark, d):
    return op.dominant(usage_events(spark, d), "kind", {"click": 0, "view": 1})
