"""Registered queue, streak, upsert, governance and admission queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import governance as gov
from docloom.operators import queues as op
from docloom.plans.rollups import USAGE
from docloom.sources.tables import items, read, usage_events

QUERIES, SQL = {}, {}
NOW = 1705000000


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("queue_position", "select o_orderkey as id, row_number() over (order by priority desc, created, o_orderkey) - 1 as position from (select o_orderkey, 5 - substr(o_orderpriority, 1, 1)::int as priority, epoch_us(o_orderdate) // 1000 as created from orders where o_orderstatus = 'O')")
def queue_position(spark, d):
    o = read(spark, d, "orders").where("o_orderstatus = 'O'")
    return op.queue_positions(o.select(F.col("o_orderkey").alias("id"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created")))


@register("job_retries", f"""select id, attempts + 1 as attempts, case when again then 'queued' else 'abandoned' end as state, case when again then {NOW} + least(1000 * pow(2, attempts), 3600000)::bigint else -1 end as next_attempt from
  (select *, error_code in ('e0', 'e1', 'e2') and attempts + 1 < 6 as again from (select id, (item % 8)::int as attempts, 'e' || (item % 5) as error_code from ({USAGE}) where kind = 'error' and item is not null))""")
def job_retries(spark, d):
    u = usage_events(spark, d).where("kind = 'error' and item is not null")
    jobs = u.select("id", (F.col("item") % 8).cast("int").alias("attempts"), F.concat(F.lit("e"), (F.col("item") % 5).cast("string")).alias("error_code"))
    return op.after_failure(jobs, NOW, 1000, 6, ["e0", "e1", "e2"]).fillna({"next_attempt": -1})


@register("job_claims", f"""with j as (select o_orderkey as id, 5 - substr(o_orderpriority, 1, 1)::int as priority, epoch(o_orderdate)::bigint as created, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'done' end as state, case when o_orderstatus = 'P' then epoch(o_orderdate)::bigint + 86400 * (o_orderkey % 20000) end as deadline from orders),
  s as (select * replace (case when state = 'running' and deadline < {NOW} then 'queued' else state end as state) from j), c as (select id from s where state = 'queued' order by priority desc, created, id limit 100)
  select id, case when id in (select id from c) then 'running' else state end as state, case when id in (select id from c) then {NOW} + 600 else coalesce(deadline, -1) end as deadline, case when id in (select id from c) then 'w1' else '' end as worker from s""")
def job_claims(spark, d):
    """The queue after leases ran out and a worker claimed a hundred jobs."""
    created = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    jobs = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), created.alias("created"), state.alias("state"), F.lit(None).cast("long").alias("next_attempt"),
        F.when(F.col("o_orderstatus") == "P", created + F.col("o_orderkey") % 20000 * 86400).alias("deadline"), F.lit("").alias("worker"), F.lit(0).cast("long").alias("claimed_at"),
    )
    waiting = op.swept(jobs, NOW, at_least_once=True)
    after = op.upsert(waiting, op.claimed(waiting, NOW, 100, 600, "w1"), ["id"], "claimed_at")
    return after.select("id", "state", F.coalesce("deadline", F.lit(-1)).alias("deadline"), "worker")


@register("streaks", f"""with p as (select agent, ts_s // 86400 as day, count(*) filter (kind = 'error') / count(*) as rate from ({USAGE}) group by 1, 2), i as (select *, sum(case when rate > 0.2 then 0 else 1 end) over (partition by agent order by day) as island from p)
  select agent, day, round(rate, 6) as rate, (sum(case when rate > 0.2 then 1 else 0 end) over (partition by agent, island order by day))::bigint as streak, sum(case when rate > 0.2 then 1 else 0 end) over (partition by agent, island order by day) >= 3 as disable from i""")
def streaks(spark, d):
    p = usage_events(spark, d).groupBy("agent", F.floor(F.col("ts_s") / 86400).alias("day")).agg((F.count_if(F.col("kind") == "error") / F.count("*")).alias("rate"))
    return op.streaks(p, ["agent"], "day", F.col("rate") > 0.2).withColumn("rate", F.round("rate", 6))


@register("upsert_hits", f"""with u as ({USAGE}), b as (select item, max_by(value, id) as value, max_by(id, id) as id from u where item is not null and kind = 'view' group by item), c as (select item, max_by(value, id) as value, max(id) as id from u where item is not null and kind <> 'view' group by item)
  select coalesce(b.item, c.item) as item, case when c.item is not null then c.value else b.value end as value, coalesce(b.id, c.id) as id from b full join c using (item)""")
def upsert_hits(spark, d):
    u = usage_events(spark, d).where("item is not null").select("item", "value", "id", "kind")
    base = u.where("kind = 'view'").groupBy("item").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("id"))
    return op.upsert(base, u.where("kind <> 'view'"), ["item"], "id", sticky=["id"])


@register("ttl_cache", f"select id, {NOW} - ts_s <= 86400 * 3 as hit from ({USAGE}) where ts_s <= {NOW}")
def ttl_cache(spark, d):
    return usage_events(spark, d).where(f"ts_s <= {NOW}").select("id", (NOW - F.col("ts_s") <= 86400 * 3).alias("hit"))


@register("retention_purge", f"select kind, count(*) as n from ({USAGE}) where not (ts_s < {NOW} and kind = 'view') group by kind")
def retention_purge(spark, d):
    return op.retained(usage_events(spark, d), "ts_s", NOW, F.col("kind") == "view").groupBy("kind").agg(F.count("*").alias("n"))


@register("keep_newest", f"select agent, id from (select *, row_number() over (partition by agent order by id desc) as r from ({USAGE})) where r <= 3")
def keep_newest(spark, d):
    return op.keep_newest(usage_events(spark, d), ["agent"], "id", 3).select("agent", "id")


@register("context_admission", "select doc_id as item_id, case when t <= 0 then 'reject' when t > 4000 then 'cloud' when t > 800 or source = 'src7' then 'async' else 'sync' end as decision from (select *, ceil(length(text) / 4.0) as t from documents)")
def context_admission(spark, d):
    it = items(spark, d)
    return it.select("item_id", op.admission(F.ceil(F.length("content") / 4), 800, 4000, F.col("source_type") == "src7", "cloud").alias("decision"))


@register("tag_index", """select doc_id, dim, val from (select doc_id, 'lang' as dim, lang as val from documents union all select doc_id, 'source', source from documents)""")
def tag_index(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.array("lang").alias("lang"), F.array("source").alias("source"))).alias("tags"))
    return gov.tag_index(docs, "doc_id", "tags")


@register("taxonomy_violations", """with t as (select doc_id, 'quality' as dim, quality::varchar as val from labels where doc_id % 3 <> 0 union all select doc_id, 'toxic', toxic::varchar from labels)
  select doc_id, 'quality' as dim, 'missing' as problem from labels where doc_id % 3 = 0 union all select doc_id, 'toxic', 'value' from t where dim = 'toxic' and val = '1'""")
def taxonomy_violations(spark, d):
    t = read(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "dim", "val").withColumn("val", F.col("val").cast("string")).where("not (dim = 'quality' and doc_id % 3 = 0)")
    return gov.taxonomy_violations(t, "doc_id", ["quality", "toxic"], ["toxic"], {"toxic": ["0"]})


@register("suggestion_cards", f"""with u as ({USAGE}), c as (select 'enrich' as kind, 'item:' || item as signature, count(*) as weight from u where kind = 'error' and item is not null group by item having count(*) >= 15
  union all select 'organize', 'agent:' || agent, count(*) from u group by agent having count(*) >= 75) select * from c where not (kind = 'enrich' and signature in ('item:1', 'item:2'))""")
def suggestion_cards(spark, d):
    u = usage_events(spark, d)
    card = lambda f, kind, key, least: f.groupBy(key).agg(F.count("*").alias("weight")).where(F.col("weight") >= least).select(F.lit(kind).alias("kind"), F.concat(F.lit("item:" if key == "item" else "agent:"), F.col(key).cast("string")).alias("signature"), "weight")
    dismissed = spark.createDataFrame([("enrich", "item:1"), ("enrich", "item:2")], "kind string, signature string")
    muted = spark.createDataFrame([("connect",)], "kind string")
    return gov.suggestions([card(u.where("kind = 'error' and item is not null"), "enrich", "item", 15), card(u, "organize", "agent", 75)], dismissed, muted)


@register("streak_decisions", f"""with h as (select agent, count(*) as n, count(*) filter (kind = 'error') / count(*) as rate from ({USAGE}) group by agent), t as (select *, case agent % 3 when 0 then 'small' when 1 then 'medium' else 'large' end as tier from h)
  select agent, case when agent % 2 = 0 and n >= 20 and rate > 0.30 then case tier when 'small' then 'medium' when 'medium' then 'large' else 'disable' end else 'keep' end as decision from t""")
def streak_decisions(spark, d):
    h = usage_events(spark, d).groupBy("agent").agg(F.count("*").alias("n"), (F.count_if(F.col("kind") == "error") / F.count("*")).alias("rate"))
    tier = F.when(F.col("agent") % 3 == 0, "small").when(F.col("agent") % 3 == 1, "medium").otherwise("large")
    kind = F.when(F.col("agent") % 2 == 0, "llm_judge").otherwise("rule")
    return h.select("agent", gov.streak_decision(kind, F.col("n"), F.col("rate"), tier, ["small", "medium", "large"]).alias("decision"))


@register("markdown_report", """select '| source | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || source || ' | ' || n || ' |', chr(10) order by source) as markdown from (select source, count(*) as n from documents group by source)""")
def markdown_report(spark, d):
    counts = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return gov.markdown_table(counts, ["source", "n"], ["source"])
