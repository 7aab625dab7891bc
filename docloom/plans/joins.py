"""Registered join and set queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import joins as op
from docloom.plans.rollups import USAGE, tags
from docloom.sources.tables import items, read, usage_events

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("join_inner", "select l_orderkey, l_linenumber, o_orderdate, l_quantity from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def join_inner(spark, d):
    orders = read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "l_quantity")


@register("join_left_coalesce", "select doc_id, coalesce(quality, -1) as quality from documents left join labels using (doc_id)")
def join_left_coalesce(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@register("join_three_way_distinct", "select distinct n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 0")
def join_three_way_distinct(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.where("c_acctbal > 0").select("c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name").distinct()


@register("cold_demotion", """with s as (select max(o_orderdate) as latest from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')
  select l_orderkey, l_linenumber from lineitem where l_shipdate <= (select latest from s)""")
def cold_demotion(spark, d):
    semantic = read(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_orderdate").alias("created_at"))
    return op.cold_demotion(read(spark, d, "lineitem").withColumn("window_end", F.col("l_shipdate")), semantic).select("l_orderkey", "l_linenumber")


@register("in_list_count", "select count(*) as n from documents where doc_id in (select doc_id from labels where toxic = 1)")
def in_list_count(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").agg(F.count("*").alias("n"))


@register("anti_dismissed", "select doc_id, source from documents where not exists (select 1 from labels where labels.doc_id = documents.doc_id)")
def anti_dismissed(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left_anti")


@register("superseded_sets", """with l as (select distinct l_orderkey as o, l_partkey as p from lineitem), n as (select o, count(*) as n from l group by o)
  select a.o as old_id, b.o as new_id from l a join l b on a.p = b.p and a.o <> b.o join n x on x.o = a.o join n y on y.o = b.o where x.n < y.n group by a.o, b.o, x.n having count(*) = x.n""")
def superseded_sets(spark, d):
    """Orders whose parts are all in another, larger order."""
    sets = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("members"))
    return op.superseded(sets, sets)


#: What counts as an entity of a text: a capitalized word inside a sentence, a number of three digits or more, an e-mail address.
ENTITY = r"[\p{Ll},] \p{Lu}\p{L}+|\p{Nd}{3,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"


@register("shared_entity_links", f"""with e as (select distinct doc_id as i, regexp_replace(unnest(regexp_extract_all(text, '{ENTITY}')), '^. ', '') as e from documents), n as (select count(distinct i) as n from e), d as (select e, count(*) as df from e group by e),
  k as (select e.i, e.e from e join d using (e), n where d.df > 1 and d.df <= greatest(2.0, 0.30 * n.n)), l as (select a.i as a, b.i as b, count(*) as weight, array_to_string(list_sort(list(a.e))[1:4], ' ') as evidence from k a join k b using (e) where a.i < b.i group by 1, 2),
  r as (select *, row_number() over (partition by a order by weight desc, b) as rank from l where weight >= 2) select a, b, weight, evidence, rank from r where rank <= 20""")
def shared_entity_links(spark, d):
    found = F.explode(F.regexp_extract_all("content", F.lit(ENTITY), F.lit(0)))
    mentions = items(spark, d).select("item_id", found.alias("e")).select("item_id", F.regexp_replace("e", "^. ", "").alias("e"))
    return op.shared_entity_links(mentions, "item_id", "e").withColumn("evidence", F.array_join("evidence", " "))


@register("jaccard_recommend", f"""with u as (select distinct agent as id, item from ({USAGE}) where item is not null), c as (select id, count(*) as n from u group by id),
  k as (select a.id as l, b.id as r, count(*) as k, array_to_string(list_sort(list(a.item))[1:5], ' ') as overlap from u a join u b using (item) where a.id < b.id group by 1, 2)
  select l, r, round(k / (x.n + y.n - k), 6) as score, overlap from k join c x on x.id = l join c y on y.id = r where k / (x.n + y.n - k) >= 0.4""")
def jaccard_recommend(spark, d):
    u = usage_events(spark, d).where("item is not null").select(F.col("agent").alias("id"), F.col("item").alias("entity"))
    out = op.jaccard_recommend(u, u, 0.4, once=True)
    return out.withColumn("overlap", F.array_join(F.transform("overlap", lambda x: x.cast("string")), " "))


@register("overlapping_windows", f"""with w as (select id, ts_s as s, ts_s + 1800 as e, kind from ({USAGE})) select a.id as a_id, b.id as b_id from w a join w b on a.s < b.e and b.s < a.e where a.kind = 'purchase' and b.kind = 'error'""")
def overlapping_windows(spark, d):
    w = usage_events(spark, d).select("id", F.col("ts_s").alias("start"), (F.col("ts_s") + 1800).alias("end"), "kind")
    return op.overlapping(w.where("kind = 'purchase'").drop("kind"), w.where("kind = 'error'").drop("kind"), 3600).select("a_id", "b_id")


@register("explicit_references", "select doc_id as item_id, item_id as ref_id from documents d, benchmark b where contains(d.text, b.text) and trim(b.text) <> ''", )
def explicit_references(spark, d):
    refs = read(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("body"))
    return op.explicit_references(items(spark, d), refs)


SQL["explicit_references"] = "select d.doc_id as item_id, b.item_id as ref_id from documents d join benchmark b on contains(d.text, b.text) where trim(b.text) <> ''"


@register("tag_and", "select doc_id from labels where quality = 1 intersect select doc_id from labels where toxic = 1")
def tag_and(spark, d):
    return op.all_of(tags(spark, d), "doc_id", [("quality", "1"), ("toxic", "1")])


@register("tag_or", "select distinct doc_id from labels where quality = 0 or toxic = 1")
def tag_or(spark, d):
    return op.any_of(tags(spark, d), "doc_id", [("quality", "0"), ("toxic", "1")])


@register("watch_matches", """with w(watch_id, kws, threshold) as (values (1, ['idiot', 'moron', 'scum'], 0.6), (2, ['license', 'apache', 'version'], 0.9), (3, ['que', 'para', 'los', 'las'], 0.75)),
  t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as t from documents), p as (select watch_id, unnest(kws) as t, len(kws) as n, threshold from w),
  f as (select watch_id, doc_id, count(*) / any_value(n) as raw, any_value(threshold) as threshold from t join p using (t) group by 1, 2)
  select watch_id, doc_id as item_id, round(raw * pow(0.5, (doc_id % 30) / 14.0) * case when source = 'src3' then 1.5 else 1.0 end * (1 + 0.1 * ln(1 + doc_id % 4)), 6) as score from f join documents using (doc_id) where raw >= threshold""")
def watch_matches(spark, d):
    weights = F.create_map(F.lit("src3"), F.lit(1.5))
    rows = [(1, ["idiot", "moron", "scum"], 0.6), (2, ["license", "apache", "version"], 0.9), (3, ["que", "para", "los", "las"], 0.75)]
    watches = spark.createDataFrame(rows, "watch_id int, keywords array<string>, threshold double").select("*", weights.alias("source_weights"), F.lit(True).alias("enabled"))
    it = items(spark, d).select("item_id", tx.tokens(F.col("content")).alias("tokens"), F.col("source_type").alias("source"), (F.col("item_id") % 30).alias("age_days"), (F.col("item_id") % 4).alias("interactions"))
    return op.watch_matches(it, watches)


@register("annotation_scores", """with a as (select doc_id, case when toxic = 1 then 'drop' when quality = 1 then 'strong' else 'medium' end as label from labels)
  select d.doc_id, round(case when label = 'drop' then 0 else ln(n_chars) * case label when 'strong' then 1.5 when 'medium' then 1.2 else 1.0 end end, 6) as score from documents d left join a using (doc_id)""")
def annotation_scores(spark, d):
    label = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "strong").otherwise("medium")
    notes = read(spark, d, "labels").select("doc_id", label.alias("label"))
    return op.annotation_scores(read(spark, d, "documents").select("doc_id", F.log("n_chars").alias("score")), notes, "doc_id")


@register("exact_duplicates", "with h as (select doc_id, sha256(text) as h from documents) select h as content_hash, min(doc_id) as first_id, count(*) as n from h group by h having count(*) > 1")
def exact_duplicates(spark, d):
    return items(spark, d).groupBy(tx.content_hash(F.col("content")).alias("content_hash")).agg(F.min("item_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@register("content_hash_dedup", "select doc_id as item_id, source as source_type from (select *, row_number() over (partition by sha256(text) order by doc_id) as r from documents) where r = 1")
def content_hash_dedup(spark, d):
    it = items(spark, d).select("item_id", "source_type", tx.content_hash(F.col("content")).alias("h"))
    return it.groupBy("h").agg(F.min_by(F.struct("item_id", "source_type"), "item_id").alias("s")).select("s.item_id", "s.source_type")


@register("snapshot_diff", """with a as (select doc_id, md5(text) as h from documents where doc_id % 11 <> 3), b as (select doc_id, case when doc_id % 7 = 0 then md5('changed' || text) else md5(text) end as h from documents where doc_id % 13 <> 5),
  j as (select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'deleted' when a.h = b.h then 'skipped' else 'updated' end as status from a full join b using (doc_id)) select status, count(*) as n from j group by status""")
def snapshot_diff(spark, d):
    from docloom.sources.files import diff_snapshots

    it = items(spark, d)
    old = it.where("item_id % 11 <> 3").select(F.col("item_id").alias("path"), F.md5(F.col("content").cast("binary")).alias("content_hash"))
    text = F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("changed"), "content")).otherwise(F.col("content"))
    new = it.where("item_id % 13 <> 5").select(F.col("item_id").alias("path"), F.md5(text.cast("binary")).alias("content_hash"))
    return diff_snapshots(old, new).groupBy("status").agg(F.count("*").alias("n"))
