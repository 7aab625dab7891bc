"""Registered relational queries: grouping sets, windows, set operations and star-schema reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources.tables import read

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@register("pricing_summary", """select l_returnflag, l_linestatus, sum(l_quantity)::double as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_quantity), 6) as avg_qty, count(*) as n
  from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, d):
    l = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@register("top_open_orders", """select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
  where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1995-03-15' group by o_orderkey, o_orderdate order by revenue desc, o_orderkey limit 10""")
def top_open_orders(spark, d):
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = read(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1995-03-15").cast("timestamp_ntz")).select("o_orderkey", "o_custkey", "o_orderdate")
    l = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = l.join(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum("r"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@register("nation_revenue", """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name""")
def nation_revenue(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    l = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@register("grouping_sets", "select event_type, coalesce(user_id % 5, -1) as g, count(*) as n, grouping_id(event_type, user_id % 5)::bigint as gid from events group by cube (event_type, user_id % 5)")
def grouping_sets(spark, d):
    return read(spark, d, "events").withColumn("g", F.col("user_id") % 5).cube("event_type", "g").agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).fillna({"g": -1})


@register("rollup_days", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by rollup (strftime(ts, '%Y-%m-%d'), event_type)")
def rollup_days(spark, d):
    return read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).rollup("day", "event_type").agg(F.count("*").alias("n"))


@register("window_running", "select event_id, user_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running, lag(event_type) over (partition by user_id order by ts, event_id) as before from events")
def window_running(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events")
    return e.select("event_id", "user_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lag("event_type").over(w).alias("before"))


@register("top_per_group", "select c_mktsegment, c_custkey, c_acctbal, r::int as rank from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from customer) where r <= 5")
def top_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, d, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@register("set_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, d):
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@register("set_except", "select c_custkey as k from customer except select o_custkey from orders")
def set_except(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, d, "orders").select("o_custkey"))


@register("page_offset", "select doc_id, source from documents order by n_chars desc, doc_id limit 20 offset 40")
def page_offset(spark, d):
    return read(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "source").offset(40).limit(20)


@register("stale_items", "select event_id, ts from events where ts < timestamp '2024-01-10' order by ts, event_id limit 25")
def stale_items(spark, d):
    return read(spark, d, "events").where(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).orderBy("ts", "event_id").select("event_id", "ts").limit(25)


@register("path_prefix", "select distinct page_id, url from pages where starts_with(url, 'https://')")
def path_prefix(spark, d):
    return read(spark, d, "pages").where(F.startswith("url", F.lit("https://"))).select("page_id", "url").distinct()


@register("engaged", "select user_id, count(*) as n from events where value >= 50 and event_type in ('purchase', 'click') and (props::json->>'k')::bigint >= 1 group by user_id")
def engaged(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").where((F.col("value") >= 50) & F.col("event_type").isin("purchase", "click") & (k >= 1)).groupBy("user_id").agg(F.count("*").alias("n"))


@register("source_mix", "select source, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'de') as de, count(*) filter (lang = 'fr') as fr, count(*) filter (lang = 'es') as es from documents group by source")
def source_mix(spark, d):
    langs = ["en", "de", "fr", "es"]
    return read(spark, d, "documents").groupBy("source").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in langs])
