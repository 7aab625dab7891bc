"""Registered queries on source hints, stale vectors, intake of signals, estimates and recognized values, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import entities as en
from docloom.functions import hints as hi
from docloom.functions import query as qu
from docloom.functions import text as tx
from docloom.operators import intake, upkeep
from docloom.operators.retrieval import ranked
from docloom.plans.rollups import USAGE
from docloom.sources.tables import items, read, usage_events

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


HINTS = "Blog pages of example.net as pdf or markdown, feeds and news from ES, excluding utm tags"
TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'))"
SOURCE = f"select page_id as item_id, translate({TITLE} || chr(10) || url, '{hi._UPPER}', '{hi._LOWER}') as s from pages"
_NEAR = " or ".join(["(x = q)", "(length(q) >= 3 and length(x) >= 3 and (starts_with(x, q) or starts_with(q, x)))"])
_FOUND = f"""select item_id, s, list_distinct(list_transform(list_filter(regexp_extract_all(s, '[a-z0-9]{{2,}}'), lambda w: w not in ({quoted(hi.STOPWORDS)})),
  lambda w: case when length(w) > 3 and ends_with(w, 's') and w not in ({quoted(hi.KEPT_WHOLE)}) then w[:-2] else w end)) as f from ({SOURCE})"""


def source(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.concat_ws("\n", tx.html_title(F.col("html")), "url").alias("source"))


@register("source_candidates", f"""with f as ({_FOUND}), w as (select [{quoted(sorted(hi.hint_words(HINTS)))}] as q, [{quoted(sorted(hi.excluded_words(HINTS)))}] as e),
  b as (select item_id, round(least(0.05 * len(list_filter(q, lambda q: len(list_filter(f, lambda x: {_NEAR})) > 0)), 0.30) + least(0.05 * len(list_intersect(f, list_filter(q, lambda q: length(q) >= 3))), 0.30)
    - least(0.18 * len(list_intersect(f, e)), 0.36) + case when contains(s, '.pdf') then 0.04 else 0 end + case when contains(s, '.md') or contains(s, 'markdown') then 0.04 else 0 end, 6)::double as score from f, w)
  select item_id, score, row_number() over (order by score desc, item_id)::int as rank from b where score > 0.10 order by score desc, item_id limit 50""")
def source_candidates(spark, d):
    """Pages whose title and address fit the hints of a query, best first, over all pages."""
    scored = source(spark, d).select("item_id", hi.hint_boost(HINTS, F.col("source")).alias("score"))
    return ranked(scored.where("score > 0.10"), 50)


SCOPES = "API guide of example.net/es for the ES feed"


@register("scope_adjustment", f"""with r as (select item_id, list_filter(list_transform(regexp_extract_all(s, '[a-z0-9_/.-]+'), lambda w: regexp_replace(w, '^[-_/.]+|[-_/.]+$', '', 'g')), lambda w: length(w) >= 2 and regexp_matches(w, '[-0-9_/.]')) as n from ({SOURCE})),
  p as (select item_id, list_concat(n, list_filter(flatten(list_transform(list_filter(n, lambda w: regexp_matches(w, '[-_/.]')), lambda w: regexp_split_to_array(w, '[-_/.]'))), lambda x: length(x) >= 2 and x not in ({quoted(hi.NO_COMPONENT)}))) as f from r),
  g as (select item_id, list_has_any(f, [{quoted(sorted(hi.scopes(SCOPES)))}]) as m, len(list_filter(f, lambda x: x not in ({quoted(sorted(hi.scopes(SCOPES)))}))) > 0 as c from p)
  select item_id, (case when m and c then 0.5 when m then 0.7 when c then -0.9 else 0 end)::double as adjustment from g""")
def scope_adjustment(spark, d):
    """What the scopes named in a query add to each page's score."""
    return source(spark, d).select("item_id", hi.scope_adjustment(SCOPES, F.col("source")).alias("adjustment"))


@register("search_recovery", f"select agent, count(*) filter (kind = 'click') as n_results, count(*) filter (kind = 'error') as n_cut, count(*) filter (kind = 'click') = 0 or (count(*) filter (kind = 'error') > 0 and count(*) filter (kind = 'click') < 3) as again from ({USAGE}) group by agent")
def search_recovery(spark, d):
    """Agents whose results (clicks) are so few that their search is run again; errors stand for results that were cut off."""
    each = usage_events(spark, d).groupBy("agent").agg(F.count_if(F.col("kind") == "click").alias("n_results"), F.count_if(F.col("kind") == "error").alias("n_cut"))
    return each.withColumn("again", hi.needs_recovery(F.col("n_results"), F.col("n_cut"), F.lit(10)))


#: Models of the stored vectors by their label; the last one isn't known.
MODELS = "case label % 4 when 0 then 'base-1' when 1 then 'base-2' when 2 then ' base-2 ' else '' end"


def modelled(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label", F.expr(MODELS).alias("model"))


@register("vector_compatibility", f"""with v as (select label, nullif(trim({MODELS}), '') as model, count(*) as n from embeddings group by all)
  select *, case when model is null then 'unknown' when model = 'base-2' then 'match' else 'mismatch' end as status, coalesce(model, 'base-2') = 'base-2' as usable, case when coalesce(model, 'base-2') = 'base-2' then 0 else n end as stale from v""")
def vector_compatibility(spark, d):
    """Whether the vectors of each label fit the present model."""
    return upkeep.compatibility(modelled(spark, d), "label", "model", "base-2")


@register("usable_vectors", f"select vec_id as item_id from embeddings where coalesce(nullif(trim({MODELS}), ''), 'base-2') = 'base-2'")
def usable_vectors(spark, d):
    return upkeep.usable_vectors(modelled(spark, d), "model", "base-2").select("item_id")


@register("stale_memories", f"select vec_id as item_id, {MODELS} as from_model from embeddings where {MODELS} <> 'base-2'")
def stale_memories(spark, d):
    """Vectors to embed again, with the model they come from."""
    return upkeep.stale_ids(modelled(spark, d), "item_id", "model", "base-2").select("item_id", F.col("from_models")[0].alias("from_model"))


@register("memory_migration", f"select {MODELS} as from_model, count(*) as n, {MODELS} = 'base-2' as done from embeddings group by all")
def memory_migration(spark, d):
    return upkeep.migration(modelled(spark, d), "model", "base-2")


@register("reindex_tasks")
def reindex_tasks(spark, d):
    """New chunk tasks of every item whose vector is stale, by level; the purge is tested on its own."""
    v = modelled(spark, d)
    tasks = upkeep.reindex(items(spark, d), upkeep.stale_ids(v, "item_id", "model", "base-2"), v, v)[2]
    return tasks.groupBy("item_id", "level").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


GATES = "select p_brand as plugin, 'tier ' || p_size % 3 as tier, p_size > 40 as external, p_partkey % 7 = 0 as ignored, case when p_size % 5 = 0 then 'nightly' end as ci from part"


def gates(spark, d):
    return read(spark, d, "part").selectExpr("p_brand as plugin", "'tier ' || p_size % 3 as tier", "p_size > 40 as external", "p_partkey % 7 = 0 as ignored", "case when p_size % 5 = 0 then 'nightly' end as ci")


_GATES = "count(*) as n, count(*) filter (external) as n_external, count(*) filter (ignored) as n_ignored, count(*) filter (ci = 'nightly') as n_nightly"


@register("quality_rollup", f"with g as ({GATES}) select 'tier' as dim, tier as val, {_GATES} from g group by tier union all select 'plugin', plugin, {_GATES} from g group by plugin union all select 'all', '', {_GATES} from g")
def quality_rollup(spark, d):
    return upkeep.roll_up(gates(spark, d))


@register("ignore_spikes", f"with g as ({GATES}), o as (select plugin, count(*) filter (ignored) as observed, count(*) filter (external) as baseline from g group by plugin) select plugin, observed, baseline, observed > baseline + 2 as spiked from o")
def ignore_spikes(spark, d):
    by = gates(spark, d).groupBy("plugin")
    return upkeep.ignore_spikes(by.agg(F.count_if("ignored").alias("observed")), by.agg(F.count_if("external").alias("baseline")), "plugin")


@register("signal_intake", f"""select case when kind is null or kind not in ({quoted(intake.SIGNALS)}) then 'kind' when octet_length(ref_id::blob) > 128 then 'ref' else 'none' end as problem, count(*) as n, count(distinct ref_id) as n_refs from
  (select case kind when 'click' then 'click_through' when 'view' then 'dwell' when 'error' then 'search_miss' else kind end as kind, repeat(item::varchar || '-', 1 + (id % 50)::int) as ref_id from ({USAGE})) group by 1""")
def signal_intake(spark, d):
    """Events offered as signals, by what is wrong with them."""
    kind = F.when(F.col("kind") == "click", "click_through").when(F.col("kind") == "view", "dwell").when(F.col("kind") == "error", "search_miss").otherwise(F.col("kind"))
    raw = usage_events(spark, d).select(kind.alias("kind"), F.repeat(F.concat(F.col("item").cast("string"), F.lit("-")), (1 + F.col("id") % 50).cast("int")).alias("ref_id"))
    found = intake.checked(raw, "kind", intake.SIGNALS, "ref_id")
    return found.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.countDistinct("ref_id").alias("n_refs"))


@register("pending_signals", f"select kind, count(*) as n from ({USAGE}) e where not exists (select 1 from orders o where o.o_orderkey = e.id) group by kind")
def pending_signals(spark, d):
    """Events that aren't processed, where the keys of the orders are those processed."""
    done = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return intake.pending(usage_events(spark, d), done).groupBy("kind").agg(F.count("*").alias("n"))


PEPPER = "a pepper of the store"
_PAD = {x: "".join(f"\\x{b ^ x:02X}" for b in PEPPER.encode().ljust(64, b"\0")) for x in (0x36, 0x5C)}


@register("page_visits", f"""with p as (select page_id, url, {TITLE} as title, lower(regexp_extract(case when contains(url, '://') then string_split(url, '://')[-1] else url end, '^([^/:?#]*)', 1)) as host from pages)
  select page_id, url[:2048] as url, title[:512] as title, sha256('{_PAD[0x5C]}'::blob || unhex(sha256('{_PAD[0x36]}'::blob || encode(host)))) as domain_hash from p where host <> 'www.ththin.example.com'""")
def page_visits(spark, d):
    """Pages as stored visits, after one domain was cleared."""
    p = read(spark, d, "pages").select("page_id", "url", tx.html_title(F.col("html")).alias("title"))
    return intake.without_domain(intake.visits(p, tx.url_domain(F.col("url")), PEPPER), "www.ththin.example.com", PEPPER)


@register("bookmark_counts", "select count(*) as n, count(*) filter (not contains(url, 'feed')) as n_pending from pages")
def bookmark_counts(spark, d):
    return intake.bookmark_counts(read(spark, d, "pages").select(F.contains("url", F.lit("feed")).alias("promoted")))


MODEL = "case lang when 'en' then 'gpt-4o' when 'de' then 'gpt-4o-mini' else 'qwen-' || lang end"


@register("batch_estimates", f"""with t as (select {MODEL} as model, ceil(round(han * 0.6 + (length(text) - han) * 0.25, 6))::bigint as tokens from (select lang, text, length(text) - length(regexp_replace(text, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) as han from documents)),
  b as (select model, count(*) as n, sum(tokens)::bigint as tokens_in from t group by 1)
  select model, n, tokens_in, tokens_in // 8 as tokens_out, round(case model when 'gpt-4o' then tokens_in * 0.0025 / 1000 + (tokens_in // 8) * 0.01 / 1000 when 'gpt-4o-mini' then tokens_in * 0.00015 / 1000 + (tokens_in // 8) * 0.0006 / 1000 end, 6) as cost,
  (case when starts_with(model, 'gpt-4o') then 128000 else 32000 end)::int as context_window from b""")
def batch_estimates(spark, d):
    """Tokens and cost of summaries of all documents, by model."""
    each = items(spark, d).select("lang", tx.token_estimate(F.col("content")).alias("tokens"))
    out = qu.batch_estimate(each, F.expr(MODEL), "summarize")
    return out.withColumn("cost", F.round("cost", 6)).withColumn("context_window", qu.context_window(F.col("model")))


@register("json_blocks", """select event_id, case when event_id % 3 = 0 and coalesce(t, '') not like '%```%```%' then null else props end as block, case when event_id % 3 = 0 then -1 else coalesce(json_extract(props, '$.k')::bigint, -1) end as k
  from events left join (select conv_id, coalesce(text, '') as t from conversations where turn = 0) on conv_id = event_id % 100""")
def json_blocks(spark, d):
    """The JSON block of replies that quote an event's properties behind a conversation's first turn: fenced with or without a language, or not at all."""
    first = read(spark, d, "conversations").where("turn = 0").select((F.col("conv_id")).alias("c"), F.coalesce("text", F.lit("")).alias("t"))
    e = read(spark, d, "events").select("event_id", "props", (F.col("event_id") % 100).alias("c")).join(first, "c", "left")
    body, text = F.concat(F.col("props"), F.lit("\n")), F.coalesce("t", F.lit(""))
    fenced = F.when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("\n```json\n"), body, F.lit("```\nand ```x```"))).when(F.col("event_id") % 3 == 2, F.concat(text, F.lit("\n```\n"), body, F.lit("```"), text))
    found = e.select("event_id", qu.json_block(fenced.otherwise(F.concat(text, body))).alias("block"))
    return found.withColumn("k", F.coalesce(F.get_json_object("block", "$.k").cast("long"), F.lit(-1)))


@register("series_scores", """with l as (select l_orderkey, l_returnflag, list(l_quantity order by l_linenumber) as p, list(round(l_quantity / 5) * 5 order by l_linenumber) as t from lineitem group by all),
  h as (select l_orderkey, len(list_filter(list_zip(p, t), lambda z: abs(z[1] - z[2]) / greatest(abs(z[2]), 1e-9) > 0.05)) = 0 as ok from l)
  select l_orderkey as order_id, round(count(*) filter (ok) / count(*), 6) as f1 from h group by 1""")
def series_scores(spark, d):
    """Quantities of each order by return flag, held against the same rounded to fives, within 5 %."""
    line = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("name")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    values = F.transform("v", lambda x: x["l_quantity"])
    truth = F.transform(values, lambda x: F.round(x / 5) * 5)
    both = line.groupBy("l_orderkey").agg(F.collect_list(F.struct("name", values.alias("values"))).alias("p"), F.collect_list(F.struct("name", truth.alias("values"))).alias("t"))
    return both.select(F.col("l_orderkey").alias("order_id"), F.round(qu.series_f1(F.col("p"), F.col("t"), 0.05), 6).alias("f1"))


DEAL = ["王小明于", "在海淀区支付", "元给华信有限公司。"]


@register("rich_entities", """select doc_id as item_id, '王小明' as person, '2024-03-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as day, n_chars::double as amount, case when n_chars >= 1 then n_chars || '元' end as raw, '日在海淀区' as place, '元给华信有限公司' as body from documents""")
def rich_entities(spark, d):
    """The five kinds of rich entities in a sentence made for each document."""
    day = F.concat(F.lit("2024年3月"), (F.col("doc_id") % 28 + 1).cast("string"), F.lit("日"))
    text = F.concat(F.lit(DEAL[0]), day, F.lit(DEAL[1]), F.col("n_chars").cast("string"), F.lit(DEAL[2]))
    e = read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), en.rich_entities(text).alias("e"))
    first = lambda name: F.get(f"e.{name}", F.lit(0))
    return e.select("item_id", first("persons").alias("person"), first("dates").alias("day"), first("amounts")["value"].alias("amount"), first("amounts")["raw"].alias("raw"), first("locations").alias("place"), first("organizations").alias("body"))


@register("resolved_values", """select event_id as id, case event_id % 4 when 0 then json_extract_string(props, '$.k') when 1 then event_type when 2 then '{"kind":"' || event_type || '"}' else 'plain' end as value from events""")
def resolved_values(spark, d):
    """A reference of each event, resolved in its properties or in the state of a step."""
    ref = F.element_at(F.array(*map(F.lit, ["$event.k", "$last.kind", "$last.none", "plain"])), (F.col("event_id") % 4 + 1).cast("int"))
    states = F.create_map(F.lit("last"), F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), qu.resolved(ref, states, F.col("props")).alias("value"))


@register("source_keys", f"""select agent, '["' || array_to_string(list_sort(list(distinct kind)), '","') || '"]' as key from ({USAGE}) group by agent""")
def source_keys(spark, d):
    """The key of the kinds that each agent uses."""
    return usage_events(spark, d).groupBy("agent").agg(qu.source_key(F.collect_set("kind")).alias("key"))
