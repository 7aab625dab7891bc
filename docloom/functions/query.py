"""Query-side values, computed once on the driver: needles, time filters, expansion, plans. Prices and tiers as column ladders."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: prices per thousand tokens by model prefix (the longer prefix first), windows, evidence thresholds
PRICES = [("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4o", 0.0025, 0.01)]
#: Context windows by what a model's name contains, the first that fits; another has the last.
WINDOWS = [("gemini.*(2\\.5|2\\.0|1\\.5)|(2\\.5|2\\.0|1\\.5).*gemini", 1_000_000), ("claude", 200_000), ("gpt-4o|gpt-4\\.1|gpt-4-turbo|glm-4|moonshot|kimi", 128_000), ("deepseek", 64_000), ("gpt-3\\.5", 16_000), ("qwen|gemini|llama", 32_000), ("", 8_000)]
DAY = 86400


def needles(query: str) -> list[str]:
    """Strings to look for in texts: identifiers with their compact form and parts, pairs and triples of Han characters and short runs."""
    out: set[str] = set()
    for word in re.findall(r"[A-Za-z0-9][A-Za-z0-9_./:-]*[A-Za-z0-9]|[A-Za-z0-9]", query):
        low = word.lower()
        if len(low) >= 2:
            out |= {low, re.sub(r"[^a-z0-9]", "", low), *(p for p in re.split(r"[^a-z0-9]+", low) if len(p) >= 2)}
    for run in re.findall(r"[一-鿿]{2,}", query):
        out |= {run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)} | ({run} if len(run) <= 6 else set())
    return sorted(x for x in out if x)


def needle_weight(needle: str) -> int:
    """6 for identifiers with punctuation, 4 with digits, 4 for long ones, 2 for medium, 1 for short."""
    if re.search(r"[_./:-]", needle):
        return 6
    if re.search(r"[0-9]", needle) or len(needle) >= 8:
        return 4
    return 2 if len(needle) >= 4 else 1


def lexical_score(text: Column, wanted: list[str]) -> Column:
    """.25 + min(coverage, 1.5) + min(.01 * weight, .35) where three needles and a tenth of them are found, else null."""
    low = F.lower(text)
    hits = [F.contains(low, F.lit(n)).cast("int") for n in wanted]
    matched = sum(hits, F.lit(0))
    weight = sum((h * needle_weight(n) for h, n in zip(hits, wanted)), F.lit(0))
    coverage = matched / max(len(wanted), 1)
    return F.when((matched >= 3) & (coverage >= 0.10), 0.25 + F.least(coverage, F.lit(1.5)) + F.least(0.01 * weight, F.lit(0.35)))


def excerpt(text: Column, needle: str, size: int = 2400) -> Column:
    """Up to ``size`` characters around the first place of a needle; the start of the text where it isn't found."""
    at = F.greatest(F.locate(needle, F.lower(text)) - size // 2, F.lit(1))
    return F.substring(text, at, F.lit(size))


def time_filter(query: str, now: int) -> tuple[int, int] | None:
    """[start, end) in epoch seconds of the first time expression, English or Chinese; None without one."""
    q, today = query.lower(), now - now % DAY
    if m := re.search(r"(\d{1,3})\s*(?:days? ago|天前)", q):
        start = today - int(m[1]) * DAY
        return start, start + DAY
    monday = today - ((today // DAY + 3) % 7) * DAY
    for words, span in (
        (("the day before yesterday", "前天"), (today - 2 * DAY, today - DAY)), (("yesterday", "昨天"), (today - DAY, today)), (("today", "今天"), (today, today + DAY)),
        (("last week", "上周"), (monday - 7 * DAY, monday)), (("this week", "本周"), (monday, monday + 7 * DAY)),
    ):
        if any(w in q for w in words):
            return span
    return None


def query_shape(query: str, now: int) -> str:
    """overview by a marker or for a short broad question, recall by a time word, else precise."""
    q = query.lower()
    if re.search("总结|概括|概述|overview|summar", q):
        return "overview"
    if time_filter(query, now):
        return "recall"
    return "overview" if len(re.findall(r"[^\W_]+", q)) <= 6 and not re.search(r'[`"“/._0-9]|\(\)|::', q) else "precise"


def expand(query: str, table: dict[str, list[str]]) -> str:
    """The query with the learned terms of its exact pattern that it doesn't hold yet."""
    more = [t for t in table.get(query.strip().lower(), []) if t.lower() not in query.lower()]
    return " ".join([query, *more])


def expand_all(queries: DataFrame, table: DataFrame) -> DataFrame:
    """The same for a table of queries (query) and a learned table (pattern, terms)."""
    joined = queries.withColumn("pattern", F.lower(F.trim("query"))).join(table, "pattern", "left")
    fresh = F.filter("terms", lambda t: ~F.contains(F.lower("query"), F.lower(t)))
    return joined.select("query", F.concat_ws(" ", "query", F.coalesce(fresh, F.array().cast("array<string>"))).alias("expanded"))


def without_instructions(query: str) -> str:
    """The query without trailing sentences that only say how to answer."""
    parts = re.split(r"(?<=[。.!?！？])\s*", query.strip())
    while len(parts) > 1 and re.search(r"^(please |请)?(answer|cite|reply|respond|回答|引用|列出)", parts[-1].lower() or "answer"):
        parts.pop()
    return " ".join(p for p in parts if p)


@dataclass(frozen=True)
class Plan:
    """What a query asks of retrieval: its channels with sizes, score floor, rerank and budget."""

    language: str
    exact: bool
    vector_k: int
    text_k: int
    min_score: float
    top: int
    budget: int


def plan(query: str, top: int = 10) -> Plan:
    han = len(re.findall("[一-鿿]", query))
    exact = bool(re.search(r'[`"“_]|::|\d', query)) or (len(query.split()) <= 2 and len(query) <= 48)
    broad = len(query.split()) > 12
    return Plan("zh" if han >= 0.3 * max(len(query.replace(" ", "")), 1) else "en", exact, 0 if exact else 100 if broad else 50, 100 if exact or broad else 50, 0.65, top, 4000 if broad else 2000)


def domain_of(query: str, domains: list[tuple[str, list[str]]]) -> str | None:
    """Domain with most keywords in the query; the first one wins a tie; None without a hit."""
    counts = [(sum(k.lower() in query.lower() for k in keys), -i, name) for i, (name, keys) in enumerate(domains)]
    best = max(counts, default=(0, 0, None))
    return best[2] if best[0] else None


def price(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Cost in dollars; null for a model without a known price."""
    out = None
    for prefix, i, o in PRICES:
        cost = tokens_in * i / 1000 + tokens_out * o / 1000
        hit = F.startswith(F.lower(model), F.lit(prefix))
        out = F.when(hit, cost) if out is None else out.when(hit, cost)
    return out


def context_window(model: Column) -> Column:
    """Tokens that a model takes, by its name."""
    fits = [F.when(F.lower(model).rlike(pattern), size) for pattern, size in WINDOWS]
    return F.coalesce(*fits, F.lit(WINDOWS[-1][1]))


def batch_estimate(items: DataFrame, model: Column, capability: str) -> DataFrame:
    """(model, n, tokens_in, tokens_out, cost) of a batch of items (tokens): a summary is an eighth of the input, a rewrite as long, and an
    extraction uses no model, so that it costs nothing. cost is null for a model without a price."""
    by = items.groupBy(model.alias("model")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens_in"))
    if capability == "extract":
        return by.select("model", "n", F.lit(0).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(0.0).alias("cost"))
    share = {"summarize": 8, "rewrite": 1}[capability]
    out = by.withColumn("tokens_out", F.floor(F.col("tokens_in") / share))
    return out.withColumn("cost", price(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))


def json_block(text: Column) -> Column:
    """Contents of the first fenced block of JSON, else of the first fenced block, else null."""
    blocks = [F.regexp_extract(text, rf"(?s)```{mark}(.*?)```", 1) for mark in ("json", "")]
    has = [text.rlike(rf"(?s)```{mark}.*?```") for mark in ("json", "")]
    return F.regexp_replace(F.when(has[0], blocks[0]).when(has[1], blocks[1]), r"^\s+|\s+$", "")


def resolved(reference: Column, states: Column, event: Column) -> Column:
    """Value of ``$event.field`` in a JSON event, or of ``$step.field`` in a map from steps to their JSON (the whole state where the field is
    missing); null where nothing is found, and other texts as they are. Objects and arrays come as JSON."""
    root, field = F.regexp_extract(reference, r"(?s)^\$+([^.]*)\.", 1), F.regexp_extract(reference, r"(?s)^\$+[^.]*\.(.*)$", 1)
    fields = lambda c: F.from_json(c, "map<string,string>")
    state = F.try_element_at(states, root)
    found = F.when(F.map_contains_key(fields(state), field), F.try_element_at(fields(state), field)).otherwise(state)
    value = F.when(root == "event", F.try_element_at(fields(event), field)).otherwise(found)
    return F.when(reference.rlike(r"^\$+[^.]*\."), value).otherwise(reference)


def source_key(hashes: Column) -> Column:
    """The key of a set of hashes: a JSON array in ascending order."""
    return F.to_json(F.sort_array(hashes))


def series_f1(predicted: Column, truth: Column, tolerance: float) -> Column:
    """F1 of named series, arrays of (name, values): one counts if a true one has its name, its length and values within the relative tolerance."""
    near = lambda p, t: F.forall(F.zip_with(p["values"], t["values"], lambda a, b: relative_error(a, b) <= tolerance), lambda ok: ok)
    same = lambda p, t: (p["name"] == t["name"]) & (F.size(p["values"]) == F.size(t["values"])) & near(p, t)
    hits = F.size(F.filter(predicted, lambda p: F.exists(truth, lambda t: same(p, t))))
    empty = (F.size(predicted) == 0) & (F.size(truth) == 0)
    return F.when(empty, 1.0).when((F.size(predicted) == 0) | (F.size(truth) == 0), 0.0).otherwise(2.0 * hits / (F.size(predicted) + F.size(truth)))


def relative_error(predicted: Column, truth: Column) -> Column:
    return F.abs(predicted - truth) / F.greatest(F.abs(truth), F.lit(1e-9))


def is_private_host(host: Column) -> Column:
    """Whether a host is local, private, link-local or carrier-grade: not for outbound calls."""
    return F.lower(host).rlike(r"^(localhost|.*\.local|.*\.internal)$|^(127|10|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^(\[?::1\]?|\[?f[cd][0-9a-f]{2}:.*|\[?fe80:.*)$")


def citation(style: str, n: Column, author: Column, year: Column, title: Column, source: Column) -> Column:
    """A numbered reference in one of four styles."""
    shapes = {"ieee": ("[%d] %s, \"%s,\" %s, %s.", (n, author, title, source, year)), "apa": ("%s (%s). %s. %s.", (author, year, title, source)), "mla": ("%s. \"%s.\" %s, %s.", (author, title, source, year)), "gbt7714": ("[%d] %s. %s[J]. %s, %s.", (n, author, title, source, year))}
    shape, args = shapes[style]
    return F.format_string(shape, *args)
