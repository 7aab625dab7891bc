"""Joins and set operations between items, entities, windows, watches and references.

All are equi-joins at heart: pairs meet through a shared key or bucket and are verified, never through a full product."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.vector import cosine
from docloom.operators import incidence, set_join
from docloom.operators.patterns import key_of, named, occurrences
from docloom.operators.skew import meet, thinned
from docloom.sources.shared import stored


def shared_entity_links(mentions: DataFrame, item: str, entity: str, min_shared: int = 2, share: float = 0.30, degree: int = 20, evidence: int = 4) -> DataFrame:
    """Links a < b between items that share ``min_shared`` entities, with up to ``evidence`` of them, the ``degree`` heaviest for each a.

    Entities of more than max(2, share of all items) items say nothing and are left out. Items with equal entities are one class; classes are joined, and an item
    meets of each class no more than the ``degree`` members that can be among its links."""
    each = stored(mentions.where(F.col(item).isNotNull() & F.col(entity).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(entity).alias("token")).distinct(), "mentions")
    n = each.agg(F.countDistinct("id").alias("n_items"))
    df = each.groupBy("token").agg(F.count("*").alias("n"))
    useful = stored(df.join(F.broadcast(n)).where((F.col("n") <= F.greatest(F.lit(2.0), share * F.col("n_items"))) & (F.col("n") > 1)).drop("n_items"), "useful")
    named, members = set_join.classes(meet(each, useful, "token", F.xxhash64("id")))
    pairs = stored(set_join.overlapping(named, min_shared), "pairs")
    own = named.where(F.col("n") >= min_shared).select(F.col("class").alias("a"), F.col("class").alias("b"), F.sort_array(F.transform("set", lambda s: s["token"])).alias("common"))
    ways = stored(pairs.select("a", "b", "common").union(pairs.select(F.col("b"), F.col("a"), "common")).union(own), "ways")
    sent = ways.select("a", F.col("b").alias("class")).join(members.select(F.col("class").alias("a"), "id"), "a").select("class", F.col("id").alias("a"))
    met = set_join.next_members(sent, members, degree).select(F.col("class").alias("to"), "a", "id")
    linked = met.join(members.select(F.col("class").alias("from"), F.col("id").alias("a")), "a").join(ways.select(F.col("a").alias("from"), F.col("b").alias("to"), "common"), ["from", "to"])
    order = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    links = linked.select("a", F.col("id").alias("b"), F.size("common").cast("long").alias("weight"), F.slice("common", 1, evidence).alias("evidence"))
    return links.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= degree)


def jaccard_recommend(left: DataFrame, right: DataFrame, threshold: float = 0.6, most: int = 5, once: bool = False) -> DataFrame:
    """(l, r, score, overlap): pairs of (id, entity) sets with Jaccard at or above the threshold, with up to ``most`` common entities; of one table
    with itself ``once`` asks for l < r alone. Exact. Sets over few entities that many of them hold are multiplied tile by tile (``operators.incidence``), others
    are joined as classes of equal sets of both sides (``operators.set_join``); only the pairs asked for are written out."""
    left, right = (x.where(F.col("id").isNotNull() & F.col("entity").isNotNull()) for x in (left, right))
    if threshold > 0:
        each = lambda x: stored(x.select("id", F.col("entity").alias("token")).distinct(), "sets")
        a = each(left)
        b = None if once else each(right)
        if tokens := incidence.dense(a, b):
            return incidence.similar(a, b, tokens, threshold, most)
    both = left.select(F.struct(F.lit(0).alias("side"), F.col("id").alias("id")).alias("id"), F.col("entity").alias("token")).union(right.select(F.struct(F.lit(1).alias("side"), F.col("id").alias("id")), F.col("entity")))
    named, members = set_join.classes(both)
    pairs = stored(set_join.similar(named, threshold), "pairs")
    k = F.size("common")
    scored = pairs.select("a", "b", (k / (F.col("n_a") + F.col("n_b") - k)).alias("score"), F.slice("common", 1, most).alias("overlap"))
    own = named.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("score"), F.slice(F.sort_array(F.transform("set", lambda s: s["token"])), 1, most).alias("overlap"))
    ways = scored.union(scored.select(F.col("b"), F.col("a"), "score", "overlap")).union(own)
    side = lambda s, c, name: members.where(F.col("id.side") == s).select(F.col("class").alias(c), F.col("id.id").alias(name))
    return ways.join(side(0, "a", "l"), "a").join(side(1, "b", "r"), "b").select("l", "r", F.round("score", 6).alias("score"), "overlap").where("l < r" if once else "true")


#: Windows of one part of a time bucket, at about: a window meets so many at once.
PART_WINDOWS = 4096


def overlapping(windows: DataFrame, other: DataFrame, bucket: int) -> DataFrame:
    """Pairs of half-open windows [start, end) that overlap: of two such, one starts in the other, and the bucket of that start is the only one where they meet. Buckets are
    eighths of ``bucket``, so that no product is formed and nearly all that meet are pairs. Where many windows of ``other`` are in a bucket they are dealt over parts of it. The
    number of tasks is given, since few bytes make many pairs and Spark would put parts together; a merge goes through a part's windows in a row."""
    width = max(bucket // 8, 1)
    lo, hi = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)

    def dealt(w: DataFrame, p: str, odd: int) -> DataFrame:
        """A row a key: 2 x is where windows of other start in bucket x, 2 x + 1 where those of windows do; a window that is met there is at all its buckets."""
        keys = F.concat(F.transform(F.sequence(lo, hi), lambda x: 2 * x + odd), F.array(2 * lo + (1 - odd)))
        return w.where("start < end").select(F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(keys).alias("key"))

    a, b = dealt(windows, "a", 0), dealt(other, "b", 1)
    parts = b.groupBy("key").agg(F.ceil(F.count("*") / PART_WINDOWS).cast("int").alias("parts"))
    asked = a.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    listed = b.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("b_id", "b_start"), "parts").cast("int")).drop("parts")
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asked.repartition(tasks, "key", "part").join(listed.repartition(tasks, "key", "part").hint("merge"), ["key", "part"])
    first = (F.col("b_start") >= F.col("a_start")) == (F.col("key").bitwiseAND(1) == 0)
    return met.where("a_start < b_end and b_start < a_end").where(first).drop("key", "part")


def _may_supersede(o: DataFrame, n: DataFrame) -> DataFrame:
    """(old_id, new_id): pairs of old sets (old_id, om, old_mask) and new sets (new_id, nm, new_mask) that need a look at their members."""
    held = n.select("new_id", F.size("nm").alias("new_size"), "new_mask", F.explode("nm").alias("m"))
    often = stored(held.groupBy("m").agg(F.count("*").alias("df")), "often")
    rarest = o.select("old_id", F.size("om").alias("old_size"), "old_mask", F.explode("om").alias("m")).join(often, "m").groupBy("old_id", "old_size", "old_mask").agg(F.min(F.struct("df", "m")).alias("r"), F.count("*").alias("k"))
    few = stored(rarest.where("k = old_size").select("old_id", "old_size", "old_mask", F.col("r.m").alias("m")), "rarest")
    asked = held.join(few.groupBy("m").agg(F.min("old_size").alias("least")), "m").where(F.col("least") < F.col("new_size")).select("m", "new_id", "new_size", "new_mask")
    return few.join(asked, "m").where("old_size < new_size and (old_mask & ~new_mask) = 0").select("old_id", "new_id")


def superseded(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id): old sets that are proper subsets of a new one. ``old`` and ``new``: id, members (array).

    Pairs meet on the member of the old set that the fewest new sets hold, on the sizes, and on a mask that has a bit for each member's hash: of an old set all bits must be
    set in the new one's. A set with a member that no new set holds meets none. Only ids, sizes, masks and single members meet; the sets are fetched for the pairs that
    are left, to verify containment."""
    mask = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    o = stored(old.select(F.col("id").alias("old_id"), F.array_distinct("members").alias("om")).where(F.size("om") > 0).withColumn("old_mask", mask("om")), "old")
    n = stored(new.select(F.col("id").alias("new_id"), F.array_distinct("members").alias("nm")).withColumn("new_mask", mask("nm")), "new")
    met = _may_supersede(o, n)
    return met.join(o.drop("old_mask"), "old_id").join(n.drop("new_mask"), "new_id").where(F.size(F.array_except("om", "nm")) == 0).select("old_id", "new_id")


def cold_demotion(episodic: DataFrame, semantic: DataFrame) -> DataFrame:
    """Episodic memories whose window closed before or when some semantic memory was made: a comparison with one maximum."""
    latest = semantic.agg(F.max("created_at").alias("latest"))
    return episodic.join(F.broadcast(latest), F.col("window_end") <= F.col("latest"), "left_semi")


def all_of(tags: DataFrame, item: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """Items that have every wanted (dim, val)."""
    hit = _tagged(tags, wanted)
    return hit.select(item, "dim", "val").distinct().groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") == len(set(wanted))).select(item)


def any_of(tags: DataFrame, item: str, wanted: list[tuple[str, str]]) -> DataFrame:
    return _tagged(tags, wanted).select(item).distinct()


def _tagged(tags: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    return tags.where(F.array_contains(F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(v).alias("val")) for d, v in wanted]), F.struct("dim", "val")))


def neighbours(links: DataFrame, node) -> DataFrame:
    out = links.where(F.col("a") == node).select(F.col("b").alias("neighbour"), "weight")
    return out.union(links.where((F.col("b") == node) & (F.col("a") != node)).select(F.col("a").alias("neighbour"), "weight"))


def explicit_references(items: DataFrame, refs: DataFrame) -> DataFrame:
    """(item_id, ref_id): items whose text holds a reference's text, wherever in a word it starts or ends; blank references are held by none.

    All references are looked for in one pass over each text (``operators.patterns``)."""
    bodies = refs.where(F.trim("body") != "")
    found = occurrences(items.select(F.col("item_id").alias("id"), F.col("content").alias("text")), bodies.select(F.col("body").alias("pattern")))
    pairs = named(found, bodies.select(key_of(F.col("body")).alias("key"), F.col("ref_id").alias("name")))
    return pairs.select(F.col("id").alias("item_id"), F.col("name").alias("ref_id")).distinct()


def triage(keywords: Column, entities: Column, cosine: Column) -> Column:
    return F.greatest(keywords, entities, F.greatest(cosine, F.lit(0.0)))


def recency(days: Column, half_life: float = 14.0) -> Column:
    """0.5 ** (days / half life); a missing or negative age counts as new."""
    return F.when(days.isNull() | (days < 0), 1.0).otherwise(F.pow(F.lit(0.5), days / half_life))


def watch_matches(items: DataFrame, watches: DataFrame) -> DataFrame:
    """(watch_id, item_id, score): enabled watches against items, through inverted indexes of keywords and entities, and by vectors.

    items: item_id, tokens, source, age_days, interactions, and if there are any entities (array of strings) and vector. watches: watch_id,
    keywords, threshold, source_weights (map), enabled, and if there are any entities, anchor (vector) and source_ids (empty or null: all).
    Raw: the highest of the share of keywords found, the Jaccard index of the entities and the cosine; kept where it is over 0 and reaches
    the threshold, then weighted by recency, source and interactions. Watches with an anchor are compared in blocks of ``ANCHORS``."""
    live = watches.where("enabled")
    raw = _shares(items, live)
    if "entities" in items.columns and "entities" in watches.columns:
        raw = raw.unionByName(_entity_overlaps(items, live))
    for part in _anchored(items, live) if "vector" in items.columns and "anchor" in watches.columns else ():
        raw = raw.unionByName(part)
    best = raw.groupBy("watch_id", "item_id").agg(F.max("raw").alias("raw"))
    bound = [c for c in ("source_ids",) if c in watches.columns]
    joined = best.join(live.select("watch_id", "threshold", "source_weights", *bound), "watch_id").where(F.col("raw") >= F.col("threshold"))
    joined = joined.join(items.select("item_id", "source", "age_days", "interactions"), "item_id")
    if bound:
        joined = joined.where((F.coalesce(F.size("source_ids"), F.lit(0)) <= 0) | F.array_contains("source_ids", F.col("source")))
    weight = F.greatest(F.coalesce(F.try_element_at("source_weights", F.col("source")), F.lit(1.0)), F.lit(0.0))
    score = F.col("raw") * recency(F.col("age_days")) * weight * (1 + 0.1 * F.log1p(F.col("interactions").cast("double")))
    return joined.select("watch_id", "item_id", F.round(score, 6).alias("score"))


def _met(items: DataFrame, live: DataFrame, item_terms: Column, watch_terms: Column) -> DataFrame:
    """(watch_id, item_id, k): common terms. Only terms of some watch are shuffled."""
    probe = live.select("watch_id", F.explode(F.array_distinct(watch_terms)).alias("t"))
    index = thinned(items.select("item_id", F.explode(F.array_distinct(item_terms)).alias("t")), F.col("t"), probe, "t")
    return index.join(probe, "t").groupBy("watch_id", "item_id").agg(F.count("*").alias("k"))


def _shares(items: DataFrame, live: DataFrame) -> DataFrame:
    words = F.array_distinct(F.transform("keywords", F.lower))
    sizes = live.select("watch_id", F.size(words).alias("n"))
    return _met(items, live, F.col("tokens"), words).join(sizes, "watch_id").select("watch_id", "item_id", (F.col("k") / F.col("n")).alias("raw"))


def _entity_overlaps(items: DataFrame, live: DataFrame) -> DataFrame:
    size = lambda frame, key, name: frame.select(key, F.size(F.array_distinct("entities")).alias(name))
    met = _met(items, live, F.col("entities"), F.col("entities")).join(size(live, "watch_id", "a"), "watch_id").join(size(items, "item_id", "b"), "item_id")
    return met.select("watch_id", "item_id", (F.col("k") / (F.col("a") + F.col("b") - F.col("k"))).alias("raw"))


#: Anchors that are compared with the items in one pass.
ANCHORS = 256


def _anchored(items: DataFrame, live: DataFrame) -> Iterator[DataFrame]:
    """Cosine of each item's vector with the anchors, where it reaches the threshold: a block of anchors at a time stands in the plan."""
    rows = live.where("anchor is not null").select("watch_id", F.col("anchor").cast("array<double>").alias("anchor"), F.col("threshold").cast("double").alias("threshold"))
    block = []
    for row in chain(rows.orderBy("watch_id").toLocalIterator(), [None]):
        block += [] if row is None else [row]
        if block and (row is None or len(block) == ANCHORS):
            near = [F.struct(F.lit(r.watch_id).alias("watch_id"), cosine(F.col("vector"), F.lit(r.anchor)).alias("raw"), F.lit(r.threshold).alias("least")) for r in block]
            hits = F.filter(F.array(*near), lambda h: (h["raw"] > 0) & (h["raw"] >= h["least"]))
            yield items.where("vector is not null").select("item_id", F.explode(hits).alias("h")).select("h.watch_id", "item_id", "h.raw")
            block = []


def annotation_scores(scores: DataFrame, annotations: DataFrame, item: str) -> DataFrame:
    """Scores weighted by labels: a drop label makes 0, strong 1.5, medium 1.2, the highest wins."""
    factor = annotations.groupBy(item).agg(F.bool_or(F.col("label") == "drop").alias("drop"), F.max(F.when(F.col("label") == "strong", 1.5).when(F.col("label") == "medium", 1.2).otherwise(1.0)).alias("f"))
    out = scores.join(factor, item, "left")
    return out.withColumn("score", F.round(F.when(F.coalesce("drop", F.lit(False)), 0.0).otherwise(F.col("score") * F.coalesce("f", F.lit(1.0))), 6)).drop("drop", "f")
