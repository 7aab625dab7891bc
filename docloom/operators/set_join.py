"""Exact set-similarity joins: equal sets are one class, classes meet on rare tokens, and what passes length and position filters is verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.skew import meet
from docloom.sources.shared import stored

#: Rows of one token that a task compares with each other; a token with more is dealt as pairs of chunks.
CHUNK = 4096


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, set, n), (class, id)) of sets given as rows (id, token): equal sets share a class, named by its smallest id. A set is an array of structs (df, token),
    rare tokens first, where df counts the ids that hold the token. Rows with nulls and repeated rows don't count; a token of most sets is dealt over tasks."""
    each = stored(sets.where("id is not null and token is not null").select("id", "token").distinct(), "sets")
    df = stored(each.groupBy("token").agg(F.count("*").alias("n")).withColumn("df", F.col("n")), "df")
    arrays = meet(each, df, "token", F.xxhash64("id")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("set"))
    signed = stored(arrays.withColumn("sig", F.md5(F.to_json("set").cast("binary"))), "arrays")
    named = stored(signed.groupBy("sig").agg(F.min("id").alias("class"), F.first("set").alias("set"), F.count("*").alias("n")), "classes")
    members = meet(signed.select("sig", "id"), named.select("sig", "class", "n"), "sig", F.xxhash64("id")).select("class", "id")
    return named.select("class", "set", F.size("set").alias("n")), stored(members, "members")


def meetings(rows: DataFrame, keep: Column) -> DataFrame:
    """Distinct (a, b), a < b, of rows (token, class, ...) that share a token and that ``keep`` lets through; its columns end in _a and _b. A frequent token's rows are
    dealt to tasks as pairs of chunks, each of which compares CHUNK rows with CHUNK others at most."""
    rows = stored(rows, "prefixes")
    parts = stored(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int")), "parts")
    dealt = meet(rows, parts, "token", F.xxhash64("class")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = spread.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("other", "parts")
    keys = ["token", "low", "high"]
    side = lambda s: tiles.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in tiles.columns if c not in keys])
    once = (F.col("low") == F.col("high")) | (F.col("own_a") != F.col("own_b"))
    met = side("a").join(side("b"), keys).where((F.col("class_a") < F.col("class_b")) & once & keep)
    return met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def verified(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common): the pairs with their sets' sizes and common tokens, in order."""
    tokens = F.transform("set", lambda s: s["token"])
    side = lambda s: named.select(F.col("class").alias(s), tokens.alias(f"set_{s}"), F.col("n").alias(f"n_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", F.sort_array(F.array_intersect("set_a", "set_b")).alias("common"))


def similar(named: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n_a, n_b, common): pairs a < b of classes with a Jaccard index of ``threshold`` or more; exact.

    Such sets share one of their rarest tokens (prefix filter), differ little in size, and have enough tokens left behind the shared one (position filter)."""
    least = F.ceil(threshold * F.col("n") - 1e-9)
    prefix = F.slice("set", F.lit(1), (F.col("n") - least + 1).cast("int"))
    rows = named.select("class", "n", F.posexplode(prefix).alias("pos", "s")).select("class", "n", "pos", F.col("s.token").alias("token"))
    sizes = (F.col("n_b") >= threshold * F.col("n_a") - 1e-9) & (F.col("n_a") >= threshold * F.col("n_b") - 1e-9)
    left = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    pairs = meetings(rows, sizes & (left >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9))
    k = F.size("common")
    return verified(pairs, named).where(k / (F.col("n_a") + F.col("n_b") - k) >= threshold - 1e-12)


def overlapping(named: DataFrame, least: int) -> DataFrame:
    """(a, b, n_a, n_b, common): pairs a < b of classes with ``least`` common tokens or more; exact. Of a set's tokens the ``least`` - 1 most frequent need not meet."""
    prefix = F.slice("set", F.lit(1), F.greatest(F.col("n") - least + 1, F.lit(0)))
    rows = named.select("class", F.explode(prefix).alias("s")).select("class", F.col("s.token").alias("token"))
    return verified(meetings(rows, F.lit(True)), named).where(F.size("common") >= least)


#: Ids of one block while members are numbered.
BLOCK = 1 << 16


def next_members(asked: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """(class, a, id): for each asked (class, a) the ``most`` smallest members of the class above a, in time linear in both tables. Members are numbered from the
    top, by blocks of ids, so that a class that holds most ids is many tasks'."""
    rows = members.select("class", F.col("id").alias("at"), F.lit(1).alias("one")).union(asked.select("class", F.col("a").alias("at"), F.lit(0).alias("one")))
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    above = Window.partitionBy("class").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("class", "block").agg(F.sum("one").alias("k")).withColumn("over", F.coalesce(F.sum("k").over(above), F.lit(0))).drop("k")
    inside = Window.partitionBy("class", "block").orderBy(F.desc("at"), "one").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(rows.withColumn("up", F.sum("one").over(inside)).join(offsets, ["class", "block"]).select("class", "at", "one", (F.col("up") + F.col("over")).alias("rank")), "placed")
    wanted = placed.where("one = 0 and rank > 0").select("class", F.col("at").alias("a"), F.explode(F.sequence(F.greatest(F.col("rank") - most + 1, F.lit(1)), F.col("rank"))).alias("rank"))
    return wanted.join(placed.where("one = 1").select("class", "rank", F.col("at").alias("id")), ["class", "rank"]).select("class", "a", "id")
