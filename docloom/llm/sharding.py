"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters meet a tolerance,
then one exchange by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import cut, stored

#: Bins that one round counts, over all open boundaries: what reaches the driver at once, whatever the input.
BINS = 1 << 18
SIGN = 1 << 63
#: The parts of a key, most significant first, by names that tables don't use: text, then id and text, then place among rows alike.
PARTS = ("__high", "__low", "__tie")
#: Leading bits of a key by which rows look up the splitters near them.
LOOKUP = 14
#: Bytes of one range, and ranges of a shard at least and at most.
RANGE_BYTES, FEWEST, MOST = 1 << 29, 8, 4096

Splitter = tuple[int, int, int]
LAST: Splitter = (SIGN - 1, SIGN - 1, SIGN - 1)


def keys_of(id_col: str, text_col: str, tie: Column) -> dict[str, Column]:
    """Key parts as signed 64-bit numbers: equal texts are neighbours, the id orders them, and rows alike in both follow ``tie``."""
    return dict(zip(PARTS, (F.xxhash64(text_col), F.xxhash64(id_col, text_col), tie)))


def byte_size(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")


def find_splitters(rows: DataFrame, parts: int, slack: float, total: int) -> list[Splitter]:
    """The ``parts - 1`` boundaries that cut the rows' bytes evenly, each within ``slack`` bytes or at a single key, in order.

    Every round counts the exact bytes in candidate bins over all partitions: bins of the leading key bits first, then finer ones
    inside the bins that hold an unsettled boundary. A bin of one single value (a group of equal texts, or of rows alike) goes on with
    the next part of the key. At most BINS bins reach the driver in a round, or two for each open boundary.
    """
    # an open bin: values of the parts before, then its leading bits -> (bytes below it, numbers of the boundaries inside)
    open_bins: dict[tuple[tuple[int, ...], int, int], tuple[int, list[int]]] = {((), 0, 0): (0, list(range(1, parts)))}
    found: dict[int, Splitter] = {}
    while open_bins and total:
        following: dict[tuple[tuple[int, ...], int, int], tuple[int, list[int]]] = {}
        step = max(1, (BINS // len(open_bins)).bit_length() - 1)
        for depth, bits in sorted({(len(fixed), bits) for fixed, bits, _ in open_bins}):
            bins = {k: v for k, v in open_bins.items() if (len(k[0]), k[1]) == (depth, bits)}
            more = min(64, bits + step)
            value = F.col(PARTS[depth])
            chosen = rows
            if depth or bits:
                wanted = rows.sparkSession.createDataFrame([(*fixed, prefix) for fixed, _, prefix in bins], ", ".join(f"w{i} long" for i in range(depth + 1)))
                same = [F.col(PARTS[i]) == F.col(f"w{i}") for i in range(depth)] + ([F.shiftright(value, 64 - bits) == F.col(f"w{depth}")] if bits else [])
                chosen = rows.join(F.broadcast(wanted), same)
            before = [F.col(p) for p in PARTS[:depth]]
            counts = chosen.groupBy(*before, F.shiftright(value, 64 - more).alias("bin")).agg(F.sum("size").alias("size"), F.min(value).alias("lo"), F.max(value).alias("hi"))
            histogram: dict[tuple[tuple[int, ...], int], list] = {}
            for r in counts.collect():
                histogram.setdefault((tuple(r[:depth]), r.bin >> (more - bits) if bits else 0), []).append(r)
            for (fixed, _, prefix), (below, inside) in bins.items():
                at = 0
                for r in sorted(histogram.get((fixed, prefix), []), key=lambda r: r.bin):
                    while at < len(inside) and total * inside[at] / parts < below + r.size:
                        j = inside[at]
                        want = total * j / parts - below
                        start, end = r.bin << (64 - more), min((r.bin + 1) << (64 - more), SIGN - 1)
                        fill = (-SIGN,) * (2 - depth)
                        single = depth == 2 and more == 64
                        if want <= slack or single and want <= r.size / 2:
                            found[j] = (*fixed, start, *fill)
                        elif r.size - want <= slack or single:
                            found[j] = (*fixed, end, *fill)
                        else:
                            go = ((*fixed, r.lo), 0, 0) if r.lo == r.hi and depth < 2 else (fixed, more, r.bin)
                            following.setdefault(go, (below, []))[1].append(j)
                        at += 1
                    below += r.size
        open_bins = following
    return sorted(found.get(j, LAST) for j in range(1, parts))


def ranged(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """``rows`` plus __piece, the number of splitters at or below the row's key: a broadcast look-up by the key's leading bits (2**LOOKUP rows),
    then a comparison with the few splitters there."""
    near: dict[int, list[Splitter]] = {}
    for s in splitters:
        near.setdefault(s[0] >> (64 - LOOKUP), []).append(s)
    table, below = [], 0
    for b in range(-(1 << LOOKUP - 1), 1 << LOOKUP - 1):
        table.append((b, below, near.get(b, [])))
        below += len(near.get(b, []))
    kind = "struct<" + ",".join(f"`{p}`:bigint" for p in PARTS) + ">"
    looked = rows.sparkSession.createDataFrame(table, f"__bin long, __below int, __near array<{kind}>")
    joined = rows.withColumn("__bin", F.shiftright(PARTS[0], 64 - LOOKUP)).join(F.broadcast(looked), "__bin")
    own = F.struct(*PARTS)
    return joined.withColumn("__piece", F.col("__below") + F.size(F.filter("__near", lambda s: s <= own))).drop("__bin", "__below", "__near")


def shard(docs: DataFrame, shards: int = 24, pieces: int | None = None, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard, slot, grown_shard: shards of near-equal bytes over a hash order of the texts.

    Equal texts are neighbours in the order; a group that lies across a boundary is split there by id, and rows alike in id and text by
    their place in the input, which is stored for that if such rows exist. Each shard is cut into ``pieces`` ranges (by default as many as its bytes
    ask for) by splitters of its own; the ranges' exact row counts give the first slot of each, so that no task sorts a whole shard and
    the rows are exchanged once, by range. A null text has size 8 and crc32 0. Repeated rows get slots of their own. An empty
    table gives no rows. A text is never cut, so one larger than a shard makes its shard larger. Existing columns of the new names are replaced.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    tie = F.lit(0).cast("long")
    if not docs.groupBy(F.xxhash64(text_col).alias("high"), F.xxhash64(id_col, text_col).alias("low")).count().where("count > 1").isEmpty():
        docs = stored(docs.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())), "told-apart")
        tie = F.col("__tie")
    keys = keys_of(id_col, text_col, tie)
    rows = cut(docs.select(*[c.alias(p) for p, c in keys.items()], byte_size(text_col).alias("size")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    pieces = pieces or max(FEWEST, min(MOST, -(-total // (shards * RANGE_BYTES))))
    splitters = find_splitters(rows, shards * pieces, tolerance * total / shards, total)
    counts = {r["__piece"]: r["n"] for r in ranged(rows, splitters).groupBy("__piece").agg(F.count("*").alias("n")).collect()}
    firsts = []
    for p in range(shards * pieces):
        firsts.append((p, 0 if p % pieces == 0 else firsts[-1][1] + counts.get(p - 1, 0)))
    first = docs.sparkSession.createDataFrame(firsts, "__piece int, __first long")
    added = {
        "size": byte_size(text_col),
        "text_crc32": F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long"),
        "law": F.lit("bytes"),
        "shard": F.floor(F.col("__piece") / pieces).cast("int"),
    }
    # what is read from the text comes before the exchange, so that a caller who drops it doesn't move it
    placed = ranged(docs.withColumns(keys), splitters).join(F.broadcast(first), "__piece").withColumns(added)
    order = Window.partitionBy("__piece").orderBy(*PARTS)
    slot = F.col("__first") + F.row_number().over(order) - 1
    numbered = placed.repartitionById(shards * pieces, F.col("__piece")).withColumns({"slot": slot, "grown_shard": F.lit(None).cast("int")})
    return numbered.select(*[f"`{c}`" for c in docs.columns if c != "__tie"], *added, "slot", "grown_shard")
