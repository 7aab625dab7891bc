"""Equi-joins that hold up when one key has a large share of all rows, and bounded filters in front of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from one in HOT of all rows on, so there are HOT hot keys at most, which bounds what is broadcast.
HOT = 1000
#: Parts that a hot key is dealt over.
SALTS = 64
#: Leading hash bits of a thinning filter: 2**BITS integers bound what is broadcast, whatever the size of the tables.
BITS = 22


def meet(rows: DataFrame, keys: DataFrame, on: str, deal: Column, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``keys`` by the column ``on``. ``keys`` has one row per key and a column n, the key's number of rows in ``rows``, which
    is dropped; ``deal`` is a hash of a row, and the rows of a hot key are dealt by it. ``how``: inner, left or left_semi. ``keys`` is read
    three times, so cut it if it costs much."""
    total = (keys.agg(F.sum("n")).first()[0] or 0) if total is None else total
    hot = keys.where(F.col("n") * HOT > total).select(on, F.lit(True).alias("__hot"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(deal, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("__hot")
    parts = F.when(F.col("n") * HOT > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(keys.withColumn("__salt", F.explode(parts)).drop("n"), [on, "__salt"], how).drop("__salt")


def thinned(rows: DataFrame, on: Column, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` that may have a partner in ``keys``: a broadcast semi-join on the leading bits of the key's hash. It loses no partner and lets about
    one other row in 2**BITS / (number of keys) through, so beyond 2**BITS keys it thins nothing."""
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - BITS).cast("int")
    slots = keys.select(slot(F.col(key)).alias("__slot")).distinct()
    return rows.withColumn("__slot", slot(on)).join(F.broadcast(slots), "__slot", "left_semi").drop("__slot")
