"""Stored segments that are never changed: what the indexes share of adding, deleting, replacing and reading at once.

Below an index's folder ``items/seq=n`` holds the rows that step n added, further tables what the index makes of them, ``gone/seq=n`` the ids that step n took from
older segments, and ``manifest/version=n`` which of all that is alive. A step writes its tables first and its manifest last, so readers see all of it or nothing; a
second writer of the same version fails. Tables that no manifest names any more can be removed by age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many ids that were taken out are broadcast at most; with more, rows are dealt by id.
SMALL = 1 << 20
MANIFEST = "kind string, seq long, target long, docs long, terms long, note string"


class Segments:
    """Manifest and segments below ``folder``, a path that driver and executors share. ``items`` tables have item_id and length (0: counted nowhere)."""

    #: The table that a merge writes anew.
    main = "items"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.reload()

    @staticmethod
    def begin(spark: SparkSession, folder: str, setting: int, note: str) -> None:
        """The manifest of an empty index. ``setting`` and ``note`` are the index's own and hold for its life."""
        spark.createDataFrame([("meta", 0, setting, 0, 0, note)], MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest/version=0")

    def reload(self) -> None:
        """Reads the newest manifest, which has a row for each segment and for each segment that a step took ids from."""
        rows = self.spark.read.parquet(f"{self.folder}/manifest")
        self.version = rows.agg(F.max("version")).first()[0]
        now = rows.where(F.col("version") == self.version).collect()
        meta = next(r for r in now if r.kind == "meta")
        self.setting, self.note = meta.target, meta.note
        self.segments = {r.seq: (r.docs, r.terms) for r in now if r.kind == "segment"}
        self.gone = {(r.seq, r.target): (r.docs, r.terms) for r in now if r.kind == "gone"}
        self.next = max((r.seq for r in now), default=0) + 1

    def commit(self) -> None:
        rows = [("meta", self.next - 1, self.setting, 0, 0, self.note)]
        rows += [("segment", seq, seq, *n, "") for seq, n in self.segments.items()] + [("gone", seq, target, *n, "") for (seq, target), n in self.gone.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.folder}/manifest/version={self.version + 1}")
        self.reload()

    def stored(self, kind: str, numbers) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/seq={n}" for n in sorted(numbers)])

    def alive(self, rows: DataFrame, segments) -> DataFrame:
        """Those of ``rows`` (item_id, seq) that no later step took away."""
        steps = {seq for seq, target in self.gone if target in segments}
        if not steps:
            return rows
        last = self.stored("gone", steps).where(F.col("target").isin(*segments)).groupBy(F.col("item_id").alias("g")).agg(F.max("seq").alias("at"))
        taken = sum(docs for (_, target), (docs, _) in self.gone.items() if target in segments)
        last = F.broadcast(last) if taken <= SMALL else last.hint("shuffle_hash")
        return rows.join(last, (F.col("item_id") == F.col("g")) & (F.col("seq") < F.col("at")), "left_anti")

    def items(self) -> DataFrame | None:
        """All items that count, with the columns of their segments and seq; None for an empty index."""
        return self.alive(self.stored("items", self.segments), set(self.segments)).where("length > 0") if self.segments else None

    def take(self, ids: DataFrame, seq: int) -> None:
        """Writes which of ``ids`` are in the index and counts them by segment."""
        if not self.segments:
            return
        held = self.alive(self.stored("items", self.segments), set(self.segments))
        hit = held.select("item_id", "length", F.col("seq").alias("target")).join(ids.select("item_id").distinct(), "item_id", "left_semi")
        hit.write.parquet(f"{self.folder}/gone/seq={seq}")
        written = self.spark.read.parquet(f"{self.folder}/gone/seq={seq}")
        for r in written.groupBy("target").agg(F.count_if(F.col("length") > 0).alias("n"), F.sum("length").alias("terms")).collect():  # one row a segment
            self.gone[(seq, r.target)] = (r.n, r.terms)

    def write(self, rows: DataFrame, seq: int) -> tuple[int, int]:
        """Writes segment ``seq`` and returns its items that count and their lengths; an index adds its own tables."""
        rows.write.parquet(f"{self.folder}/items/seq={seq}")
        return self.spark.read.parquet(f"{self.folder}/items/seq={seq}").where("length > 0").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()

    def append(self, rows: DataFrame, ids: DataFrame) -> None:
        """A step that adds ``rows`` as a segment, in place of the items of ``ids``."""
        seq = self.next
        docs, terms = self.write(rows, seq)
        self.take(ids, seq)
        if docs:
            self.segments[seq] = (docs, terms)
        self.next = seq + 1
        self.commit()

    def delete(self, ids: DataFrame) -> None:
        """Takes the items of ``ids`` (item_id) out; unknown ids are ignored."""
        self.take(ids, self.next)
        self.next += 1
        self.commit()

    def merge(self, most: int = 8) -> None:
        """With more than ``most`` segments, makes one of the smallest, so that half as many are left; ids that were taken out of them go for good."""
        if len(self.segments) <= most:
            return
        small = set(sorted(self.segments, key=lambda s: (self.segments[s], s))[: len(self.segments) - most // 2 + 1])
        seq = self.next
        docs, terms = self.write(self.alive(self.stored(self.main, small), small).drop("seq"), seq)
        self.segments = {s: n for s, n in self.segments.items() if s not in small} | ({seq: (docs, terms)} if docs else {})
        self.gone = {k: n for k, n in self.gone.items() if k[1] not in small}
        self.next = seq + 1
        self.commit()

    def totals(self) -> tuple[int, int]:
        """Items that count, and the sum of their lengths, without what was taken out."""
        gone = [n for (_, target), n in self.gone.items() if target in self.segments]
        return sum(d for d, _ in self.segments.values()) - sum(d for d, _ in gone), sum(t for _, t in self.segments.values()) - sum(t for _, t in gone)
