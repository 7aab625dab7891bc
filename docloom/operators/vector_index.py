"""A stored vector index: trained cells, product codes of what is left, probed cells by query, and exact scores for the best candidates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.vector import cosine, norm
from docloom.operators.segments import Segments

#: Bytes of vectors that are trained on, at most, and rounds of training.
SAMPLE_BYTES, ROUNDS = 1 << 25, 8
#: Cells: about the square root of the number of vectors, within these bounds.
CELLS = (8, 4096)
#: Components of one product code, and codes of one kind.
WIDTH, CODES = 4, 256
#: Vectors of a tile and queries of a pack; a meeting of both is one matrix product. Tiles of a cell that share a task at about.
TILE, PACK, TILES = 4096, 256, 8
#: Candidates of a query that get an exact score, for each hit wanted, and how many of all queries a task holds before it reduces them.
SPARE, HELD = 20, 1 << 20
#: Queries whose true neighbours are looked up when the number of probed cells is chosen.
CALIBRATION = 64


def lloyd(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of the points; the first k start, which are in hash order, and an empty centre stays where it is."""
    centres = points[:k].copy()
    for _ in range(rounds):
        own = assign(points, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def assign(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point and the squared distances to all, in blocks."""
    half = (centres**2).sum(axis=1)
    far = np.concatenate([half - 2 * points[i : i + 4096] @ centres.T for i in range(0, len(points), 4096)] or [np.empty((0, len(centres)), np.float32)])
    return far.argmin(axis=1) if len(far) else np.empty(0, np.int64), far


class Model:
    """Cells and product codes, trained on unit vectors."""

    def __init__(self, size: int, cells: np.ndarray, books: np.ndarray) -> None:
        self.size, self.cells, self.books = size, cells, books

    @classmethod
    def train(cls, sample: np.ndarray, n: int) -> Model:
        units = cls.padded(sample, sample.shape[1])
        k = int(min(max(np.sqrt(n), CELLS[0]), CELLS[1], max(len(units) // 4, 1)))
        cells = lloyd(units, k)
        rest = (units - cells[assign(units, cells)[0]])[: 64 * CODES]
        books = [lloyd(np.ascontiguousarray(rest[:, i : i + WIDTH]), min(CODES, len(rest))) for i in range(0, units.shape[1], WIDTH)]
        return cls(sample.shape[1], cells, np.stack(books))

    @staticmethod
    def padded(vectors: np.ndarray, size: int) -> np.ndarray:
        """Unit vectors, with zeros up to whole codes."""
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.pad(units, ((0, 0), (0, -size % WIDTH))).astype(np.float32)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, _ = assign(units, self.cells)
        rest = units - self.cells[own]
        codes = [assign(np.ascontiguousarray(rest[:, WIDTH * i : WIDTH * (i + 1)]), book)[0] for i, book in enumerate(self.books)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.cells[cell] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def nearest_cells(self, units: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(assign(units, self.cells)[1], axis=1, kind="stable")[:, :probes]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [("size", 0, [float(self.size)])] + [("cell", i, c.tolist()) for i, c in enumerate(self.cells)] + [("book", i, b.ravel().tolist()) for i, b in enumerate(self.books)]
        return spark.createDataFrame(rows, "kind string, i int, v array<double>")

    @classmethod
    def read(cls, frame: DataFrame) -> Model:
        """From a stored table, whose size is that of the bounded model."""
        parts: dict[str, list] = {"size": [], "cell": [], "book": []}
        for r in frame.orderBy("kind", "i").collect():
            parts[r.kind].append(np.array(r.v, dtype=np.float32))
        return cls(int(parts["size"][0][0]), np.stack(parts["cell"]), np.stack(parts["book"]).reshape(len(parts["book"]), -1, WIDTH))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


class VectorIndex(Segments):
    """An index of item vectors (item_id long, embedding) below ``folder``, by cosine; also in it: the trained ``model`` and ``codes/seq=n``, a segment's tiles by cell.

    Every vector of the index's size with a norm above 1e-8 is indexed; null, zero and other-sized vectors, and null ids, are left out. Recall depends on the
    vectors: the number of probed cells is chosen so that ``target`` of the true neighbours of a few vectors lie in them, and ``search`` takes another one."""

    @classmethod
    def create(cls, spark: SparkSession, folder: str, vectors: DataFrame, target: float = 0.97) -> VectorIndex:
        """An index of ``vectors``. Cells and codes are trained on a bounded sample in hash order, the index holds all."""
        usable = cls.usable(vectors)
        size = usable.select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        if size is None:
            raise ValueError("no vectors to train on")
        usable = usable.where(F.size("embedding") == size.n)
        rows = usable.orderBy(F.xxhash64("embedding"), "item_id").limit(max(SAMPLE_BYTES // (4 * size.n), 64)).select("embedding").toPandas()
        model = Model.train(np.stack(rows.embedding.to_numpy()).astype(np.float32), usable.count())
        model.frame(spark).coalesce(1).write.parquet(f"{folder}/model")
        cls.begin(spark, folder, len(model.cells), json.dumps({"probes": len(model.cells)}))
        index = cls(spark, folder)
        index.add(vectors)
        index.calibrate(target)
        return index

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, folder)
        self.model = Model.read(spark.read.parquet(f"{folder}/model"))

    @staticmethod
    def usable(vectors: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<float>")
        rows = vectors.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), v.alias("embedding"))
        return rows.where((norm(F.col("embedding").cast("array<double>")) > 1e-8) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors; an item that is there already is replaced. Of rows that repeat an id the smallest vector stays."""
        model = self.model

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, codes = model.encode(model.padded(matrix(batch.column(1), batch.num_rows), model.size))
                    code = pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), code, pa.array(np.ones(len(cell)), pa.int32())], names=["item_id", "embedding", "cell", "code", "length"])

        once = self.usable(vectors).where(F.size("embedding") == model.size).groupBy("item_id").agg(F.min("embedding").alias("embedding"))
        self.append(once.mapInArrow(place, "item_id long, embedding array<float>, cell int, code binary, length int"), once)

    def write(self, rows: DataFrame, seq: int) -> tuple[int, int]:
        """Tiles are ranged by cell and item, so that a large cell is split over tasks."""
        totals = super().write(rows, seq)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(0).to_numpy()
                edges = np.unique(np.concatenate([np.flatnonzero(np.diff(cell, prepend=-1)), np.arange(0, len(cell), TILE), [len(cell)]]))
                out = [(int(cell[a]), batch.column(1)[a:b].to_pylist(), b"".join(batch.column(2)[a:b].to_pylist())) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), (pa.int32(), pa.list_(pa.int64()), pa.binary()))], names=["cell", "ids", "codes"])

        stored = self.spark.read.parquet(f"{self.folder}/items/seq={seq}").select("cell", "item_id", "code")
        ordered = stored.repartitionByRange("cell", F.xxhash64("item_id")).sortWithinPartitions("cell", "item_id")
        tiles = ordered.mapInArrow(pack, "cell int, ids array<long>, codes binary").withColumn("tile", F.monotonically_increasing_id())
        tiles.write.parquet(f"{self.folder}/codes/seq={seq}")
        return totals

    @property
    def probes(self) -> int:
        return json.loads(self.note)["probes"]

    def calibrate(self, target: float, top: int = 10) -> None:
        """Sets how many cells are probed: for CALIBRATION indexed vectors the exact neighbours are looked up in one pass, with the place of their
        cells in the query's order; as many are probed as hold ``target`` of them all."""
        held = self.items()
        if held is None:
            return
        few = held.orderBy(F.xxhash64("item_id", "embedding")).limit(CALIBRATION).select("item_id", "embedding").collect()
        queries = self.model.padded(np.array([r.embedding for r in few], dtype=np.float32), self.model.size)
        own = np.array([r.item_id for r in few])
        model, place = self.model, np.argsort(self.model.nearest_cells(queries, len(self.model.cells)), axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column(0).to_numpy()
                    scores = queries @ model.padded(matrix(batch.column(1), batch.num_rows), model.size).T
                    scores[own[:, None] == ids[None, :]] = -2
                    best = np.argsort(-scores, axis=1)[:, :top]
                    q = np.repeat(np.arange(len(own)), best.shape[1])
                    cells = batch.column(2).to_numpy()[best.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores[q, best.ravel()].astype(np.float64)), pa.array(place[q, cells])], names=["q", "score", "place"])

        found = held.select("item_id", "embedding", "cell").mapInArrow(run, "q long, score double, place long")
        best = Window.partitionBy("q").orderBy(F.desc("score"), "place")
        true = found.withColumn("r", F.row_number().over(best)).where((F.col("r") <= top) & (F.col("score") > -2))
        at = true.agg(F.percentile("place", F.lit(target))).first()[0]
        self.note = json.dumps({"probes": min(int(np.ceil(at or 0)) + 1, len(self.model.cells))})
        self.commit()

    def probed_share(self, probes: int | None = None) -> float:
        """Share of the index's rows that an average query looks at, over the calibration's vectors."""
        sizes = {r.cell: r.n for r in self.items().groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        few = self.items().orderBy(F.xxhash64("item_id", "embedding")).limit(CALIBRATION).select("embedding").collect()
        near = self.model.nearest_cells(self.model.padded(np.array([r.embedding for r in few], dtype=np.float32), self.model.size), probes or self.probes)
        return sum(sizes.get(int(c), 0) for c in near.ravel()) / len(near) / max(sum(sizes.values()), 1)

    def search(self, queries: DataFrame, top: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, item_id, score, rank): the ``top`` items of each query (query_id, embedding) by cosine, rounded to 6 digits, ties by id; a query's own id isn't
        left out. Queries go to their nearest cells in packs and meet the cells' tiles there; the best candidates by codes get exact scores."""
        model, probes, spare = self.model, min(probes or self.probes, len(self.model.cells)), SPARE * top

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = model.nearest_cells(model.padded(matrix(batch.column(1), batch.num_rows), model.size), probes)
                    rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(near.ravel(), pa.int32())], names=["query_id", "embedding", "cell"])

        def best_of(found: list[np.ndarray]) -> list[np.ndarray]:
            """The first ``spare`` of each query; equal scores by the smallest ids."""
            q, ids, seq, scores = found
            order = np.lexsort((ids, -scores, q))
            q = q[order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < spare]
            return [x[order] for x in found]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            packed = lambda found: pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "item_id", "seq", "near"])
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, asked = (np.asarray(batch.column(c)[k].values) for c in ("ids", "asked"))
                    vectors = model.decode(batch.column("cell")[k].as_py(), np.frombuffer(batch.column("codes")[k].as_py(), dtype=np.uint8).reshape(len(ids), -1))
                    units = model.padded(np.asarray(batch.column("units")[k].values).reshape(len(asked), -1), model.size)
                    scores = np.round((units @ vectors.T).astype(np.float64), 5)
                    least = np.partition(scores, -min(spare, len(ids)), axis=1)[:, -min(spare, len(ids))]
                    q, i = np.nonzero(scores >= least[:, None])
                    for part, more in zip(parts, (asked[q], ids[i], np.full(len(q), batch.column("seq")[k].as_py(), dtype=np.int64), scores[q, i])):
                        part.append(more)
                    held += len(q)
                    if held > HELD:
                        found = best_of([np.concatenate(p) for p in parts])
                        if len(found[0]) > HELD // 2:  # so many queries that little was saved
                            yield packed(found)
                            found = [x[:0] for x in found]
                        parts, held = [[x] for x in found], len(found[0])
            if held:
                yield packed(best_of([np.concatenate(p) for p in parts]))

        asked = self.usable(queries.select(F.col("query_id").alias("item_id"), "embedding")).where(F.size("embedding") == model.size).withColumnRenamed("item_id", "query_id").distinct()
        empty = asked.select("query_id", F.col("query_id").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        if not self.segments:
            return empty
        tiles = self.stored("codes", self.segments)
        # a cell's tiles are dealt over slots, so that no task gets a whole cell however large; one row a cell is broadcast
        slots = F.broadcast(tiles.groupBy("cell").agg(F.ceil(F.count("*") / TILES).cast("int").alias("slots")))
        dealt = tiles.join(slots, "cell").withColumn("slot", F.pmod(F.xxhash64("tile", "seq"), F.col("slots")).cast("int")).drop("slots")
        sent = asked.mapInArrow(choose, "query_id long, embedding array<float>, cell int")
        n = F.broadcast(sent.groupBy("cell").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs")))
        packs = sent.join(n, "cell").groupBy("cell", F.pmod(F.xxhash64("query_id"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("v"))
        packs = packs.select("cell", F.transform("v", lambda s: s["query_id"]).alias("asked"), F.flatten(F.transform("v", lambda s: s["embedding"])).alias("units"))
        spread = packs.join(slots, "cell").select("cell", "asked", "units", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        near = dealt.join(spread, ["cell", "slot"]).select("cell", "ids", "codes", "asked", "units", "seq").mapInArrow(meet, "query_id long, item_id long, seq long, near double")
        near = self.alive(near, set(self.segments))
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "item_id")
        chosen = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= spare).select("query_id", "item_id")
        whole = self.items().select("item_id", F.col("embedding").cast("array<double>").alias("v"))
        scored = chosen.join(whole, "item_id").join(asked.withColumn("q", F.col("embedding").cast("array<double>")), "query_id")
        exact = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        out = scored.select("query_id", "item_id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))
        return out.withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= top)
