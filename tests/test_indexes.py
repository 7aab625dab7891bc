"""Analyzer and stored text index against plain versions."""

import math
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import analyzer
from docloom.operators import retrieval, segments, text_index
from docloom.operators.text_index import TextIndex
from docloom.operators.vector_index import VectorIndex
from docloom.sources.tables import items

SF = "/root/testdata/sf0.001"
# known stems of the English algorithm
STEMS = """consigned consign|consistency consist|consolations consol|consolatory consolatori|conspicuously conspicu|conspiracy conspiraci|constables constabl|kneeling kneel|knackeries knackeri|knightly knight|knitted knit
running run|hopping hop|hoping hope|generously generous|generate generat|communication communic|happiness happi|relational relat|rational ration|adoption adopt|controlled control|flies fli|dies die|ties tie|gas gas|this this
kiwis kiwi|gaps gap|abilities abil|say say|by by|used use|succeeding succeed|skis ski|luxuriated luxuri|disabled disabl|feed feed|agreed agre|sized size|falling fall|filing file|owed owe|apologies apolog|hopelessly hopeless
boyish boyish|enjoy enjoy|trying tri|youth youth|naïve naïv|news news|inning inning|cries cri|bled bled|contracts contract|2024 2024""".replace("\n", "|")


def test_stems():
    assert [(w, analyzer.stem(w)) for w, s in map(str.split, STEMS.split("|")) if analyzer.stem(w) != s] == []


def test_terms_of_mixed_scripts(spark):
    index, query = analyzer.english_han(), analyzer.english_han(query=True)
    assert index("签合同 Contracts2 年") == ["签", "合", "同", "签合", "合同", "contracts2", "年"]
    assert query("合同 contracts 年") == ["合同", "contract", "年"] and analyzer.query_terms("run running") == ["run"]
    assert index("第2024号文件x") == ["第", "2024", "号", "文", "件", "号文", "文件", "x"]
    rows = spark.createDataFrame([("Running",), (None,), ("",)], "t string").select(analyzer.analyzed("t").alias("w")).collect()
    assert [r.w for r in rows] == [["run"], None, []]


def bm25(docs, terms, top):
    """Plain scores: docs is id -> terms."""
    counts = {i: Counter(w) for i, w in docs.items() if w}
    mean = sum(sum(c.values()) for c in counts.values()) / max(len(counts), 1)
    df = Counter(t for c in counts.values() for t in c)
    scores = {}
    for i, c in counts.items():
        if any(t in c for t in terms):
            n = sum(c.values())
            scores[i] = sum(math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in terms)
    best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:top]
    return [(i, pytest.approx(s, abs=2e-6)) for i, s in best]


def hits(frame):
    return [(r.item_id, r.score) for r in frame.orderBy("rank").collect()]


def test_analyzed_query_matches_plain_scores(spark):
    from docloom.plans import catalog, indexes

    terms = analyzer.english_han()
    docs = {r.item_id: terms(r.content or "") for r in items(spark, SF).collect()}
    assert hits(catalog.QUERIES["bm25_analyzed"](spark, SF)) == bm25(docs, analyzer.query_terms(indexes.QUESTION), 10)


CORPUS = {
    1: "Rust ownership and borrowing rules guarantee memory safety; the borrow checker enforces references never outlive the owned value.",
    2: "The Python global interpreter lock serializes bytecode, so one thread runs at a time and limits parallelism.",
    3: "A search engine library ranks documents with a scoring function over an inverted index and tokenizes text.",
    4: "Graph indexes find approximate nearest neighbours by cosine similarity over dense vectors.",
    5: "我们签订合同之后付款，合同一式两份。",
    6: "付款之后发货。",
    7: None,
    8: "",
}


def test_two_characters_find_a_longer_run(spark):
    frame = spark.createDataFrame(list(CORPUS.items()), "item_id long, content string")
    index = TextIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}")
    index.add(frame)
    for question, found in (("合同", [5]), ("付款", [6, 5]), ("款", [6, 5]), ("borrowed reference", [1]), ("ranking document searches", [3]), ("parallel threads", [2]), ("vector neighbour", [4]), ("!", [])):
        assert [i for i, _ in hits(index.search(question))] == found, question
        assert [i for i, _ in hits(retrieval.bm25(frame, analyzer.query_terms(question), 10, analyzer.analyzed))] == found, question


def test_segments_equal_a_scan(spark):
    """Random steps; after each the index answers as a scan of what should be in it, from postings alone."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["common"] * 20
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30])))
    index = TextIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", "plain", buckets=4)
    held = {}
    for step in ("add", "add", "delete", "add", "merge", "delete", "add"):
        if step == "add":
            rows = [(rng.randrange(60), make()) for _ in range(25)]
            rows = list(dict(rows).items())
            index.add(spark.createDataFrame([*rows, (None, "w1 w2")], "item_id long, content string").repartition(3))
            held |= {i: t.split() for i, t in rows}
        elif step == "delete":
            ids = [rng.randrange(70) for _ in range(15)]
            index.delete(spark.createDataFrame([(i,) for i in ids + ids], "item_id long"))
            held = {i: t for i, t in held.items() if i not in ids}
        else:
            index.merge(2)
            assert len(index.segments) == 1
        full = [t for t in held.values() if t]
        assert index.totals() == (len(full), sum(map(len, full)))
        terms = rng.sample(words[:40], 3) + ["common", "nowhere"]
        assert hits(TextIndex(spark, index.folder).search(terms, 12)) == bm25(held, terms, 12), step
    assert {r.item_id for r in index.items().select("item_id").collect()} == {i for i, t in held.items() if t}


def test_repeated_ids_and_empty_steps(spark):
    index = TextIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", "plain")
    assert index.search("a").collect() == [] and index.items() is None
    index.delete(spark.createDataFrame([(1,)], "item_id long"))
    index.add(spark.createDataFrame([(1, "a b c"), (1, "a"), (2, "b")], "item_id long, content string"))
    assert hits(index.search("a")) == bm25({1: ["a"], 2: ["b"]}, ["a"], 10)
    index.add(spark.createDataFrame([], "item_id long, content string"))
    assert index.totals() == (2, 2) and len(index.segments) == 1
    with pytest.raises(ValueError):
        TextIndex.create(spark, "/tmp/x", "unknown")


def test_a_frequent_term_is_split(spark, monkeypatch):
    """One term in all items fills several files of a segment."""
    monkeypatch.setattr(text_index, "PART_ITEMS", 500)
    index = TextIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", "plain", buckets=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    index.add(spark.range(4000).select(F.col("id").alias("item_id"), F.lit("everywhere").alias("content")).repartition(4))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.parquet(f"{index.folder}/postings/seq=1").groupBy(F.input_file_name()).count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 3000


def test_a_segment_is_one_table_sorted_by_term(spark):
    """A file of postings a task, not one for each folder of terms and task; a search skips rows by the term."""
    index = TextIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", "plain", buckets=4)
    index.add(spark.range(400).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit("one"), F.concat(F.lit("w"), "id"), F.lit("one")).alias("content")).repartition(4))
    files = spark.read.parquet(f"{index.folder}/postings/seq=1").select("term", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    by_file = {}
    for r in files:
        by_file.setdefault(r.f, []).append(r.term)
    assert len(by_file) <= 4 and len(files) == 800 and all(t == sorted(t) for t in by_file.values())
    held = {i: ["one", f"w{i}", "one"] for i in range(400)}
    assert hits(index.search(["one", "w7"], 12)) == bm25(held, ["one", "w7"], 12)


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_ids_that_were_taken_out_are_met_without_a_sort(spark, monkeypatch, small):
    """Few are broadcast, whatever Spark's threshold; rows are dealt by id for many, but not sorted."""
    monkeypatch.setattr(segments, "SMALL", small)
    index = TextIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", "plain", buckets=4)
    index.add(spark.range(300).select(F.col("id").alias("item_id"), F.concat(F.lit("a w"), F.col("id") % 7).alias("content")))
    index.delete(spark.range(0, 300, 3).select(F.col("id").alias("item_id")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.alive(index.stored("postings", {1}), {1})._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and ("BroadcastHashJoin" in plan) == (small > 0)
        index.merge(0)
        held = {i: ["a", f"w{i % 7}"] for i in range(300) if i % 3}
        assert index.totals() == (200, 400) and hits(index.search(["a", "w2"], 9)) == bm25(held, ["a", "w2"], 9)
        assert spark.read.parquet(f"{index.folder}/postings/seq={max(index.segments)}").count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def brute(ids, units, query, top=10):
    scores = np.round(units @ query, 6)
    return [int(i) for i in ids[np.lexsort((ids, -scores))[:top]]]


def recall(index, rows, asked, spark, **options):
    ids = np.array([i for i, _ in rows])
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = {}
    frame = spark.createDataFrame([(int(i), v) for i, v in rows if i in asked], "query_id long, embedding array<double>")
    for r in index.search(frame, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.score))
    hit = 0
    for q in asked:
        query = units[list(ids).index(q)]
        true = brute(ids, units, query)
        hit += len({i for i, _ in got[q]} & set(true))
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(units[list(ids).index(i)] @ query)) < 2e-6 for i, s in got[q])
    return hit / (10 * len(asked))


def blobs(n, rng, size=30):
    centres = rng.normal(size=(12, size))
    return [(i, (centres[i % 12] + 0.4 * rng.normal(size=size)).tolist()) for i in range(n)]


def test_vector_index_finds_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = blobs(3000, rng)
    shape = "item_id long, embedding array<double>"
    odd = [(None, rows[0][1]), (9001, None), (9002, [0.0] * 30), (9003, [1.0, 2.0]), (9004, [float("nan")] * 30)]
    index = VectorIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", spark.createDataFrame(rows + odd, shape).repartition(5))
    assert index.totals()[0] == 3000 and len(index.model.cells) == 54
    asked = set(range(0, 3000, 50))
    assert recall(index, rows, asked, spark) >= 0.95 and index.probed_share() < 0.5
    assert recall(index, rows, asked, spark, probes=54) >= 0.99
    # appended, replaced and deleted vectors, and many copies of one
    more = [(3000 + i, v) for i, (_, v) in enumerate(blobs(600, rng))] + [(50, rows[51][1])] + [(5000 + i, rows[100][1]) for i in range(500)]
    index.add(spark.createDataFrame(more, shape))
    gone = set(range(1, 3000, 10))
    index.delete(spark.createDataFrame([(i,) for i in gone], "item_id long"))
    held = dict(rows) | dict(more)
    held = [(i, v) for i, v in held.items() if i not in gone]
    again = VectorIndex(spark, index.folder)
    assert again.totals()[0] == len(held) and recall(again, held, asked, spark) >= 0.9
    again.merge(1)
    assert len(again.segments) == 1 and recall(again, held, asked, spark) >= 0.9
    copies = again.search(spark.createDataFrame([(1, rows[100][1])], "query_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.item_id for r in copies] == [100, *range(5000, 5009)]


def test_registered_vector_query_has_recall(spark):
    from docloom.plans import catalog
    from docloom.sources.tables import vectors

    v = vectors(spark, "/root/testdata/sf0.01").collect()
    ids, units = np.array([r.item_id for r in v]), np.array([r.embedding for r in v])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = {}
    for r in catalog.QUERIES["vector_index_knn"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.item_id)
    asked = [i for i in ids if i % 50 == 0]
    assert set(got) == set(asked) and all(len(x) == 10 for x in got.values())
    assert sum(len(got[q] & set(brute(ids, units, units[list(ids).index(q)]))) for q in asked) >= 0.9 * 10 * len(asked)


def test_vector_index_edges(spark):
    none = spark.createDataFrame([], "item_id long, embedding array<double>")
    with pytest.raises(ValueError):
        VectorIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", none)
    one = spark.createDataFrame([(1, [1.0, 0.0, 2.0])], "item_id long, embedding array<double>")
    index = VectorIndex.create(spark, f"/tmp/spark-index-{uuid.uuid4().hex}", one)
    assert [tuple(r) for r in index.search(one.withColumnRenamed("item_id", "query_id")).collect()] == [(1, 1, 1.0, 1)]
    assert index.search(none.withColumnRenamed("item_id", "query_id")).collect() == []
    index.delete(one)
    assert index.search(one.withColumnRenamed("item_id", "query_id")).collect() == []
