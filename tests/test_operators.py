import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import governance, graph, ingest, joins, layout, queues, retrieval
from docloom.plans import hooks


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(1000, k) for k in range(1001, 1200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {(n, find(n)) for e in edges if e[0] != e[1] for n in e}
    got = {(r.node, r.component) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want and graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_are_exact(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    vectors = [(i, [x + rng.gauss(0, 0.15) for x in base[i % 12]]) for i in range(150)] + [(900, [0.0] * 8)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(i, j) for i, u in vectors[:-1] for j, v in vectors[:-1] if i < j and cos(u, v) >= 0.9}
    frame = spark.createDataFrame(vectors, "item_id long, embedding array<double>")
    assert {(r.a, r.b) for r in graph.similar_pairs(frame, 0.9, 10).collect()} == want
    clusters = {}
    for r in graph.density_clusters(frame, 0.9, 4).collect():
        clusters.setdefault(r.cluster, set()).add(r.item_id)
    assert 900 in clusters[-1] and all(len({i % 12 for i in c}) == 1 for k, c in clusters.items() if k != -1)


def test_dedup_groups_by_vectors(spark):
    items = spark.createDataFrame([(1, "h1", "t1"), (2, "h1", "t2"), (3, "h3", "t2"), (4, "h4", "t4"), (5, "h5", ""), (6, "h6", None), (7, "h7", "t7")], "item_id long, h string, t string")
    vectors = [(1, [1.0, 0.0]), (4, [0.95, 0.1]), (5, [0.0, 1.0]), (6, [0.1, 0.9]), (7, [1.0, -1.0]), (99, [1.0, -1.0])]
    frame = spark.createDataFrame(vectors, "item_id long, embedding array<double>")
    groups = lambda *v: {(r.item_id, r.group_id) for r in graph.dedup_groups(items, "h", "t", *v).collect()}
    assert groups() == {(1, 1), (2, 1), (3, 1)}
    assert groups(frame) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)}


def test_retrieval_pieces(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, ""), (4, None)], "item_id long, content string")
    assert [r.item_id for r in retrieval.bm25(items, ["alpha", "BETA"], 5).collect()] == [1, 2] and retrieval.bm25(items, [], 5).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "item_id long, embedding array<double>")
    assert [(r.item_id, r.score) for r in retrieval.nearest(v, [1.0, 0.0], 3).collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]
    even = retrieval.budget_split(spark.createDataFrame([(1, 0.0), (2, 0.0)], "item_id long, score double")).collect()
    assert {r.alloc for r in even} == {1000}
    turns = spark.createDataFrame([(1, t, 10) for t in range(5)], "c long, t long, n long")
    assert sorted(r.t for r in retrieval.pack_history(turns, "c", "t", F.col("n"), 40).collect()) == [3, 4]


def test_queues(spark):
    jobs = spark.createDataFrame([(i, i % 3, 86_400_000 * (i % 4) + i) for i in range(50)], "id long, priority int, created long")
    order = sorted(((-p, c, i) for i, p, c in ((r.id, r.priority, r.created) for r in jobs.collect())))
    assert {(r.id, r.position) for r in queues.queue_positions(jobs).collect()} == {(i, k) for k, (_, _, i) in enumerate(order)}
    wait = spark.range(1).select(queues.backoff(F.lit(1000), F.lit(3)).alias("a"), queues.backoff(F.lit(1000), F.lit(90)).alias("b")).first()
    assert (wait.a, wait.b) == (4000, 3_600_000)
    base = spark.createDataFrame([(1, "old", True), (2, "old", False)], "k long, v string, digested boolean")
    new = spark.createDataFrame([(2, "new", True, 1), (3, "new", False, 1), (3, "newer", True, 2)], "k long, v string, digested boolean, at long")
    assert sorted(tuple(r) for r in queues.upsert(base, new, ["k"], "at", ["digested"]).collect()) == [(1, "old", True), (2, "new", False), (3, "newer", True)]


def test_claims_are_exclusive_until_the_lease_runs_out(spark):
    shape = "id long, priority int, created long, state string, next_attempt long, deadline long, worker string, claimed_at long"
    jobs = spark.createDataFrame([(i, i % 2, 100 - i, "done" if i == 9 else "queued", 500 if i == 8 else None, None, None, None) for i in range(10)], shape)
    seen = []
    for k, now in enumerate((100, 110, 120)):
        mine = queues.claimed(jobs, now, 3, 50, f"w{k}")
        seen += [(r.id, r.deadline, r.worker, r.state) for r in mine.orderBy(F.desc("priority"), "created").collect()]
        jobs = spark.createDataFrame(queues.upsert(jobs, mine, ["id"], "claimed_at").select(jobs.columns).collect(), shape)
    assert [i for i, *_ in seen] == [7, 5, 3, 1, 6, 4, 2, 0] and {s for *_, s in seen} == {"running"} and seen[0][1:3] == (150, "w0")
    later = queues.swept(jobs, 155, at_least_once=True)
    assert sorted(r.id for r in queues.claimed(later, 155, 9, 50, "w3").collect()) == [3, 5, 7]  # job 8 waits for its next attempt, the others' leases hold


def test_joins(spark):
    w = lambda rows: spark.createDataFrame(rows, "id long, start long, end long")
    a, b = [(1, 0, 10), (2, 5, 300), (3, 20, 20)], [(7, 9, 12), (8, 250, 260), (9, 10, 11)]
    want = {(i, j) for i, s, e in a for j, t, f in b if s < f and t < e and s < e and t < f}
    assert {(r.a_id, r.b_id) for r in joins.overlapping(w(a), w(b), 50).collect()} == want
    sets = lambda rows: spark.createDataFrame(rows, "id long, members array<long>")
    got = joins.superseded(sets([(1, [1, 2]), (2, [5]), (3, [1, 2, 3])]), sets([(9, [1, 2, 3])])).collect()
    assert [(r.old_id, r.new_id) for r in got] == [(1, 9)]
    refs = spark.createDataFrame([(1, "one two three four five"), (2, "two"), (3, " ")], "ref_id long, body string")
    items = spark.createDataFrame([(10, "zero one two three four five six"), (11, "two"), (12, None)], "item_id long, content string")
    assert {tuple(r) for r in joins.explicit_references(items, refs).collect()} == {(10, 1), (10, 2), (11, 2)}


def test_explicit_references_inside_words(spark):
    bodies = ["Se que no hay nada mas", "two", "ends in a wor", "\n one two three four five", "a-b", "...", "naïve Straße é x y", "x1 y2 z3", "n n n n n n"]
    texts = ['he said "Se que no hay nada mas" and left', "(two)", "twofold ends in a word", "zero\n one two three four five", "\tends in a wor", "xa-bx", "wait... what", "prenaïve Straße é x yes", None, "", "ax1 y2 z34", "n n n n n n n", "se que no hay nada mas"]
    refs = spark.createDataFrame(list(enumerate(bodies)), "ref_id long, body string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, content string")
    want = sorted((i, k) for i, t in enumerate(texts) for k, b in enumerate(bodies) if b in (t or ""))
    assert sorted(tuple(r) for r in joins.explicit_references(items, refs).collect()) == want
    assert joins.explicit_references(items, refs.limit(0)).count() == 0


def test_ingest(spark):
    raw = spark.createDataFrame([("a", "same"), ("b", "same"), ("c", ""), ("d", "stored"), ("e", "changed"), ("f", "kept")], "path string, content string")
    known = raw.where("path in ('d', 'e', 'f')").withColumn("content", F.when(F.col("path") == "e", "before").otherwise(F.col("content")))
    old = known.select(F.when(F.col("path") == "d", "z").otherwise(F.col("path")).alias("path"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    got = {r.path: r.outcome for r in ingest.outcomes(raw, old).collect()}
    assert got == {"a": "Inserted", "b": "Duplicate", "c": "Skipped", "d": "Duplicate", "e": "Updated", "f": "Skipped"}
    items = spark.createDataFrame([(1, "# A\n" + "word " * 300 + "\n# B\nshort")], "item_id long, content string")
    tasks = ingest.chunk_tasks(items).collect()
    assert sum(t.level == 1 for t in tasks) == 2 and sum(t.level == 2 for t in tasks) >= 4
    assert [(r.start, r.end) for r in ingest.breadcrumbs(items).orderBy("section_idx").collect()][0][0] == 0
    spans = spark.createDataFrame([("aé b aé", ["aé", "aé", "zz"])], "t string, c array<string>").select(ingest.chunk_spans("t", "c").alias("s")).first().s
    assert [(s.start, s.end) if s else None for s in spans] == [(0, 3), (6, 9), None]
    sent = spark.createDataFrame([("Ver 1.5 ok. 好。\nEnd",)], "t string").select(ingest.sentence_spans("t").alias("s")).first().s
    assert [s.text.strip() for s in sent] == ["Ver 1.5 ok.", "好。", "End"] and sent[0].start == 0
    messages = spark.createDataFrame([(1, "translate this text", False), (2, "sum up the document", True), (3, "nothing", False)], "message_id long, text string, has_document boolean")
    skills = spark.createDataFrame([("tr", ["(?i)translat"], ["x"], [], 1, False, True, 1), ("su", [], ["sum", "document"], ["never"], 2, True, True, 5)], "skill string, patterns array<string>, keywords array<string>, excluded array<string>, min_keywords int, needs_document boolean, enabled boolean, priority int")
    assert {(r.message_id, r.skill) for r in ingest.route(messages, skills).collect()} == {(1, "tr"), (2, "su")}
    kinds = ingest.classify_kinds(spark.createDataFrame([(1, "invoice total tax"), (2, "hello")], "id long, text string"), {"receipt": (["invoice"], ["total", "tax"]), "letter": ([], ["dear"])}).collect()
    assert {(r.id, r.kind) for r in kinds} == {(1, "receipt"), (2, None)}


def test_layout(spark):
    cells = [("d", i, t, x, y, x + 30.0, y + 8.0) for i, (t, x, y) in enumerate([("Name", 0.0, 0.0), ("Qty", 100.0, 1.0), ("Pen", 0.0, 12.0), ("2", 101.0, 12.5)])]
    lines = spark.createDataFrame(cells, "doc string, line int, text string, x0 double, y0 double, x1 double, y1 double")
    grid = layout.grid(layout.table_columns(layout.table_rows(lines), 20.0)).orderBy("row").collect()
    assert [(r.header, dict(r.cells)) for r in grid] == [(True, {0: "Name", 1: "Qty"}), (False, {0: "Pen", 1: "2"})]
    receipt = spark.createDataFrame([("d", 0, "Invoice No: 42"), ("d", 1, "Total"), ("d", 2, "9.90")], "doc string, line int, text string")
    assert {r.field: r.value for r in layout.receipt_fields(receipt).collect()} == {"invoice_no": "42", "total": "9.90"}
    card = spark.createDataFrame([("d", 0, "Ann Lee"), ("d", 1, "a@b.org"), ("d", 2, "Acme Ltd")], "doc string, line int, text string")
    assert {r.field: r.value for r in layout.card_fields(card).collect()} == {"name": "Ann Lee", "email": "a@b.org", "company": "Acme Ltd"}
    html = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>")], "page long, html string")
    assert [r.cells for r in layout.html_tables(html, "page", "html").orderBy("row").collect()] == [["a", "b"], ["1", "2"]]


def test_governance(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b", "=x"), (2, None, "y")], "k long, t string, u string")
    assert governance.markdown_table(rows, ["k", "t"], ["k"]).first().markdown.endswith("| 1 | a\\|b |\n| 2 |  |")
    governance.write_audit_csv(rows, str(tmp_path / "csv"))
    assert "'=x" in "".join(r.value for r in spark.read.text(str(tmp_path / "csv")).collect())
    memories = spark.createDataFrame([("episodic", ["h1"], "text"), ("semantic", ["h2"], "more")], "kind string, source_hashes array<string>, summary string")
    governance.export_memories(memories, str(tmp_path / "bundle"), "0123456789abcdef")
    back = governance.import_memories(memories.where("kind = 'episodic'"), spark.read.text(str(tmp_path / "bundle")), "0123456789abcdef").collect()
    assert [r.kind for r in back] == ["semantic"]
    metrics = spark.createDataFrame([("a", 0.8, 0.9, True), ("b", 5.0, 6.0, False)], "metric string, threshold double, baseline double, higher_is_better boolean")
    assert [r.metric for r in governance.ratchet(metrics).collect()] == ["a"]


def test_steps(spark):
    frame = spark.range(3)
    broken = lambda f: f.select("missing")
    out, report = hooks.run_steps(frame, [hooks.Step("keep", lambda f: f.where("id > 0")), hooks.Step("odd", broken, optional=True), hooks.Step("fall", broken, fallback=lambda f: f.limit(1))])
    assert out.count() == 1 and report.status == "Partial" and [t for _, t in report.trace][0] == "ok"
    assert hooks.run_steps(frame, [hooks.Step("bad", broken)])[1].status == "Aborted"


@pytest.mark.parametrize("tokens,want", [(0, "reject"), (5, "sync"), (50, "async"), (500, "cloud")])
def test_admission(spark, tokens, want):
    assert spark.range(1).select(queues.admission(F.lit(tokens), 10, 100, F.lit(False), "cloud").alias("d")).first().d == want
