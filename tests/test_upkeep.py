"""Source hints, upkeep, intake and recognized values on small rows."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import entities as en
from docloom.functions import hints, query
from docloom.functions import text as tx
from docloom.operators import governance, ingest, intake, joins, upkeep
from docloom.plans import hooks


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", column.alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_source_hints(spark):
    assert hints.hint_words("The Manuals for iOS, a bus and 42 files") == {"manual", "ios", "bus", "42", "file"}
    asked = "rust manuals as PDF without tokio"
    found = values(spark, hints.hint_boost(asked, F.col("t")), ["Rust Manual\nfiles/RUST.pdf", "tokio guide", "nothing", "", None])
    # rust, manual, pdf overlap and are equal; the format; against the excluded word, which is a query word as well
    assert found == [pytest.approx(0.15 + 0.15 + 0.04), pytest.approx(0.05 + 0.05 - 0.18), 0.0, 0.0, 0.0]
    assert values(spark, hints.hint_boost("manual", F.col("t")), ["manu", "ma", "manually"]) == [0.05, 0.0, 0.05]
    many = " ".join(f"word{i:02}" for i in range(9))
    assert values(spark, hints.hint_boost(many, F.col("t")), [many]) == [0.6]
    assert values(spark, hints.hint_boost("of", F.col("t")), ["of"]) == [0.05] and values(spark, hints.hint_boost("the !", F.col("t")), ["the"]) == [0.0]
    assert hints.excluded_words("a exclude bb ccc not Dogs") == {"ccc", "not", "dog"}


def test_scopes(spark):
    assert hints.scopes("API of rk3588/linux-sdk, v2 on STM") == {"api", "rk3588/linux-sdk", "rk3588", "linux", "sdk", "v2", "stm"}
    found = values(spark, hints.scope_adjustment("use RK3588", F.col("t")), ["rk3588", "guide for rk3588 and rk3399", "rk3399 only", "no scope", ""])
    assert found == [0.7, 0.5, -0.9, 0.0, 0.0] and values(spark, hints.scope_adjustment("plain words", F.col("t")), ["rk3399"]) == [0.0]


def test_recovery(spark):
    again = lambda r, c, k: spark.range(1).select(hints.needs_recovery(F.lit(r), F.lit(c), F.lit(k))).first()[0]
    assert [again(0, 0, 5), again(2, 1, 5), again(2, 1, 2), again(2, 0, 5), again(3, 9, 5)] == [True, True, False, False, False]
    assert hints.recovery_floor(0.65) == pytest.approx(0.55) and hints.recovery_floor(0.5) == 0.45


def test_vector_fingerprints(spark):
    v = spark.createDataFrame([(1, "a", "m1"), (2, "a", "m2"), (3, "a", " "), (4, "b", None)], "item_id long, label string, model string")
    got = {(r.label, r.model): (r.status, r.usable, r.stale) for r in upkeep.compatibility(v, "label", "model", " m1 ").collect()}
    assert got == {("a", "m1"): ("match", True, 0), ("a", "m2"): ("mismatch", False, 1), ("a", None): ("unknown", True, 0), ("b", None): ("unknown", True, 0)}
    assert {r.status for r in upkeep.compatibility(v, "label", "model", None).collect()} == {"current_unknown", "unknown"}
    assert all(r.usable for r in upkeep.compatibility(v, "label", "model", "m1", enforce=False).collect())
    assert sorted(r.item_id for r in upkeep.usable_vectors(v, "model", "m1").collect()) == [1, 3, 4] and upkeep.usable_vectors(v, "model", "").count() == 4
    assert [r.item_id for r in upkeep.stale_ids(v, "item_id", "model", "m1").where("item_id < 3").collect()] == [2]


def test_reindex(spark):
    items = spark.createDataFrame([(1, "# A\none"), (2, "# B\ntwo"), (3, "")], "item_id long, content string")
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "item_id long, idx int")
    changed = spark.createDataFrame([(1,), (1,), (9,)], "item_id long")
    vectors, queue, tasks = upkeep.reindex(items, changed, rows, rows)
    assert [r.item_id for r in vectors.collect()] == [2] == [r.item_id for r in queue.collect()]
    assert {(r.item_id, r.level) for r in tasks.collect()} == {(1, 1), (1, 2)}


def test_intake(spark):
    raw = spark.createDataFrame([("dwell", "a", None), ("typo", "a", "q"), (None, "a", "q"), ("dwell", "x" * 129, "q"), ("dwell", "é" * 65, "q")], "kind string, ref_id string, query string")
    assert sorted(str(r.problem) for r in intake.checked(raw, "kind", intake.SIGNALS, "ref_id").collect()) == ["None", "kind", "kind", "ref", "ref"]
    assert [(r.ref_id, r.query) for r in intake.signals(raw).collect()] == [("a", "")]
    votes = spark.createDataFrame([(1, "relevant"), (2, "good")], "item_id long, feedback_type string")
    assert [r.item_id for r in intake.feedback(votes).collect()] == [1]
    assert [r.item_id for r in intake.pending(votes, votes.where("item_id = 1"), "item_id").collect()] == [2]
    assert values(spark, intake.keyed_hash(F.col("t"), "key"), ["a.org", ""]) == [hmac.new(b"key", m, hashlib.sha256).hexdigest() for m in (b"a.org", b"")]
    with pytest.raises(ValueError):
        intake.keyed_hash(F.lit("x"), "k" * 65)
    seen = intake.visits(spark.createDataFrame([("u" * 3000, "t" * 600, "a.org"), ("u", None, "b.org")], "url string, title string, host string"), F.col("host"), "key")
    left = intake.without_domain(seen, "b.org", "key").collect()
    assert [(len(r.url), len(r.title)) for r in left] == [(2048, 512)]
    marks = spark.createDataFrame([(True,), (False,), (None,)], "promoted boolean")
    assert tuple(intake.bookmark_counts(marks).first()) == (3, 2) and tuple(intake.bookmark_counts(marks.limit(0)).first()) == (0, 0)


def test_estimates_and_blocks(spark):
    models = ["Gemini-2.5-pro", "claude-x", "gpt-4o-mini", "deepseek-r1", "gpt-3.5-turbo", "qwen2", "gemini-nano", "own"]
    assert values(spark, query.context_window(F.col("t")), models) == [1_000_000, 200_000, 128_000, 64_000, 16_000, 32_000, 32_000, 8_000]
    batch = spark.createDataFrame([(10,), (9,)], "tokens long")
    assert query.batch_estimate(batch, F.lit("gpt-4o"), "summarize").first().tokens_out == 2 and query.batch_estimate(batch, F.lit("other"), "rewrite").first().cost is None
    assert tuple(query.batch_estimate(batch, F.lit("gpt-4o"), "extract").first()) == ("gpt-4o", 2, 0, 0, 0.0)
    texts = ["x ```\nraw\n``` y ```json\n{1}\n```", "```a```", "```json {open", "", None]
    assert values(spark, query.json_block(F.col("t")), texts) == ["{1}", "a", None, None, None]


def test_series(spark):
    schema = "p array<struct<name string, values array<double>>>, t array<struct<name string, values array<double>>>"
    rows = [([("a", [1.0, 2.0]), ("b", [1.0])], [("a", [1.0, 2.05]), ("b", [1.0, 1.0])]), ([], []), ([], [("a", [1.0])])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(query.series_f1(F.col("p"), F.col("t"), 0.05)).collect()]
    assert got == [0.5, 1.0, 0.0]


def test_rich_entities(spark):
    text = "张三同李四在北京市海淀区签订合同于2023年1月15日, 履行日 2023/3/20, 解除日二〇二三年六月十日, 2023年2月30日, 给付1,500.50元 1.5万 壹拾万元整, 王小明 华信有限公司 1800年1月1日 张三"
    e = en.rich(text)
    assert e["persons"] == ["张三", "李四", "王小明"] and e["dates"] == ["2023-01-15", "2023-03-20", "2023-06-10"]
    assert {a["raw"]: a["value"] for a in e["amounts"]} == {"1,500.50元": 1500.5, "1.5万": 15000.0, "壹拾万元整": 100000.0}
    assert e["organizations"] == ["华信有限公司"] and "海淀区" in e["locations"]
    assert values(spark, en.rich_entities(F.col("t"))["persons"], ["王小明", "", None]) == [["王小明"], [], []]
    assert list(en.rich_dates("二〇二三年十二月二十五日 二〇二三年十一月三十日 2023年13月45日 2024年2月29日")) == ["2024-02-29", "2023-12-25", "2023-11-30"]
    assert en.numeral("壹亿贰仟叁佰万元整") == 123_000_000 and en.numeral("贰万叁仟亿") == 2.3e12


def test_gates(spark):
    g = spark.createDataFrame([("t1", "p", True, False, "nightly"), ("t1", "q", False, True, None)], "tier string, plugin string, external boolean, ignored boolean, ci string")
    assert {(r.dim, r.val): tuple(r)[2:] for r in upkeep.roll_up(g).collect()} == {("tier", "t1"): (2, 1, 1, 1), ("plugin", "p"): (1, 1, 0, 1), ("plugin", "q"): (1, 0, 1, 0), ("all", ""): (2, 1, 1, 1)}
    seen, base = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "k string, observed long"), spark.createDataFrame([("a", 3), ("b", 0)], "k string, baseline long")
    assert {r.k: r.spiked for r in upkeep.ignore_spikes(seen, base, "k").collect()} == {"a": False, "b": True, "c": True}


def test_watches_by_words_entities_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(joins, "ANCHORS", 2)
    items = [(i, [f"w{i % 4}", f"w{i % 3}", "common"], f"s{i % 2}", i % 5, i % 3, [f"e{i % 4}", f"e{i % 5}"] if i % 6 else None, [float(i % 7), 1.0, 0.0] if i % 8 else None) for i in range(40)]
    watches = [(k, [f"W{k % 4}", "other"] if k % 2 else [], 0.3 + 0.1 * (k % 5), {"s1": 2.0}, k != 5, [f"e{k % 4}"] if k % 3 else [], [1.0, float(k), 0.0] if k % 4 else None, ["s0"] if k == 2 else None) for k in range(9)]
    i = spark.createDataFrame(items, "item_id long, tokens array<string>, source string, age_days int, interactions int, entities array<string>, vector array<double>")
    w = spark.createDataFrame(watches, "watch_id long, keywords array<string>, threshold double, source_weights map<string,double>, enabled boolean, entities array<string>, anchor array<double>, source_ids array<string>")
    want = {}
    for k, words, least, weights, on, ents, anchor, bound in watches:
        for n, tokens, source, age, seen, own, vector in items if on else []:
            words_share = len({x.lower() for x in words} & set(tokens)) / len(words) if words else 0
            overlap = len(set(ents) & set(own or [])) / len(set(ents) | set(own or [])) if ents and own else 0
            norm = lambda v: math.sqrt(sum(x * x for x in v))
            near = sum(a * b for a, b in zip(anchor, vector)) / norm(anchor) / norm(vector) if anchor and vector else 0
            raw = max(words_share, overlap, near)
            if raw >= least and (not bound or source in bound):
                want[k, n] = raw * 0.5 ** (age / 14) * weights.get(source, 1) * (1 + 0.1 * math.log1p(seen))
    got = {(r.watch_id, r.item_id): r.score for r in joins.watch_matches(i, w).collect()}
    assert set(got) == set(want) and len(got) > 50 and all(abs(got[p] - want[p]) < 1e-5 for p in want)
    assert joins.watch_matches(i, w.where("false")).count() == 0


def test_bounds_and_lines(spark, monkeypatch):
    assert [s["content"] for s in tx.sections_of("a\x0cb\u2028c\r\n# H\nd\r")] == ["a\x0cb\u2028c\n", "# H\nd\r\n"] and tx.sections_of("\n") == []
    rows = spark.range(3).select("id")
    monkeypatch.setattr(governance, "MOST_LINES", 2)
    with pytest.raises(Exception, match="more than 2 rows"):
        governance.markdown_table(rows, ["id"], ["id"]).collect()
    monkeypatch.setattr(ingest, "MOST_RULES", 2)
    with pytest.raises(ValueError):
        rule = rows.select(F.col("id").cast("string").alias("skill"), F.array(F.lit("a")).alias("patterns"), F.array(F.lit("k")).alias("keywords"), F.array().cast("array<string>").alias("excluded"))
        ingest.route(rows, rule.withColumns({"enabled": F.lit(True), "min_keywords": F.lit(1), "needs_document": F.lit(False), "priority": F.lit(1)}))


def test_steps_that_run(spark):
    fails = hooks.Step("late", lambda f: f.withColumn("x", F.raise_error(F.lit("late"))), fallback=lambda f: f.limit(1))
    out, report = hooks.run_steps(spark.range(4), [fails], execute=True)
    assert out.count() == 1 and report.trace[0][1].startswith("fallback")


def test_resolved_values(spark):
    states, event = F.create_map(F.lit("a"), F.lit('{"x": "1", "n": null, "o": {"y": 2}}'), F.lit("b"), F.lit('"text"')), F.lit('{"k": 5, "x.y": true}')
    refs = ["$event.k", "$event.x.y", "$event.no", "$a.x", "$a.n", "$a.o", "$b.x", "$c.x", "$a", "plain.x", "", None]
    want = ["5", "true", None, "1", None, '{"y":2}', '"text"', None, "$a", "plain.x", "", None]
    assert values(spark, query.resolved(F.col("t"), states, event), refs) == want
    assert spark.range(1).select(query.source_key(F.array(F.lit("b"), F.lit("a")))).first()[0] == '["a","b"]'
