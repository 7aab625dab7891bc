import random
import re

import pytest

from docloom.llm import decision_list, rule_ensemble, textstats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text):
    found = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    data, marks = [], []
    for i in range(240):
        good = i % 4 != 0
        words = [rng.choice(["river", "stone", "cloud", "forest", "light", "winter"]) + rng.choice(["", "s", "ed"]) for _ in range(80)]
        text = ". ".join(" ".join(words[k : k + 8]) for k in range(0, 80, 8)) if good else " ".join(w + rng.choice(["$$$", "***", "%%%"]) for w in words)
        data.append((i, text))
        marks.append((i, int(good), 0))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_stats_match_brute_force(docs, rows):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in textstats.with_stats(docs).collect() if r.n_words < 5000)
    want = sorted((i if i is not None else -1, *slow_stats(t)) for i, t in rows if len(WORD.findall(t or "")) < 5000)
    assert got == want


def test_repeats_of_wide_alphabets():
    import numpy as np

    ids = np.array([5, 6, 7, 1, 5, 6, 7])
    assert textstats.repeated_positions(ids, 3, 1 << 40) == textstats.repeated_positions(ids, 3, 8) == 6
    assert textstats.repeated_positions(np.array([1, 1, 1, 1]), 3, 2) == 4


def test_rules_and_ensemble_separate(corpus):
    docs, labels = corpus
    out = decision_list.apply_quality_rules(docs, labels)
    assert out.columns == ["doc_id", *textstats.COUNTS, "base_failed", "rule", "kept"]
    wrong = out.join(labels, "doc_id").where("kept != (quality = 1)").count()
    assert wrong <= 4
    scored = rule_ensemble.score_quality(docs, labels).join(labels, "doc_id")
    held = scored.where("held_out").collect()
    assert held and sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in scored.collect())


def test_no_labels_and_empty(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = decision_list.apply_quality_rules(docs, none)
    assert out.count() == docs.count() and out.where("kept = base_failed").count() == 0
    assert {r.score for r in rule_ensemble.score_quality(docs, none).select("score").distinct().collect()} == {0.5}
    assert decision_list.apply_quality_rules(empty, none).count() == 0 == rule_ensemble.score_quality(empty, none).count()


def test_compiled_score_equals_model(corpus):
    docs, labels = corpus
    frame = textstats.fit_frame(docs, labels, "quality", 3, 1, 3000)
    model = rule_ensemble.fit(frame, (60, 180))
    stats = textstats.with_stats(docs).withColumn("s", model.column()).toPandas()
    assert abs(stats.s.to_numpy() - model.predict(stats)).max() < 1e-9
