import math
import random

import numpy as np
import pandas as pd
import pytest

from docloom.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    plain = [a + b for a in ("ber", "tal", "mor", "fen", "gul") for b in ("an", "eth", "ist", "ov", "ul", "yr")]
    data, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword", "foulword"]))
        data.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = toxicity.score_toxicity(docs, labels, keep=("doc_id",)).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    assert all(len(r.evidence) <= 15 for r in rows)


def made_index(sample):
    terms = toxicity.Terms(toxicity.choose_terms(list(sample.text), sample.y.to_numpy(), 3, 2.0))
    counts = [terms.counts(x) for x in sample.text]
    df = np.array([sum(t in c for c in counts) for t in range(len(terms.number))])
    return toxicity.build_index(sample, terms, len(sample), df), df


def test_block_max_search_is_exact(corpus):
    """Against the definition: the cosine with every example by plain dictionaries, the k highest and all that tie with the last of them."""
    docs, labels = corpus
    sample = toxicity.labelled_sample(docs, labels, "toxic", 5, 0, 300).toPandas().sort_values("doc_id", ignore_index=True)
    # copies and texts that share few terms, so that cosines tie and blocks differ
    extra = pd.DataFrame({"doc_id": range(1000, 1040), "text": [sample.text[i % 4] if i % 2 else f"unknown{i} words" for i in range(40)], "y": [i % 2 for i in range(40)]})
    sample = pd.concat([sample, extra], ignore_index=True)
    index, df = made_index(sample)
    text = dict(zip(sample.doc_id, sample.text))

    def vector(x):
        out = {t: (1 + math.log(n)) * (math.log((1 + len(sample)) / (1 + df[t])) + 1 if t != index.terms.number[""] else 1.0) for t, n in index.terms.counts(x).items()}
        size = math.sqrt(sum(v * v for v in out.values()))
        return {t: v / size for t, v in out.items()}

    vectors = [vector(text[d]) for d in index.ids]
    starts, t, n = toxicity.flat_counts(index.terms, [text[d] for d in index.ids])
    for skip in (None, np.arange(len(index.ids))):
        for k in (1, 15, 1000):
            row, ex, s = index.nearest(starts, t, n, k, skip)
            for i, own in enumerate(vectors):
                cos = [(round(sum(own.get(a, 0.0) * b for a, b in v.items()), 6), -m) for m, v in enumerate(vectors) if skip is None or m != i]
                cos = sorted((c for c in cos if c[0] > 0), reverse=True)
                want = [c for c in cos if c[0] >= cos[min(k, len(cos)) - 1][0]]
                got = list(zip(s[row == i], ex[row == i].tolist()))
                assert len(got) == len(want) >= min(k, len(cos)) and np.allclose([c for c, _ in got], [c for c, _ in want], atol=2e-6)
                assert skip is None or i not in [e for _, e in got]
    assert 0 < index.walked < index.met


def test_ties_all_vote():
    """A text as near to 39 toxic examples as to a clean one is scored by all of them."""
    sample = pd.DataFrame({"doc_id": range(80), "text": ["vile"] * 40 + ["calm"] * 40, "y": [0] + [1] * 39 + [0] * 40})
    index, _ = made_index(sample)
    row, ex, s = index.nearest(*toxicity.flat_counts(index.terms, ["vile"]), 15)
    assert len(ex) == 40 and set(s) == {1.0} and index.labels[ex].sum() == 39
    assert toxicity.Votes.features(1, row, index.labels[ex], s)[0, 1] > 0.45


def test_edges(spark, docs, empty, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, none)
    assert out.count() == docs.count() and {r.score for r in out.select("score").collect()} == {0.5}
    assert toxicity.score_toxicity(empty, none).count() == 0
    scored = toxicity.score_toxicity(docs, corpus[1], keep=("doc_id",))
    assert scored.count() == docs.count() and scored.where("score is null or held_out is null").count() == 0


def test_index_bound():
    assert toxicity.choose_terms(["a b", "c"], np.array([0, 1]), 3, 10.0) == []


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * 100), (3, None), (4, "t"), (4, "t")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2, "clash") for i in (1, 1, 2, 3, 4)] + [(None, 1, 1, "c"), (9, 1, 1, "c")], "doc_id long, quality int, toxic int, text string")
    rows = {tuple(r) for r in toxicity.labelled_sample(docs, labels, "toxic", 1, 5, 10, 50).collect()}
    assert rows == {(1, "a", 1), (3, "", 1), (4, "t", 0)}


def test_term_counts_leave_a_task_added_up():
    """One row a term and task, not one a term and text."""
    import pyarrow as pa

    from docloom.llm.toxicity import held_counts

    texts = [[0, 3], [3], [], [7, 0, 3]]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.int32()))], names=["__t"]) for t in (texts[:2], [], texts[2:])]
    out = pa.Table.from_batches(held_counts(iter(batches))).to_pydict()
    assert dict(zip(out["t"], out["n"])) == {0: 2, 3: 3, 7: 1, -1: 4} and len(out["t"]) == 4
