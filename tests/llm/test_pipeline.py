"""The whole pipeline against brute-force versions of its stages, over small tables on disk."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from docloom.llm import toxicity  # noqa: E402
from tests.llm.test_bpe import REFERENCE  # noqa: E402
from tests.llm.test_native import slow_leaks, slow_lines  # noqa: E402
from tests.llm.test_simhash import brute, fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("tables"))
    vocab = [a + b + c for a in ("ber", "tal", "mor", "fen", "gul", "hes") for b in ("an", "eth", "ist", "ov") for c in ("", "ir", "um")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(20)) for k in range(6)]
    rows, marks = [], []
    for i in range(260):
        words = text(rng.randint(40, 120)).split()
        if i % 6 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword", "foulword"]))
        lines = [" ".join(words[:30]), " ".join(words[30:])] + (["a line that many sites carry at the end"] if i % 2 else [])
        if i % 17 == 5:
            lines.insert(1, items[i % 6][1])
        rows.append((i, "\n".join(lines), "en", f"src{i % 20}"))
        if i % 2 == 0 or i % 5 == 0:
            marks.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + k, rows[7][1], "en", "src1") for k in range(5)] + [(310 + k, rows[8][1].replace(" ", "  ", 1 + k), "en", "src2") for k in range(3)]
    rows += [(320, "", "en", "src3"), (321, None, "en", "src4")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_matches_brute_force(spark, tables):
    folder, rows, items = tables
    out = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels, keep=("doc_id",)).where("predicted = 1").collect()}
    assert len(toxic & {i for i in range(260) if i % 6 == 0}) >= 40 and len(toxic) <= 50
    kept = [(i, t, s) for i, t, _, s in rows if i not in toxic]
    texts = [(i, t) for i, t, _, _ in slow_lines(kept, 8)]
    groups = {}
    for (i, _, c), _ in brute(texts).items():
        groups.setdefault(c, []).append(i)
    firsts = {min(g) for g in groups.values()}
    left = [(i, t) for i, t in texts if i in firsts]
    leaks = {i for i, _, _ in slow_leaks(left, items)}
    final = {i: t for i, t in left if i not in leaks}
    assert set(out) == set(final) and leaks
    for i, t in final.items():
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        assert out[i].token_ids == ids and out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_columns(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    assert len(pipeline.STAGES) == 5 and fingerprint(None) == 0
