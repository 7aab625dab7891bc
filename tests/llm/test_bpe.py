import hashlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from docloom.llm import bpe  # noqa: E402

PATH = P.path("word_bpe_49k.json")
REFERENCE = tokenizers.Tokenizer.from_file(PATH)
OWN = bpe.Bpe.load(PATH)


def same(text):
    want = REFERENCE.encode(text, add_special_tokens=False).ids
    got = OWN.encode([text])[0]
    assert got.tolist() == want
    assert (OWN.decode(got).decode() if len(got) else "") == REFERENCE.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    same(text)


def test_known_texts(rows):
    for _, text in rows:
        same(text or "")
    same("a" * 5000 + " " + "ab" * 3000)


def test_operator(docs, rows, empty):
    out = bpe.tokenize(docs, PATH)
    assert set(docs.columns) < set(out.columns)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = []
    for i, t in rows:
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        text = REFERENCE.decode(ids, skip_special_tokens=False)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.tokenize(empty, PATH).count() == 0
