from collections import Counter

import pytest

from docloom.llm import substring


def brute(rows, width):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j : j + width]) for _, w in texts for j in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone.update(range(j, j + width))
        out.append((-1 if i is None else i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("width", [35, 6, 3])
def test_matches_brute_force(docs, rows, width):
    got = Counter((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs, width).collect())
    assert got == brute(rows, width)


def test_small_batches(docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET_BYTES", 10_000)
    got = Counter((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs).collect())
    assert got == brute(rows, 35)


def test_empty(empty):
    assert substring.remove_repeats(empty).count() == 0


def test_word_hashes_across_pieces(monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 16)
    texts = [b"alpha beta  gamma", b"", b" alpha\tbeta ", "é beta gamma".encode()]
    h, sizes = substring.hash_words(texts, substring.Powers(substring.BASE))
    assert sizes.tolist() == [3, 0, 2, 3] and h[0] == h[3] and h[1] == h[4] == h[6] and h[2] == h[7] and len(set(h.tolist())) == 4


def test_one_equal_hash_is_not_enough():
    """Windows whose first hashes collide are told apart by the second, inside a batch and between batches."""
    import numpy as np
    import pyarrow as pa

    rows = []
    for key, other in ((1, [11, 12, 13]), (2, [21, 12, 22])):
        batch = substring.pack(np.array([key]), np.array([40]), np.arange(3), np.array([7 << 40, 7 << 40, 9 << 40], np.uint64), np.ones(3, bool), 12, np.array(other, np.uint64))
        rows += batch.to_pylist()
    found = {}
    for bucket in {r["bucket"] for r in rows}:
        for r in substring.count_bucket(False)(pa.Table.from_pylist([r for r in rows if r["bucket"] == bucket])).to_pylist():
            if r["kind"] == substring.FOUND and r["a"]:
                found.setdefault(r["batch"], []).extend(substring.unplanes(r["a"]).tolist())
    assert sorted(found.values()) == [[1], [1]]
