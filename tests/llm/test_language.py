"""Language identification: held-out accuracy, plain compression as reference, and the edges."""

import random
import zlib

import pytest
import zstandard

from docloom.llm import language_id

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne", "sor"], "bb": ["sch", "eit", "ung", "ber", "ä"], "cc": ["que", "ño", "ando", "el", "cia"]}


def rows(n=240):
    rng = random.Random(4)
    out = []
    for i in range(n):
        lang = ["aa", "aa", "bb", "cc"][i % 4]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(6, 200))]
        out.append((i, " ".join(words).capitalize() + ". 12 %", lang))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, True) for r in rows()], "doc_id long, text string, lang string, score double, rejected boolean").repartition(5)


def test_held_out_languages_are_found(docs):
    truth = {i: lang for i, _, lang in rows()}
    got = language_id.predict_language(docs).collect()
    assert len(got) == 240 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.lang_pred == truth[r.doc_id] for r in held) and all(0 < r.score <= 1 for r in got)


def test_smallest_size_wins(docs):
    """Against one-shot compression with the same content, text by text."""
    contents = language_id.dictionaries(language_id.sample(docs, 5, 0))
    assert list(contents)[0] == "aa" and set(contents) == {"aa", "bb", "cc"}
    learned = {language_id.letters(t) for i, t, _ in rows() if zlib.crc32(str(i).encode()) % 5}
    assert all(t in contents["bb"] for t in learned if b"sch" in t)
    shape = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {r.doc_id: r for r in language_id.predict_language(docs).collect()}
    for i, text, _ in rows()[:40]:
        body = language_id.letters(text)
        sizes = {}
        for lang, content in contents.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=shape)
            encoder = zstandard.ZstdCompressor(dict_data=held, compression_params=shape)
            sizes[lang] = sum(len(encoder.compress(body[k : k + 4096])) for k in range(0, len(body), 4096))
        assert got[i].lang_pred == min(sizes, key=sizes.get)
        assert got[i].margin == sorted(sizes.values())[1] - min(sizes.values())
        assert got[i].rejected == (got[i].margin < max(2, 0.01 * min(sizes.values())))


def test_the_sample_is_bounded_and_knows_no_held_out_row(docs):
    got = language_id.sample(docs, 5, 0, most=10).collect()
    truth = {t: i for i, t, _ in rows()}
    assert {r.lang: sum(1 for x in got if x.lang == r.lang) for r in got} == {"aa": 10, "bb": 10, "cc": 10}
    assert all(zlib.crc32(str(truth[r.text]).encode()) % 5 for r in got)
    short = language_id.sample(docs, 5, 0, longest=60).collect()
    assert short and all(len(r.text.encode()) <= 60 for r in short)


def test_labels_of_held_out_rows_change_nothing(spark):
    data = rows()
    other = [(i, t, "bb" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in data]
    shape = "doc_id long, text string, lang string"
    a, b = (sorted(map(tuple, language_id.predict_language(spark.createDataFrame(x, shape)).collect())) for x in (data, other[::-1]))
    assert a == b


def test_edges(spark):
    shape = "doc_id long, text string, lang string, margin int"
    assert language_id.predict_language(spark.createDataFrame([], shape)).collect() == []
    unknown = spark.createDataFrame([(1, "word", None, 0), (None, "word", "xx", 0)], shape)
    assert {(r.lang_pred, r.score) for r in language_id.predict_language(unknown).collect()} == {("und", 0.0)}
    odd = [(1, None, "aa", 0), (2, "", "aa", 0), (3, "12 ²½ !?", "bb", 0), (None, "kalomi", "aa", 0), (4, "x", "cc", 0), (5, "kalo " * 60_000, "aa", 0), (6, "kalo", None, 0)]
    got = language_id.predict_language(spark.createDataFrame([(*r, 0) for r in rows()] + [(1000 + i if i else None, t, g, m) for i, t, g, m in odd] * 2, shape)).collect()
    assert len(got) == 240 + 14
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.held_out, r.lang_pred, r.score, r.rejected))
    assert all(len(v) == 1 for v in by.values())
    assert [next(iter(by[1000 + i]))[1] for i in (1, 2, 3, 5)] == ["und", "und", "und", "aa"]
    assert next(iter(by[None]))[0] is False
