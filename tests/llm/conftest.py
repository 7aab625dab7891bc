import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `score` string, `kept` string, `spans` string, `size` string"
VOCAB = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "ti") for c in ("", "n", "x", "s")]


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Small documents with copies, near copies, shared passages, nulls, an empty, a wordless and a very long text."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    base = [" ".join(words(rng, rng.randint(20, 160))) + ".\n" + " ".join(words(rng, 12)) for _ in range(24)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[3]) for i in range(6)]
    out += [(120 + i, base[4].replace(base[4].split()[3 * i], "changed", 1)) for i in range(5)]
    out += [(140 + i, f"{base[5 + i]} {passage} {base[12 + i]}") for i in range(3)]
    out += [(160, None), (161, ""), (162, " \n\t "), (163, "word"), (164, " ".join(words(rng, 30_000))), (None, "no id " + base[7]), (165, base[3]), (165, base[3])]
    out += [(170, "the the the the the the"), (171, "İstanbul ΣΑΣ straße naïve <|endoftext|> it's 1234 'll"), (172, "cr\rff\x0cvt\x0b nbsp x")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with results."""
    data = [(i, t, "en", f"s{n % 5}", len(t or ""), "a", "b", "c", "d") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
