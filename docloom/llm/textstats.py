"""Statistics of whole texts, one Arrow pass, and the bounded labelled sample that the rule learners fit on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios derived from counts; all are 0 for a text without words.
RATIOS = [
    "mean_word_len", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio",
    "bang_ratio", "stop_ratio", "comma_ratio", "words_per_line", "words_per_stop", "non_ascii_ratio", "top_word_ratio",
]
FEATURES = ["n_words", *RATIOS]
SCHEMA = ", ".join(f"{x} long" for x in COUNTS) + ", " + ", ".join(f"{x} double" for x in RATIOS)
SYMBOLS = b"#*$%&|<>"


def repeated_positions(ids: np.ndarray, width: int, kinds: int) -> int:
    """How many positions lie in a window of ``width`` ids that occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, span = ids[:n].astype(np.int64), kinds
    for k in range(1, width):
        if span > (1 << 62) // max(kinds, 1):
            _, key = np.unique(key, return_inverse=True)
            span = n
        key = key * kinds + ids[k : k + n]
        span *= kinds
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[at] > 1)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(text: bytes) -> tuple:
    """The values of COUNTS and RATIOS for one UTF-8 text."""
    found = text.split()
    n = len(found)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * len(RATIOS))
    joined = b"".join(found)
    raw = np.frombuffer(joined, dtype=np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, n)
    repeat = repeated_positions(ids, 3, len(seen))
    count = np.bincount(raw, minlength=256)
    stops = int(count[46] + count[63])
    ratios = (
        chars / n, symbols / chars, dup / len(lines), repeat / n, len(seen) / n, int(count[65:91].sum()) / chars, int(count[48:58].sum()) / chars,
        int(count[33]) / n, stops / n, int(count[44]) / n, n / len(lines), n / (stops + 1), int(count[192:].sum()) / chars, float(np.bincount(ids).max()) / n,
    )
    return (n, chars, symbols, dup, repeat, *map(float, ratios))


def with_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus the statistics of each whole text (null: as empty). Map-only; one row out for each row in."""
    held = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(x) for x in batch.column(len(keep)).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * (len(COUNTS) + len(RATIOS))
            arrays = [pa.array(c, pa.int64() if i < len(COUNTS) else pa.float64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *COUNTS, *RATIOS])

    return held.mapInArrow(run, f"{kinds}, {SCHEMA}")


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, longest: int | None = None) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` rows of each class, outside the held-out fold, smallest id hashes first.

    ``most`` rows, with ``longest`` of so many bytes, bound what reaches the driver where texts go there; longer ones aren't learned from. Repeated
    label rows of an id count once, with the highest label; of several texts of an id the smallest counts; null ids and labels other
    than 0 and 1 are left out.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    usable = usable.where(fold("doc_id", folds) != held).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("y = 1").orderBy(*order).limit(most).union(usable.where("y = 0").orderBy(*order).limit(most))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts if longest is None else texts.where(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def class_counts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> tuple[int, int]:
    """Documents labelled 0 and 1 outside the held-out fold: each id once, with its highest label, if there is such a document."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max(label).alias("y"))
    row = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    return int(row[0]), int(row[1])


def fit_frame(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> pd.DataFrame:
    """Statistics and class of the bounded sample, on the driver, in id order."""
    sample = labelled_sample(docs, labels, label, folds, held, most)
    return with_stats(sample, keep=("doc_id", "y")).toPandas().sort_values("doc_id", ignore_index=True)
