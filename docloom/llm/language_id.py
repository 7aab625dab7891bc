"""Language identification by compression: the language whose texts, as a raw-content dictionary, make a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.textstats import fold

#: Learned rows of a language, at most, each of at most so many bytes; longer texts are predicted but not learned from.
SAMPLE, LONGEST = 256, 1 << 14
#: Parts that a language's keys are dealt over while the smallest are looked for.
DEAL = 64
#: Bytes of one language's dictionary, and of all together, at most; beyond 128 languages each gets an equal share.
DICTIONARY, DICTIONARIES = 1 << 19, 1 << 26
#: Bytes that are compressed at once: in longer stretches the text's own past would stand in for the dictionary.
PIECE = 1 << 12
LEVEL, MIN_MATCH = 6, 4
#: A prediction is rejected if the second language needs less than this many bytes more, or this share of the smallest size.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.01
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased words of letters with one space between them, in UTF-8; empty if there is no letter."""
    words = " ".join(WORDS.findall(text.lower()))
    return words.encode("utf-8", "replace") if any(map(str.isalpha, words)) else b""


def sample(docs: DataFrame, folds: int, held: int, most: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """(lang, key, text, n): at most ``most`` rows of each language outside the held-out fold, smallest hashes first, and the language's number of rows.

    Rows with a null id, text or language and rows alike are counted out or once; the order of rows doesn't matter."""
    usable = docs.where(F.col("lang").isNotNull() & (fold("doc_id", folds) != held) & (F.octet_length("text") <= longest))
    keyed = usable.select("lang", F.xxhash64("doc_id", "text").alias("key"), "text")
    chosen = keyed.select("lang", "key").distinct()
    for parts in ([F.col("lang"), F.pmod("key", F.lit(DEAL))], [F.col("lang")]):  # a language may hold most rows, so its parts are cut first
        first = Window.partitionBy(*parts).orderBy("key")
        chosen = chosen.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select("lang", "key")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    return keyed.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).join(F.broadcast(sizes), "lang")


def dictionaries(learned: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content of each language, most frequent language first: whole texts up to the bound. Bounded by DICTIONARIES on the driver."""
    texts: dict[str, list[bytes]] = {}
    rows: dict[str, int] = {}
    for r in learned.orderBy("lang", "key").toLocalIterator():
        rows[r.lang] = r.n
        texts.setdefault(r.lang, []).append(letters(r.text))
    room = min(DICTIONARY, DICTIONARIES // max(len(texts), 1))
    out = {}
    for lang in sorted(texts, key=lambda x: (-rows[x], x)):
        content = b""
        for text in texts[lang]:
            if len(content) + len(text) < room:
                content += text + b" "
        out[lang] = content
    return out


class Sizes:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, contents: dict[str, bytes]) -> None:
        self.languages, self.encoders = list(contents), []
        shape = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        for content in contents.values():
            held = None
            if len(content) >= 8:  # a shorter content isn't taken as a dictionary
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=shape)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=held, compression_params=shape))

    def __call__(self, body: bytes) -> list[int]:
        pieces = [body[i : i + PIECE] for i in range(0, len(body), PIECE)]
        return [sum(len(encoder.compress(p)) for p in pieces) for encoder in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool, int]:
        """(language, score, rejected, margin in bytes); equal sizes go to the more frequent language."""
        body = letters(text or "")
        if not body or not self.languages:
            return UNKNOWN, 0.0, True, 0
        sizes = self(body)
        best = min(sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else 2 * best
        margin = second - best
        score = 1 / sum(2.0 ** (best - s) for s in sizes)
        return self.languages[sizes.index(best)], score, margin < max(MARGIN_BYTES, MARGIN_SHARE * best), margin


def identify(docs: DataFrame, contents: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred, score, rejected and margin of each whole text. Map-only; one row out for each row in."""
    held = docs.select(*keep, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    names = [*keep, "lang_pred", "score", "rejected", "margin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Sizes(contents).predict
        for batch in batches:
            rows = [predict(x) for x in batch.column(len(keep)).to_pylist()]
            cols = zip(*rows) if rows else ((), (), (), ())
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=names)

    return held.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean, margin long")


def predict_language(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected, margin.

    Learns text and lang of the rows whose crc32(doc_id as text) modulo ``folds`` isn't ``held``: a bounded sample of SAMPLE rows a language. A text is
    reduced to its words of letters, lower-cased, and the smallest of its compressed sizes names the language; ``score`` is that language's share if
    each byte more halves the weight, and ``rejected`` marks margins under MARGIN_BYTES or MARGIN_SHARE, whose prediction shouldn't be relied on.

    A null, empty or letterless text is ``und`` with score 0, as is every text if nothing could be learned. Texts of any length are compressed whole, in
    pieces. Equal sizes go to the language with more learned rows, then to the smaller name. Repeated rows get equal results; rows with a null id are
    predicted, not learned from and not held out. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    contents = dictionaries(sample(docs, folds, held))
    out = identify(docs.select("doc_id", "text"), contents)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected", "margin")
