"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each round looks all neighbouring pairs up by binary search over the
sorted pair keys, and every word merges its lowest-ranked pair at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).max
# ---- fixed values: letters and numbers of Unicode versions after the tokenizer library's own, which takes them for neither
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    r"\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
# capitals of later Unicode versions than Python's, with their small letters
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
HAS_LATER = re.compile(f"[{LATER}{''.join(map(chr, LATER_LOWER))}]")


def is_one_byte(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def one_byte(pattern: str) -> str:
    """The split pattern for texts of one-byte characters, with its classes spelt out for the standard library's faster matcher."""
    kinds = {k: [c for c in range(256) if regex.match(p, chr(c))] for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    spelt = lambda cs: "".join(f"\\x{c:02x}" for c in cs)
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spelt(kinds['S'] + kinds['L'] + kinds['N'])}]")
    return out.replace(r"[\p{L}]", f"[{spelt(kinds['L'])}]").replace(r"[\p{N}]", f"[{spelt(kinds['N'])}]")


def older(pattern: str) -> str:
    """The split pattern with letters and numbers as the library's Unicode version has them."""
    other = r"[^\s\p{L}\p{N}]"
    parts = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").split(other)
    known = [p.replace(r"\p{L}", rf"[\p{{L}}--[{LATER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{LATER}]]") for p in parts]
    return "(?V1)" + rf"(?:{other}|[{LATER}])".join(known)


def byte_chars() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: itself if printable Latin-1, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the slices [start, start + size) one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Bpe:
    """A word-level BPE vocabulary as arrays. ``keys`` is sorted; ``ranks`` and ``made`` belong to its pairs."""

    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte at a word's end
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    span: int
    pattern: str
    specials: dict[str, int]
    names: np.ndarray  # UTF-8 bytes of all tokens, each with a space behind
    name_starts: np.ndarray
    name_sizes: np.ndarray
    plain: re.Pattern  # the pattern for texts of one-byte characters
    most_words: int = 400_000
    known: dict[str, int] = field(default_factory=dict)
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def load(cls, path: str) -> Bpe:
        """Reads a tokenizers file: BPE model with an end-of-word suffix, byte-level symbols and a split pattern."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        span = max(names) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        a, b = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[x + y] for x, y in merges], np.int64)
        born = np.full(span, -1, np.int64)
        born[made] = np.arange(len(merges))
        if (np.maximum(born[a], born[b]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes; rounds need merges in the order they were learned")
        order = np.argsort(a * span + b, kind="stable")
        chars = byte_chars()
        tokens = [(names.get(i, "") + " ").encode() for i in range(span)]
        sizes = np.array([len(x) for x in tokens], np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        return cls(
            np.array([vocab[c] for c in chars], np.int64), np.array([vocab[c + suffix] for c in chars], np.int64),
            (a * span + b)[order], order.astype(np.int64), made[order], span, pattern,
            {x["content"]: x["id"] for x in spec["added_tokens"]},
            np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes, re.compile(one_byte(pattern)),
        )

    def split(self, text: str) -> list[str | int]:
        """Words of a text after normalization, and ids of special tokens that it spells out."""
        later = not is_one_byte(text) and HAS_LATER.search(text) is not None
        find = regex.compile(older(self.pattern) if later else self.pattern).findall
        marks = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split(text) if any(s in text for s in self.specials) else [text]
        out: list[str | int] = []
        for part in marks:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                # lower() treats a final capital sigma by context; the normalizer doesn't
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                low = low.translate(LATER_LOWER) if later else low
                out += self.plain.findall(low) if is_one_byte(low) else find(low)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        sym = self.first[raw]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            rank = np.full(len(sym), NONE)
            if len(sym) > 1:
                key = sym[:-1] * self.span + sym[1:]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            over = np.repeat(low == NONE, count)
            if over.any():  # words without a pair to merge leave the array
                done.append((word[over], sym[over]))
                word, sym, rank, low = word[~over], sym[~over], rank[~over], np.repeat(low, count)[~over]
                if not len(sym):
                    break
            else:
                low = np.repeat(low, count)
            pick = rank == low
            at = np.flatnonzero(pick)
            run = np.concatenate(([True], np.diff(at) > 1))  # a pair of equal symbols overlaps itself: every other one, from the left
            start = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - start) % 2 == 0]
            key = sym[at] * self.span + sym[at + 1]
            sym[at] = self.made[np.searchsorted(self.keys, key)]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            word, sym = word[keep], sym[keep]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        word, sym = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Distinct words are merged once and remembered up to ``most_words``."""
        parts = [self.split(x) for x in texts]
        flat = [w for p in parts for w in p]
        if len(self.known) > self.most_words:
            self.known.clear()
            self.starts = self.sizes = self.flat = np.empty(0, np.int64)
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            spelt = [w for w in new if isinstance(w, str)]
            special = [w for w in new if not isinstance(w, str)]
            ids, sizes = self.merge([w.encode() for w in spelt])
            ids = np.concatenate((ids, np.array(special, np.int64)))
            sizes = np.concatenate((sizes, np.ones(len(special), np.int64)))
            self.known |= {w: i for i, w in enumerate((*spelt, *special), len(self.sizes))}
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, ids))
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ids = self.flat[ragged(self.starts[which], self.sizes[which])]
        bounds = np.concatenate(([0], np.cumsum(self.sizes[which])))[np.cumsum([0, *map(len, parts)])]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' names joined by one space, in UTF-8; special tokens too."""
        return self.names[ragged(self.name_starts[ids], self.name_sizes[ids])][:-1].tobytes()


def groups(texts: list[str], most: int = 500_000) -> Iterator[slice]:
    """Consecutive texts of ``most`` characters or one text, so that the arrays of a round stay bounded."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield slice(at, len(texts))


def tokenize(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` plus n_tokens, token_ids (array, if ``with_ids``), ids_sha256 and decoded_sha256 of each whole text; map-only.

    The vocabulary's arrays are read by the driver from ``path`` and broadcast (their size is the vocabulary's, whatever the input).
    A null or empty text has no tokens. Columns of ``docs`` with the names of new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Bpe.load(path))
    added = ["n_tokens", *(["token_ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*added)
    kept = docs.schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {k}" for c, k in (("n_tokens", "long"), ("token_ids", "array<int>"), ("ids_sha256", "string"), ("decoded_sha256", "string")) if c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(len(kept)).to_pylist()]
            for part in groups(texts):
                ids = model.encode(texts[part])
                arrays = [pa.array([len(x) for x in ids], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                arrays.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()))
                arrays.append(pa.array([hashlib.sha256(model.decode(x) if len(x) else b"").hexdigest() for x in ids], pa.string()))
                own = [c.slice(part.start, part.stop - part.start) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*own, *arrays], names=[*(f.name for f in kept), *added])

    return docs.select("*", F.col(text_col).alias("__encode")).mapInArrow(run, schema)
