"""The analyzer of full-text search: lower case, Han runs cut up, English stems. Indexes and queries share it.

A text's terms, for an index: of a Han run its single characters and its overlapping pairs; of any other run of letters and digits its stem. A query's Han
runs are pairs (a run of one character stays), so that a query of two characters finds every longer run that holds them side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.functions.text import pieces

# ---- fixed values: the endings and exceptions of the English (Porter2) stemming algorithm
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"
FIRST_REGIONS = ("gener", "commun", "arsen")
STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# ---- end of the fixed values

VOWEL = "[aeiouy]"
REGION = re.compile(f"{VOWEL}[^aeiouy]")
SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy]", re.S)
HAS_VOWEL = re.compile(VOWEL)
Y_CONSONANT = re.compile("^y|(?<=[aeiouy])y")


def _longest(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where the regions R1 and R2 begin."""
    head = next((p for p in FIRST_REGIONS if word.startswith(p)), None)
    found = REGION.search(word)
    r1 = len(head) if head else found.end() if found else len(word)
    found = REGION.search(word, r1)
    return r1, found.end() if found else len(word)


def _plural(word: str) -> str:
    """Step 1a."""
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and HAS_VOWEL.search(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    """Step 1b."""
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return word
    rest = word[: len(word) - len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not HAS_VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(DOUBLES):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and SHORT.fullmatch(rest) else rest


def _derived(word: str, r1: int, r2: int) -> str:
    """Steps 2 to 4: derivational endings, in R1 and in R2."""
    end = _longest(word, STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: len(word) - len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and before[-1:] not in tuple(LI_BEFORE)):
            word = before + STEP2[end]
    end = _longest(word, STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: len(word) - len(end)] + STEP3[end]
    end = _longest(word, STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: len(word) - len(end)]
    return word


def stem(word: str) -> str:
    """English stem of a lower-cased word; words of one or two characters stay, and other scripts have no English ending."""
    if len(word) <= 2 or word in STEMS:
        return STEMS.get(word, word)
    word = Y_CONSONANT.sub("Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not SHORT.fullmatch(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


RUNS = re.compile(r"[^\W_]+")
HAN = re.compile("([㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+)")
#: Stems that a task remembers at once.
REMEMBERED = 1 << 17


def plain_terms(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, as ``functions.text.tokens``."""
    return RUNS.findall(text.lower())


def english_han(query: bool = False) -> Callable[[str], list[str]]:
    """The analyzer, for texts or for queries; it remembers stems, since words repeat."""
    known: dict[str, tuple[str, ...]] = {}

    def cut(run: str) -> tuple[str, ...]:
        if run.isascii():
            return (stem(run),)
        out: list[str] = []
        for part in filter(None, HAN.split(run)):
            if not HAN.match(part):
                out.append(stem(part))
            else:
                out += ([] if query and len(part) > 1 else list(part)) + [part[i : i + 2] for i in range(len(part) - 1)]
        return tuple(out)

    def analyze(text: str) -> list[str]:
        if len(known) > REMEMBERED:
            known.clear()
        out: list[str] = []
        for run in RUNS.findall(text.lower()):
            terms = known.get(run)
            if terms is None:
                terms = cut(run)
                if len(run) <= 64:
                    known[run] = terms
            out += terms
        return out

    return analyze


@pandas_udf(T.ArrayType(T.StringType()))
def analyzed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column of a text's terms; null for null."""
    analyze = english_han()
    for batch in texts:
        for (piece,) in pieces(batch):
            yield piece.map(lambda t: None if t is None else analyze(t))


def query_terms(query: str) -> list[str]:
    """A query's distinct terms, in order."""
    return list(dict.fromkeys(english_han(query=True)(query)))
