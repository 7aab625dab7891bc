"""What a query says about the sources it wants, as expressions over a result's source text (title, path, breadcrumb). The query is a value of
the driver, the source a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.vector import let

# ---- fixed values: words that hint at nothing, words kept with their s, parts of scopes that name no component, marks of exclusion, weights
STOPWORDS = ["and", "are", "for", "from", "give", "into", "local", "many", "now", "source", "the", "this", "while", "with", "without"]
KEPT_WHOLE = ["dos", "ios", "rtos", "windows"]
NO_COMPONENT = ["api", "dev", "developer", "doc", "guide", "manual", "platform", "reference", "source"]
EXCLUSIONS = ["不要引入", "不要包含", "不包括", "排除", "without", "exclude", "excluding", "not "]
WORD, WORD_CAP, FORMAT, EXCLUDED, EXCLUDED_CAP = 0.05, 0.30, 0.04, 0.18, 0.36
SCOPE_MATCH, SCOPE_CONFLICT, SCOPE_BOTH = 0.70, -0.90, -0.20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def hint_words(text: str) -> set[str]:
    """Lower-case ASCII words of two letters or more without stopwords; longer ones lose a last s."""
    found = set(re.findall(r"[a-z0-9]{2,}", text.translate(str.maketrans(_UPPER, _LOWER)))) - set(STOPWORDS)
    return {w[:-1] if len(w) > 3 and w.endswith("s") and w not in KEPT_WHOLE else w for w in found}


def source_words(source: Column) -> Column:
    """``hint_words`` of a column of lower-case text."""
    kept = F.filter(F.regexp_extract_all(source, F.lit("([a-z0-9]{2,})"), F.lit(1)), lambda w: ~w.isin(*STOPWORDS))
    plural = lambda w: (F.length(w) > 3) & F.endswith(w, F.lit("s")) & ~w.isin(*KEPT_WHOLE)
    return F.array_distinct(F.transform(kept, lambda w: F.when(plural(w), F.regexp_replace(w, "s$", "")).otherwise(w)))


def excluded_words(query: str) -> set[str]:
    """Words of three letters or more behind the first of each mark of exclusion."""
    low = query.translate(str.maketrans(_UPPER, _LOWER))
    rests = [low.split(mark, 1)[1] for mark in EXCLUSIONS if mark in low]
    return {w for rest in rests for w in hint_words(rest) if len(w) >= 3}


def hint_boost(query: str, source: Column) -> Column:
    """Bonus of a source: for query words that a source word equals or begins (or is begun by), again for equal ones, for a named format,
    less for words that the query excludes; 0 for a query without words."""
    words, low = sorted(hint_words(query)), query.translate(str.maketrans(_UPPER, _LOWER))
    if not words:
        return F.lit(0.0)
    asks = lambda *marks: any(m in low for m in (*marks, "source file", "source document"))
    formats = [(asks("pdf"), (".pdf",)), (asks("markdown"), (".md", "markdown"))]

    def near(found: Column, word: str) -> Column:
        if len(word) < 3:
            return F.array_contains(found, word)
        return F.exists(found, lambda s: (s == word) | ((F.length(s) >= 3) & (F.startswith(s, F.lit(word)) | F.startswith(F.lit(word), s))))

    def count(tests: list[Column]) -> Column:
        return sum((F.when(t, 1).otherwise(0) for t in tests), F.lit(0))

    def score(found: Column) -> Column:
        overlap = F.least(count([near(found, w) for w in words]) * WORD, F.lit(WORD_CAP))
        equal = F.least(count([F.array_contains(found, w) for w in words if len(w) >= 3]) * WORD, F.lit(WORD_CAP))
        against = F.least(count([F.array_contains(found, w) for w in sorted(excluded_words(query))]) * EXCLUDED, F.lit(EXCLUDED_CAP))
        return overlap + equal - against

    bonus = let(source_words(ascii_lower(source)), score)
    for asked, marks in formats:
        if asked:
            bonus = bonus + F.when(ascii_lower(source).rlike("|".join(map(re.escape, marks))), FORMAT).otherwise(0.0)
    return F.round(bonus, 6)


def scopes(query: str) -> set[str]:
    """Explicit scopes of a query: words with a digit or an inner separator, acronyms, and the parts of separated ones."""
    out = set()
    for raw in re.findall(r"[A-Za-z0-9_/.-]+", query):
        raw = raw.strip("-_/.")
        letters = re.sub(r"[^A-Za-z]", "", raw)
        if len(raw) >= 2 and (re.search(r"[0-9_/.-]", raw) or (letters.isupper() and len(raw) <= 12)):
            out.add(raw.lower())
            if re.search(r"[_/.-]", raw):
                out |= {p for p in re.split(r"[_/.-]", raw.lower()) if len(p) >= 2 and p not in NO_COMPONENT}
    return out


def source_scopes(source: Column) -> Column:
    """``scopes`` of a column of lower-case text, which has no acronyms."""
    raw = F.transform(F.regexp_extract_all(source, F.lit("([a-z0-9_/.-]+)"), F.lit(1)), lambda w: F.regexp_replace(w, "^[_/.-]+|[_/.-]+$", ""))
    named = F.filter(raw, lambda w: (F.length(w) >= 2) & w.rlike("[0-9_/.-]"))
    parts = F.flatten(F.transform(F.filter(named, lambda w: w.rlike("[_/.-]")), lambda w: F.split(w, "[_/.-]")))
    return F.array_union(named, F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin(*NO_COMPONENT)))


def scope_adjustment(query: str, source: Column) -> Column:
    """What a score gains if the source has a scope that the query names, and loses for scopes that it doesn't name; 0 where either has none."""
    wanted = sorted(scopes(query))
    if not wanted:
        return F.lit(0.0)

    def score(found: Column) -> Column:
        match, conflict = F.arrays_overlap(found, F.array(*map(F.lit, wanted))), F.exists(found, lambda s: ~s.isin(*wanted))
        return F.when(match & conflict, SCOPE_MATCH + SCOPE_BOTH).when(match, SCOPE_MATCH).when(conflict, SCOPE_CONFLICT).otherwise(0.0)

    return F.round(let(source_scopes(ascii_lower(source)), score), 6)


def needs_recovery(results: Column, cut_off: Column, top: Column) -> Column:
    """Whether a search is run again with a lower floor: nothing found, or fewer than three (or ``top``) while some were cut off."""
    return (results == 0) | ((cut_off > 0) & (results < F.least(top, F.lit(3))))


def recovery_floor(floor: float, step: float = 0.10, least: float = 0.45) -> float:
    return max(least, floor - step)
