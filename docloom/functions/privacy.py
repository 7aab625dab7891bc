"""Detection and redaction of personal data and secrets; document sensitivity and outbound gates."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# ---- fixed values: checksum weights, sensitivity words and detectors in their order of precedence
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
CLASSIFIED = ("绝密", "机密", "top secret", "classified")
#: Placeholders of kinds that aren't named as the kind is; kinds of one placeholder are numbered together.
PREFIX = {"ID_CARD": "ID", "IPV4": "IP", "IPV6": "IP", "CREDIT_CARD": "CARD", "BANK_CARD": "CARD", "API_KEY": "APIKEY"}
HIGH_RISK = ("ID_CARD", "BANK_CARD", "CREDIT_CARD", "API_KEY")
#: kind, pattern, and the characters that may not stand right before or after a match. Matches are found first and tested after, so a rejected one isn't
#: tried again at another place.
DETECTORS = [
    ("URL", r"https?://[^\s<>\"'一-鿿]+", ""),
    ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", ""),
    ("ID_CARD", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]", "0123456789"),
    ("CREDIT_CARD", r"(?:\d{4}[ \-]?){3}\d{4}", ""),
    ("BANK_CARD", r"\d{16,19}", "0123456789"),
    ("API_KEY", r"sk-(?:ant-api03-)?[A-Za-z0-9_\-]{32,}", ""),
    ("API_KEY", r"gh[posu]_[A-Za-z0-9]{36,}", ""),
    ("API_KEY", r"github_pat_[A-Za-z0-9_]{22,}", ""),
    ("API_KEY", r"glpat-[A-Za-z0-9_\-]{20}", ""),
    ("API_KEY", r"AKIA[0-9A-Z]{16}", ""),
    ("API_KEY", r"xox[baprs]-[A-Za-z0-9\-]{10,}", ""),
    ("API_KEY", r"hf_[A-Za-z0-9]{32,}", ""),
    ("API_KEY", r"AIza[0-9A-Za-z_\-]{35}", ""),
    ("IPV6", r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){2,7}", ""),
    ("IPV4", r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)", "0123456789."),
    ("PHONE", r"(?:\+?86)?1[3-9]\d{9}", "0123456789"),
    ("PLATE", r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][A-Z0-9]{5,6}", ""),
    ("MAC", r"[0-9A-Fa-f]{2}(?:[:\-][0-9A-Fa-f]{2}){5}", ""),
    ("GPS", r"-?\d{1,3}\.\d{2,}\s*,\s*-?\d{1,3}\.\d{2,}", ""),
]
# ---- end of the fixed values
COMPILED = [(k, re.compile(p), beside) for k, p, beside in DETECTORS]
#: What a text must hold for a detector to be worth running; equal expressions are searched once a text.
KEYS, NUMBER = re.compile("sk-|gh[posu]_|github_pat_|glpat-|AKIA|xox|hf_|AIza"), re.compile(r"\d")
GATES = {
    "URL": re.compile("://"), "EMAIL": re.compile("@"), "ID_CARD": re.compile(r"\d{17}"), "CREDIT_CARD": re.compile(r"\d{4}[ \-]?\d{4}"), "BANK_CARD": re.compile(r"\d{16}"), "API_KEY": KEYS,
    "IPV6": re.compile(":[0-9a-fA-F]*:"), "IPV4": re.compile(r"\d\.\d"), "PHONE": re.compile(r"\d{11}"), "PLATE": re.compile("[一-鿿][A-Z]"), "MAC": re.compile("[0-9A-Fa-f][:\\-][0-9A-Fa-f]"), "GPS": re.compile(r"\d\.\d"),
}
NUMERIC = ("ID_CARD", "CREDIT_CARD", "BANK_CARD", "IPV4", "PHONE", "GPS")
LOCAL, DOMAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-", re.compile(r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")


def luhn(value: str) -> bool:
    """Luhn's sum over the ASCII digits of a value that has 13 to 19 of them."""
    digits = [ord(c) - 48 for c in value if "0" <= c <= "9"]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def id_card(value: str) -> bool:
    return value[:17].isascii() and ID_CHECK[sum(int(c) * w for c, w in zip(value, ID_WEIGHTS)) % 11] == value[17].upper()


def ipv6(value: str) -> bool:
    try:
        return ("::" in value or value.count(":") >= 7) and ipaddress.IPv6Address(value).version == 6
    except ValueError:
        return False


def on_earth(value: str) -> bool:
    lat, lon = map(float, value.split(","))
    return abs(lat) <= 90 and abs(lon) <= 180


VALID = {"CREDIT_CARD": luhn, "ID_CARD": id_card, "IPV6": ipv6, "GPS": on_earth}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, from each @ outwards: linear in the text, where a search would start at every letter of a long run."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def matches(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, -end, detector, kind) of every valid match."""
    worth = {KEYS: KEYS.search(text)}
    numbers = NUMBER.search(text)
    for i, (kind, pattern, beside) in enumerate(COMPILED):
        gate = GATES[kind]
        if kind in NUMERIC and not numbers or kind == "PLATE" and text.isascii():
            continue
        if gate not in worth:
            worth[gate] = gate.search(text)
        if not worth[gate]:
            continue
        valid = VALID.get(kind)
        for start, end in emails(text) if kind == "EMAIL" else (m.span() for m in pattern.finditer(text)):
            if beside and (start and text[start - 1] in beside or end < len(text) and text[end] in beside):
                continue
            if valid is None or valid(text[start:end]):
                yield start, -end, i, kind


def find_spans(text: str, own: tuple[tuple[str, re.Pattern], ...] = ()) -> list[dict]:
    """Valid matches in text order; of overlapping ones the earlier wins, then the longer, then the detector listed first; those of ``own`` come last."""
    found = list(matches(text))
    found += [(m.start(), -m.end(), len(COMPILED) + i, k) for i, (k, p) in enumerate(own) for m in p.finditer(text) if m.group()]
    out, end = [], 0
    for start, minus, _, kind in sorted(found):
        if start >= end:
            end = -minus
            out.append({"kind": kind, "start": start, "end": end, "value": text[start:end]})
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))


@pandas_udf(SPANS)
def detect(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: find_spans(t) if t else [])


def detect_with(dictionary: list[dict]):
    """``detect`` with a user's dictionary: entries of a name and literals, a regex, or both; a pattern that doesn't compile raises here. Names
    are the spans' kinds, in capitals."""
    own = []
    for e in dictionary:
        parts = [re.escape(x) for x in sorted(e.get("literals") or [], key=len, reverse=True) if x]
        own += [(e["name"].upper(), re.compile("|".join(parts)))] if parts else []
        own += [(e["name"].upper(), re.compile(e["regex"]))] if e.get("regex") else []
    fixed = tuple(own)

    @pandas_udf(SPANS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: find_spans(t, fixed) if t else [])

    return run


def span_counts(spans: Column) -> Column:
    """Redaction statistics: map of kind to number of spans."""
    kinds = F.transform(spans, lambda s: s["kind"])
    return F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


def placeholders(spans: list) -> list[str]:
    """Numbered by prefix in order of first appearance; equal values share a number."""
    seen: dict[str, dict[str, int]] = {}
    out = []
    for s in spans:
        prefix = PREFIX.get(s["kind"], s["kind"])
        known = seen.setdefault(prefix, {})
        out.append(f"[{prefix}_{known.setdefault(s['value'], len(known) + 1)}]")
    return out


@pandas_udf(T.StringType())
def redact(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text, found):
        if text is None or found is None or not len(found):
            return text
        out, at = [], 0
        for s, name in zip(found, placeholders(found)):
            out += [text[at : s["start"]], name]
            at = s["end"]
        return "".join([*out, text[at:]])

    return pd.Series([one(t, f) for t, f in zip(texts, spans)])


def restore(text: Column, pairs: Column) -> Column:
    """Placeholders back to their originals, the longest first; pairs: array of (placeholder, original)."""
    longest = F.array_sort(pairs, lambda a, b: F.length(b["placeholder"]) - F.length(a["placeholder"]))
    return F.aggregate(longest, text, lambda t, p: F.replace(t, p["placeholder"], p["original"]))


def sensitivity(text: Column, kinds: Column) -> Column:
    """Classified by a keyword, SensitivePartial from five high-risk matches, else Normal."""
    risky = F.size(F.filter(kinds, lambda k: k.isin(*HIGH_RISK)))
    return F.when(F.lower(text).rlike("|".join(CLASSIFIED)), "Classified").when(risky >= 5, "SensitivePartial").otherwise("Normal")


def outbound(level: Column) -> Column:
    return F.when(level == "Classified", "block").otherwise("redact")


def licence_checksum(code: Column) -> Column:
    """Whether an 18-character unified credit code carries its right check character."""
    letters = "0123456789ABCDEFGHJKLMNPQRTUWXY"
    value = lambda c: F.call_function("instr", F.lit(letters), c) - 1
    weighted = F.transform(F.split(F.substring(code, 1, 17), ""), lambda c, i: value(c) * F.pmod(F.pow(F.lit(3.0), i).cast("long"), F.lit(31)).cast("int"))
    check = F.pmod(F.lit(31) - F.pmod(F.aggregate(weighted, F.lit(0), lambda a, b: a + b), F.lit(31)), F.lit(31))
    return code.rlike(f"^[{letters}]{{18}}$") & (value(F.substring(code, 18, 1)) == check)
