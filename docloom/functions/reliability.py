"""Checks of a reply against the chunks it was made from: citations, contradicted values, values that no chunk holds, confidence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.functions.entities import find_entities

# ---- fixed values: marker of a citation, ignored punctuation, weights, names and severities of unsupported values
MARKER = re.compile(r"\[(?:item|source|doc):([A-Za-z0-9_\-]{1,128})\]")
PUNCTUATION = ",.!?;:'\"()[]{}，。！？；：“”‘’（）【】《》"
MIN_SHARED, REACH = 3, 48
CITATION, CONTRADICTION, HALLUCINATION = 0.20, 0.50, 0.30
UNSUPPORTED = {"date": ("date", "high"), "money": ("number", "high"), "organization": ("organization", "high"), "person": ("person", "medium")}



def rows_of(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


REPORT = T.StructType(
    [
        T.StructField("citations", rows_of("item_id", "status")),
        T.StructField("contradictions", rows_of("kind", "response_value", "chunk_value", "item_id")),
        T.StructField("hallucinations", rows_of("kind", "token", "severity")),
        T.StructField("confidence", T.DoubleType()),
    ]
)
HAN = "一-鿿㐀-䶿"


def normalized(text: str) -> str:
    """Lower-cased, without punctuation, runs of white space as one blank."""
    return re.sub(r"\s+", " ", text.translate({ord(c): None for c in PUNCTUATION}).lower()).strip()


def token_set(text: str) -> set[str]:
    """Words of three characters or more with an ASCII letter or digit, and all pairs of neighbouring Han characters."""
    flat = normalized(text)
    words = {w for w in re.split(r"[\s\-/_]+", flat) if len(w) >= 3 and re.search("[a-z0-9]", w)}
    return words | {run[i : i + 2] for run in re.findall(f"[{HAN}]+", flat) for i in range(len(run) - 1)}


def around(text: str, entity: dict) -> set[str]:
    """Tokens of up to REACH bytes on either side of an entity, whole characters only."""
    raw = text.encode()
    start, end = max(0, entity["byte_start"] - REACH), min(len(raw), entity["byte_end"] + REACH)
    while start and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return token_set(raw[start:end].decode())


def check_reply(reply: str | None, chunks: list[tuple[str, str]]) -> dict:
    """Report on one reply; chunks: (item_id, text). A citation is grounded from MIN_SHARED shared tokens on, else weak, and fabricated if no chunk
    has its id. A date or amount contradicts another one of a chunk whose surroundings share a token. A value is unsupported if no chunk holds it."""
    if not reply or not reply.strip():
        return {"citations": [], "contradictions": [], "hallucinations": [], "confidence": 0.5}
    chunks = [(i, t or "") for i, t in chunks]
    own, by_id = token_set(reply), {}
    for i, t in chunks:
        by_id.setdefault(i, t)
    citations = []
    for cited in dict.fromkeys(MARKER.findall(reply)):
        shared = len(own & token_set(by_id[cited])) if cited in by_id else -1
        citations.append({"item_id": cited, "status": "fabricated" if shared < 0 else "grounded" if shared >= MIN_SHARED else "weak_overlap"})
    values = find_entities(reply)
    known = [(i, e["kind"], e["value"], around(t, e)) for i, t in chunks for e in find_entities(t)] if values else []
    contradictions = []
    for kind in ("date", "money"):
        for e in (v for v in values if v["kind"] == kind):
            near = around(reply, e)
            contradictions += [{"kind": kind, "response_value": e["value"], "chunk_value": v, "item_id": i} for i, k, v, other in known if k == kind and v != e["value"] and near & other]
    held = " ".join(normalized(t) for _, t in chunks)
    hallucinations = [dict(zip(("kind", "severity"), UNSUPPORTED[k]), token=v) for v, k in {e["value"]: e["kind"] for e in reversed(values)}.items() if len(v) >= 2 and normalized(v) not in held][::-1]
    bad = sum({"grounded": 0, "weak_overlap": 1, "fabricated": 2}[c["status"]] for c in citations)
    lost = CITATION * min(1.0, bad / len(citations)) if citations else 0.0
    lost += CONTRADICTION * min(1.0, len(contradictions) / 2) + HALLUCINATION * min(1.0, len(hallucinations) / 4)
    return {"citations": citations, "contradictions": contradictions, "hallucinations": hallucinations, "confidence": round(min(1.0, max(0.0, 1.0 - lost)), 6)}


@pandas_udf(REPORT)
def reliability(replies: pd.Series, chunks: pd.Series) -> pd.DataFrame:
    """Reports for a column of replies and one of array<struct<item_id, text>>."""
    reports = [check_reply(r, [(c["item_id"], c["text"]) for c in (cs if cs is not None else [])]) for r, cs in zip(replies, chunks)]
    return pd.DataFrame(reports, columns=["citations", "contradictions", "hallucinations", "confidence"])
