"""Scalar text functions as native column expressions, and the few sequential ones as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# ---- fixed values: sizes, marks and coefficients that results depend on
CHUNK_SIZE, CHUNK_OVERLAP, SECTION_SIZE = 512, 128, 1500
SENTENCE_MARKS = "。.!?\n！？"
CODE_HEADS = ("pub fn ", "fn ", "def ", "class ", "impl ")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_key(text: Column) -> Column:
    """Letters and digits of a title, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def half_width(text: Column) -> Column:
    """Full-width ASCII forms and the ideographic space as their half-width characters."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
    return F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def term_key(text: Column) -> Column:
    """Half width, lower case, one space between words, no outer punctuation."""
    return F.regexp_replace(collapse_space(F.lower(half_width(text))), r"^[\p{P}\p{S}\s]+|[\p{P}\p{S}\s]+$", "")


def sanitize_query(text: Column) -> Column:
    return collapse_space(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "))


def language(text: Column) -> Column:
    """zh if Han makes up 30 % of the non-space characters, en if ASCII letters make up 70 %, else mixed."""
    dense = F.regexp_replace(text, r"\s", "")
    n = F.length(dense)
    han = n - F.length(F.regexp_replace(dense, r"[\x{4E00}-\x{9FFF}]", ""))
    ascii_letters = n - F.length(F.regexp_replace(dense, "[A-Za-z]", ""))
    return F.when(n == 0, "mixed").when(han >= 0.3 * n, "zh").when(ascii_letters >= 0.7 * n, "en").otherwise("mixed")


def token_estimate(text: Column, cjk: float = 0.6, other: float = 0.25) -> Column:
    """Estimated model tokens: Han and other characters by their own coefficient, rounded up."""
    han = F.length(text) - F.length(F.regexp_replace(text, r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]", ""))
    return F.ceil(F.round(han * cjk + (F.length(text) - han) * other, 6)).cast("long")


def context_tokens(text: Column) -> Column:
    """Context estimate: 120 hundredths a non-ASCII character, 25 an ASCII one, rounded up."""
    ascii_chars = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.ceil((120 * (F.length(text) - ascii_chars) + 25 * ascii_chars) / 100).cast("long")


def needs_ocr(text: Column, least: int = 100) -> Column:
    return F.length(F.regexp_replace(text, r"\s", "")) < least


def url_domain(url: Column) -> Column:
    """Host of a URL in lower case: what follows :// up to the next slash or colon."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", -1)).otherwise(url)
    return F.lower(F.regexp_extract(rest, r"^([^/:?#]*)", 1))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, white space removed; two empty texts are equal."""
    x, y = F.regexp_replace(a, r"\s", ""), F.regexp_replace(b, r"\s", "")
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def safe_cell(text: Column) -> Column:
    """A spreadsheet cell that can't start a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_name(text: Column) -> Column:
    """A file name without characters that file systems forbid; empty becomes 'untitled'."""
    clean = F.trim(F.regexp_replace(text, r'[\x00-\x1f<>:"/\\|?*]', "_"))
    return F.when(F.length(clean) == 0, "untitled").otherwise(F.substring(clean, 1, 120))


def html_text(html: Column) -> Column:
    """Visible text of a page: script, style and comments dropped, tags become spaces, five entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse_space(out)


def html_title(html: Column) -> Column:
    return collapse_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def markdown_title(text: Column) -> Column:
    """First level-one heading, else the first line, at most 100 characters."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1))
    return F.when(heading != "", heading).otherwise(F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, 100))


def preview(text: Column) -> Column:
    """First line with text, up to the end of its first sentence; an ASCII full stop doesn't end one."""
    line = F.trim(F.regexp_extract(text, r"(?m)^\s*(\S.*)$", 1))
    sentence = F.regexp_extract(line, "^(.*?[。!?！？])", 1)
    return F.when(sentence != "", sentence).otherwise(line)


def line_kind(line: Column, path: Column) -> Column:
    """Kind of an outline line, by the first rule that holds."""
    t, low = F.trim(line), F.lower(F.trim(line))
    toc = low.isin("table of contents", "contents") | (F.contains(t, F.lit("....")) & t.rlike(r"(?:^|\s)[0-9]+$"))
    heading = (F.octet_length(t) <= 120) & ~t.rlike(r"[;{}]$") & (t.rlike(r"^#{1,6}\s+\S") | t.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+[\p{Lu}\p{Lo}]"))
    return (
        F.when(toc, "toc").when(heading, "section")
        .when(F.lower(path).rlike("troubleshoot|故障") | low.rlike("^(error|warning|symptom|cause|solution)[: ]"), "troubleshooting")
        .when(t.rlike(r"^(GET|POST|PUT|PATCH|DELETE)\s+/"), "api_reference")
        .when(t.rlike(r"^([0-9]+[.)]|[-*]|step\s+[0-9]+)\s"), "procedure_step")
        .when(t.rlike(r"^(\$|>|#!|sudo |git |cargo |pip |npm |docker )"), "command")
        .when(t.rlike(r"^[A-Za-z_][\w.-]*\s*[=:]\s*\S"), "config")
        .when(t.rlike(r"^\|.*\|$|\t.*\t"), "table_row")
        .otherwise("paragraph")
    )


def query_intent(query: Column) -> Column:
    """summary, comparison, lookup, diagnostic or general, by the first keyword list that matches."""
    q = F.lower(query)
    return (
        F.when(q.rlike("总结|概括|摘要|summary|summarize|overview"), "summary")
        .when(q.rlike("对比|区别|差异|compare|contrast|difference"), "comparison")
        .when(q.rlike("查找资料|查找手册|引用来源|source lookup|manual lookup|locate source|locate manual"), "lookup")
        .when(q.rlike("排查|故障|诊断|不通|修复|解决|error|fail|fix|troubleshoot|diagnos"), "diagnostic")
        .otherwise("general")
    )


def is_precise(query: Column) -> Column:
    """Whether a query holds a quoted phrase, an identifier, a path or a digit."""
    return query.rlike(r'[`"“/._0-9]|\(\)|::')


def fence_marks(text: str) -> list[int]:
    return [m.start() for m in re.finditer("```", text)]


def chunk_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Sliding windows of ``size`` characters: they end at a sentence mark within their last 50 characters, keep code fences whole where
    that takes at most ``size`` characters more, and overlap. A text of at most ``size`` bytes is one chunk."""
    overlap = min(overlap, max(size - 1, 0))
    if len(text.encode()) <= size:
        return [text]
    marks, out, start, n = fence_marks(text), [], 0, len(text)
    inside = lambda a, b: [m for m in marks if a <= m and m + 3 <= b]

    def line_end(at: int, limit: int) -> int:
        cut = text.find("\n", at, limit)
        return limit if cut < 0 else cut + 1

    while start < n:
        if start and len(inside(0, start)) % 2:  # never start inside an open fence
            nxt = next((m for m in marks if m >= start), None)
            start = start if nxt is None else line_end(nxt + 3, n)
            if start >= n:
                break
        end = min(start + size, n)
        stop = end
        if end < n:
            spot = max((text.rfind(c, max(start, end - 50), end) for c in SENTENCE_MARKS), default=-1)
            stop = spot + 1 if spot >= 0 else end
        here = inside(start, stop)
        if len(here) % 2:
            limit = min(stop + size, n)
            close = next((m for m in marks if m >= stop and m + 3 <= limit), None)
            if close is not None:
                stop = line_end(close + 3, limit)
            else:
                back = text.rfind("\n", start, here[-1]) + 1
                stop = back if back > start else stop
        piece = text[start:stop]
        if piece.strip():
            out.append(piece)
        if stop >= n:
            break
        start = max(stop - overlap, start + 1)
    return out


def sections_of(text: str, target: int = SECTION_SIZE) -> list[dict]:
    """Sections by Markdown and code headings with their heading path; a section of ``target`` bytes or more also ends at a blank line.
    Lines end at a line feed alone; those in code fences are never headings."""
    out, lines, stack, path, fenced, size = [], [], [], [], False, 0

    def close() -> None:
        nonlocal lines, size
        body = "".join(lines)
        if body.strip():
            out.append({"section_idx": len(out), "path": path, "content": body})
        lines, size = [], 0

    rows = re.split(r"\r?\n", text)
    for line in rows if rows[-1] else rows[:-1]:
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        depth, title = 0, ""
        if not fenced:
            if m := re.match(r"(#{1,6}) (.*\S)", line):
                depth, title = len(m[1]), m[2].strip()
            elif line.startswith(CODE_HEADS):
                depth, title = 1, line.strip()
        if depth:
            close()
            stack = [*stack[: depth - 1], title]
            path = list(stack)
        lines.append(line + "\n")
        size += len(line.encode()) + 1
        if not depth and not fenced and size >= target and not line.strip():
            close()
    close()
    return out


#: Characters, and rows, of the texts that a function answers at once.
PIECE, PIECE_ROWS = 1 << 20, 1000


def pieces(*batch: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """A batch's columns, cut where their texts reach PIECE characters: what a function makes of a batch then is not held as a whole, however long its texts are."""
    start = size = 0
    for at, row in enumerate(zip(*batch)):
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= PIECE or at + 1 - start >= PIECE_ROWS:
            yield tuple(c.iloc[start : at + 1] for c in batch)
            start, size = at + 1, 0
    if start < len(batch[0]) or not len(batch[0]):
        yield tuple(c.iloc[start:] for c in batch)


@pandas_udf(T.ArrayType(T.StringType()))
def chunks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sliding-window chunks of each text; null and empty texts have none."""
    for batch in texts:
        for (piece,) in pieces(batch):
            yield piece.map(lambda t: chunk_text(t) if t else [])


@pandas_udf(T.ArrayType(T.StructType([T.StructField("section_idx", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("content", T.StringType())])))
def sections(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sections of each text with their heading path."""
    for batch in texts:
        for (piece,) in pieces(batch):
            yield piece.map(lambda t: sections_of(t) if t else [])


def breadcrumb(path: Column, content: Column) -> Column:
    return F.when(F.size(path) == 0, content).otherwise(F.concat(F.lit("> "), F.array_join(path, " > "), F.lit("\n\n"), content))
