"""File, feed and mail sources: every reader is a Spark scan with a parse step, and gives path, title, content."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.functions import text as tx

#: Largest office archive that is opened, in bytes.
ARCHIVE_LIMIT = 64 << 20
LFS_MARK = "version https://git-lfs.github.com/spec/"


def scan_folder(spark: SparkSession, path: str, extensions: list[str], recursive: bool = True, most_bytes: int | None = None) -> DataFrame:
    """Files of a folder with the allowed extensions: path, modificationTime, length, content, content_hash; larger files are left out by
    the scan's own metadata filter, before their bytes are read."""
    pattern = "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    files = files if most_bytes is None else files.where(F.col("length") <= most_bytes)
    return files.withColumn("content_hash", F.sha2("content", 256))


def is_binary(content: Column, head: int = 8000) -> Column:
    return F.contains(F.hex(F.substring(content, 1, head)), F.lit("00")) & F.hex(F.substring(content, 1, head)).rlike("^(?:..)*?00")


def is_lfs_pointer(content: Column) -> Column:
    return F.startswith(content.cast("string"), F.lit(LFS_MARK))


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: ** crosses folders, * and ? don't, {a,b} is a choice."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{":
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, pattern[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def globbed(path: Column, include: list[str], exclude: list[str]) -> Column:
    hit = lambda globs: F.array_contains(F.array(*[path.rlike(glob_regex(g)) for g in globs]), True)
    ok = hit(include) if include else F.lit(True)
    return ok & ~hit(exclude) if exclude else ok


#: Largest file and largest whole tree that ``git_tree`` takes, in bytes.
TREE_FILE_BYTES, TREE_BYTES = 5 << 20, 500 << 20


def git_tree(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), most_bytes: int = TREE_FILE_BYTES, most_total: int = TREE_BYTES) -> DataFrame:
    """Text files of a checked-out tree: path, rel (below ``root``), length, modificationTime, content, content_hash.

    A tree of more than ``most_total`` bytes, its .git folder aside, is refused by its metadata, before a file is read. Files above ``most_bytes``, those that the
    globs leave out, binary ones, pointers to large files, and paths with a .. in them are left out. Spark's listing skips names that begin with a dot or an underscore."""
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.element_at(F.split("path", re.sub(r"([^A-Za-z0-9/])", r"\\\1", base), 2), 2)
    own = files.withColumn("rel", rel).where(F.col("rel").isNotNull() & ~F.col("rel").rlike(r"(^|/)(\.git|\.\.)(/|$)"))
    total = own.agg(F.sum("length")).first()[0] or 0
    if total > most_total:
        raise ValueError(f"the tree has {total} bytes, more than {most_total}: take a folder of it")
    kept = own.where((F.col("length") <= most_bytes) & globbed(F.col("rel"), list(include), list(exclude)))
    text = kept.where(~is_binary(F.col("content")) & ~is_lfs_pointer(F.col("content")))
    return text.select("path", "rel", "length", "modificationTime", "content", F.sha2("content", 256).alias("content_hash"))


def diff_snapshots(old: DataFrame, new: DataFrame, stat: list[str] | None = None) -> DataFrame:
    """(path, status) of two snapshots with path and content_hash: new, updated, skipped or deleted. Where all ``stat`` columns agree,
    null-safely, the hashes needn't be compared."""
    o = old.select("path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("had"), *[F.col(c).alias(f"old_{c}") for c in stat or []])
    n = new.select("path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("has"), *[F.col(c).alias(f"new_{c}") for c in stat or []])
    same = F.col("old_hash").eqNullSafe(F.col("new_hash"))
    if stat:
        fast = F.lit(True)
        for c in stat:
            fast = fast & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
        same = fast | same
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "deleted").when(same, "skipped").otherwise("updated")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def removed_items(old: DataFrame, new: DataFrame, references: DataFrame) -> DataFrame:
    """Items of files that are gone and that no other source refers to."""
    return old.join(new, "path", "left_anti").join(references, "item_id", "left_anti")


def read_text(spark: SparkSession, path: str, suffix: str = "*.{txt,md,csv}") -> DataFrame:
    """Plain, Markdown and CSV files as whole texts; the title is the first level-one heading or the first line."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=suffix, recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("path"), tx.markdown_title(F.col("value")).alias("title"), F.col("value").alias("content"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{html,htm}", recursiveFileLookup=True)
    return files.select(F.input_file_name().alias("path"), tx.html_title(F.col("value")).alias("title"), tx.html_text(F.col("value")).alias("content"))


def _rtf_chars(text: str) -> str:
    """Characters of RTF's \\'xx (Windows-1252) and \\uN with its one substitute; pairs of surrogates are one character."""
    text = re.sub(r"\\u(-?\d{1,5}) ?(?:\\'[0-9a-fA-F]{2}|[^\\{}])?", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@pandas_udf(T.StringType())
def rtf_chars(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _rtf_chars(t))


def strip_rtf(text: Column) -> Column:
    out = F.regexp_replace(text, r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "")
    out = F.regexp_replace(out, r"\\(?:par|line)\b ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(rtf_chars(out), r"\\[a-zA-Z]+-?[0-9]* ?", ""), r"[{}]", ""))


def page_rows(frame: DataFrame, text: str, mark: str = "\f") -> DataFrame:
    """One row a page of an extracted text."""
    return frame.select("*", F.posexplode(F.split(text, mark)).alias("page", "page_text"))


def _feed_entries(raw: str) -> list[dict]:
    if "<!DOCTYPE" in raw or "<!ENTITY" in raw:
        return []
    if raw.lstrip().startswith("{"):
        import json

        return [
            {"guid": str(x.get("id") or x.get("url") or ""), "title": x.get("title") or "", "link": x.get("url") or "", "body": x.get("content_html") or x.get("content_text") or x.get("summary") or ""}
            for x in json.loads(raw).get("items", [])
        ]
    try:
        root = ElementTree.fromstring(raw.encode())
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for entry in root.iter():
        if local(entry) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in entry:
            value = (child.text or "").strip() or child.get("href", "")
            got.setdefault("content" if child.tag.endswith("encoded") else local(child), value)
        link = got.get("link", "")
        out.append({"guid": got.get("guid") or got.get("id") or link, "title": got.get("title", ""), "link": link, "body": got.get("content") or got.get("description") or got.get("summary") or ""})
    return out


@pandas_udf(T.ArrayType(T.StructType([T.StructField("guid", T.StringType()), T.StructField("title", T.StringType()), T.StructField("link", T.StringType()), T.StructField("body", T.StringType())])))
def feed_entries(feeds: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Entries of RSS, Atom and JSON feeds; the guid falls back to the link, the body to the summary; feeds with a DTD have none."""
    for batch in feeds:
        yield batch.map(lambda x: _feed_entries(x) if x else [])


def read_feeds(feeds: DataFrame, column: str = "value") -> DataFrame:
    entries = feeds.select(F.explode(feed_entries(F.col(column))).alias("e")).select("e.*")
    return entries.withColumn("content", tx.html_text(F.col("body"))).drop("body")


def _mail(raw: bytes) -> dict:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    plain, html, files = [], [], []
    for part in message.walk():
        if part.is_multipart():
            continue
        if part.get_filename():
            files.append(part.get_filename())
        elif part.get_content_type() == "text/plain":
            plain.append(part.get_content())
        elif part.get_content_type() == "text/html":
            html.append(part.get_content())
    return {"subject": str(message["subject"] or ""), "sender": str(message["from"] or ""), "plain": "\n".join(plain), "html": "\n".join(html), "attachments": files}


@pandas_udf(T.StructType([T.StructField("subject", T.StringType()), T.StructField("sender", T.StringType()), T.StructField("plain", T.StringType()), T.StructField("html", T.StringType()), T.StructField("attachments", T.ArrayType(T.StringType()))]))
def parse_mail(raw: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in raw:
        yield pd.DataFrame([_mail(x) for x in batch], columns=["subject", "sender", "plain", "html", "attachments"])


def read_mail(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("pdf", "docx", "txt", "md")) -> DataFrame:
    """RFC 822 files: the plain body where there is one, else the text of the HTML body; attachment names by allowed extension."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(path)
    parsed = raw.select("path", parse_mail("content").alias("m"))
    plain = F.btrim("m.plain", F.lit(" \t\r\n"))
    body = F.when(plain != "", plain).otherwise(tx.html_text(F.col("m.html")))
    names = F.filter("m.attachments", lambda a: F.lower(F.substring_index(a, ".", -1)).isin(*allowed))
    return parsed.select("path", F.col("m.subject").alias("title"), F.col("m.sender").alias("sender"), body.alias("content"), names.alias("attachments"))


# ---- fixed values: attachments that are read, and the largest one
ATTACHED = ("md", "txt", "py", "js", "ts", "rs", "go", "java", "pdf", "docx", "html", "htm", "csv", "rtf")
ATTACHMENT_BYTES = 20 << 20


@pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])))
def attached(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Name and bytes of a message's attachments, those above ATTACHMENT_BYTES aside."""
    for batch in raw:
        rows = []
        for data in batch:
            parts = [p for p in email.message_from_bytes(data, policy=email.policy.default).walk() if not p.is_multipart() and p.get_filename()] if data else []
            found = [{"name": p.get_filename(), "content": p.get_payload(decode=True) or b""} for p in parts]
            rows.append([x for x in found if len(x["content"]) <= ATTACHMENT_BYTES])
        yield pd.Series(rows)


def mail_attachments(spark: SparkSession, path: str, allowed: tuple[str, ...] = ATTACHED) -> DataFrame:
    """Attachments of RFC 822 files as files of their own: path (of the message), name, content (bytes); ``parsed`` makes them documents."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(path)
    each = raw.select("path", F.explode(attached("content")).alias("a")).select("path", "a.name", "a.content")
    return each.where(F.lower(F.substring_index("name", ".", -1)).isin(*allowed))


OFFICE, MARKUP = ("docx", "xlsx", "pptx", "epub"), ("html", "htm")


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (name, content as bytes, and any other columns) with title, text and status by the name's extension: office archives, HTML, RTF, anything else as plain text.
    Bytes that are no text, such as PDF and images, are ``binary`` and have no text; a model or a service reads those."""
    kind = F.lower(F.substring_index("name", ".", -1))
    office = office_text(F.when(kind.isin(*OFFICE), F.col("content")))
    plain = F.col("content").cast("string")
    out = files.withColumn("__o", office).withColumn("__binary", ~kind.isin(*OFFICE) & (kind.isin("pdf") | is_binary(F.col("content"))))
    text = F.when(kind.isin(*OFFICE), F.col("__o.text")).when(F.col("__binary"), "").when(kind.isin(*MARKUP), tx.html_text(plain)).when(kind == "rtf", strip_rtf(plain)).otherwise(plain)
    title = F.when(kind.isin(*MARKUP), tx.html_title(plain)).when(kind.isin(*OFFICE) | (kind == "rtf") | F.col("__binary"), F.col("name")).otherwise(tx.markdown_title(plain))
    status = F.when(kind.isin(*OFFICE), F.col("__o.status")).when(F.col("__binary"), "binary").otherwise("ok")
    return out.select(*files.columns, title.alias("title"), F.coalesce(text, F.lit("")).alias("text"), status.alias("status")).drop("__o", "__binary")


def newer_than(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages above their folder's high-water mark; a folder without one is read from the start."""
    return messages.join(cursors.select("folder", "last_uid"), "folder", "left").where(F.col("uid") > F.coalesce("last_uid", F.lit(0))).drop("last_uid")


def advanced(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    tops = messages.groupBy("folder").agg(F.max("uid").alias("last_uid")).unionByName(cursors.select("folder", "last_uid"))
    return tops.groupBy("folder").agg(F.max("last_uid").alias("last_uid"))


def _office(raw: bytes) -> tuple[str, str]:
    """(text, status) of a zipped office or e-book file: paragraphs, cells, slides or chapters in order, and ok; '' with too_large beyond the size guard, or broken."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        if sum(i.file_size for i in z.infolist()) > ARCHIVE_LIMIT:
            return "", "too_large"
        return _office_text(z), "ok"
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, zlib.error, EOFError):
        return "", "broken"


def _office_text(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    order = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    if "word/document.xml" in names:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter() if local(t) == "t") for p in root.iter() if local(p) == "p")
    if "xl/workbook.xml" in names:
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(s) == "si"]
        lines = []
        for n in sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml", n)), key=order):
            for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if local(r) == "row"):
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c.iter() if local(x) in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                lines.append("\t".join(cells))
        return "\n".join(lines)
    slides = sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml", n)), key=order)
    if slides:
        return "\n\n".join("\n".join(t.text or "" for t in ElementTree.fromstring(z.read(n)).iter() if local(t) == "t") for n in slides)
    chapters = sorted((n for n in names if n.endswith((".xhtml", ".html", ".htm"))), key=order)
    return "\n\n".join(re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", z.read(n).decode("utf-8", "replace"))).strip() for n in chapters)


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType())]))
def office_text(raw: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Text and status (ok, empty, too_large, broken) of DOCX, XLSX, PPTX and EPUB bytes."""
    for batch in raw:
        yield pd.DataFrame([_office(x) if x else ("", "empty") for x in batch], columns=["text", "status"])


def read_office(spark: SparkSession, path: str) -> DataFrame:
    files = scan_folder(spark, path, ["docx", "xlsx", "pptx", "epub"], most_bytes=ARCHIVE_LIMIT)
    return files.select("path", F.substring_index("path", "/", -1).alias("title"), office_text("content").alias("o")).select("path", "title", F.col("o.text").alias("content"), F.col("o.status").alias("status"))


def watch_folder(spark: SparkSession, path: str, suffix: str = "*.{txt,md}") -> DataFrame:
    """New text files of a folder as a stream of whole texts."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", suffix).load(path)
    return files.select(F.col("value").alias("content"), F.current_timestamp().alias("seen_at"))
