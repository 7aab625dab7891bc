"""Cross-site line dedup: HyperLogLog sketches of the sites of each line, exact counts near the threshold, boilerplate removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import let, meet, row_key, stored

BLANKS = " \t\r\f\v"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def lines_of(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(key, page, n_long, pos, line, site): the \\n-split lines of at least ``min_chars`` characters without outer blanks, as hashes. page is the
    hash of all these lines of the text in order, n_long their number."""
    found = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("pos"), trimmed(x).alias("line")))
    found = F.transform(F.filter(found, lambda s: F.length(s["line"]) >= min_chars), lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["line"]).alias("line")))
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(site_col).alias("site"), found.alias("found"))
    page = F.xxhash64(F.transform("found", lambda s: s["line"]))
    return texts.select("key", "site", page.alias("page"), F.size("found").alias("n_long"), F.explode("found").alias("s")).select("key", "page", "n_long", "s.pos", "s.line", "site")


def boilerplate(lines: DataFrame, min_sites: int, precision: int = 12, margin: float = 0.25) -> DataFrame:
    """(line, n): hash and number of rows of the lines found on ``min_sites`` distinct sites or more.

    One sketch per line merges over all partitions; its error at this precision is about 1.6 %, so only lines whose estimate
    lies within ``margin`` of the threshold need an exact distinct count, and those alone are counted."""
    sketch = lines.groupBy("line").agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(precision))).alias("sites"))
    spread = stored(sketch.where(F.col("sites") >= min_sites * (1 - margin)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("line", "n")
    pairs = meet(lines.select("line", "site", "key"), near, "line", F.col("key")).select("line", "site").distinct()
    exact = pairs.groupBy("line").agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites).select("line")
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("line", "n")
    return stored(sure.union(near.join(exact, "line", "left_semi")), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = 8, min_chars: int = 12, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", keep_copies: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus n_lines and n_removed (long).

    Boilerplate is a line of ``min_chars`` characters or more (outer blanks aside) on at least ``min_sites`` distinct sites. A page
    that was copied to so many sites is all boilerplate by this rule; with ``keep_copies`` a text all of whose lines of that length would go
    stays as it is if another document has the same lines in the same order, so that near-duplicate removal can keep one of them.
    Null texts stay null with n_lines 0; empty texts stay empty with n_lines 1; a null site counts for none. Repeated rows are treated alike
    and count once. Texts of any length and number of lines are treated alike. Existing columns n_lines and n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = stored(lines_of(docs, min_chars, id_col, text_col, site_col), "lines")
    marked = meet(lines.select("line", "key", "pos", "page", "n_long"), boilerplate(lines, min_sites), "line", F.col("key"), "left_semi")
    gone = marked.groupBy("key").agg(F.collect_set("pos").alias("__gone"), F.first("page").alias("page"), F.first("n_long").alias("n_long"))
    if keep_copies:
        gone = stored(gone, "gone")
        whole = F.size("__gone") == F.col("n_long")
        pages = stored(gone.where(whole).groupBy("page").agg(F.count("*").alias("n")).where("n > 1"), "pages")
        gone = meet(gone.where(whole), pages.withColumn("copied", F.lit(True)), "page", F.col("key"), "left").where("copied is null").select("key", "__gone").union(gone.where(~whole).select("key", "__gone"))
    joined = docs.withColumn("__key", row_key(id_col, text_col)).join(gone.select(F.col("key").alias("__key"), "__gone"), "__key", "left")
    kept = let(F.split(text_col, "\n"), lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda i: F.get(parts, i)))
    counts = [F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed")]
    swapped = F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return joined.select(*[swapped.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *counts)
