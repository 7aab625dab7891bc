"""Structure from recognized lines and from HTML: tables, receipts, cards, blocks. Lines: doc, line, text, x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import collapse_space

# ---- fixed values: anchors of receipt fields
ANCHORS = {
    "invoice_no": r"(?i)发票号码|invoice\s*(?:no|number)", "date": r"(?i)开票日期|\bdate\b", "seller": r"(?i)销售方|\bseller\b", "buyer": r"(?i)购买方|\bbuyer\b", "total": r"(?i)价税合计|合计|\btotal\b",
}


def table_rows(lines: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Lines with a row number: a line opens a new row where it overlaps the row above by less than ``overlap`` of its height."""
    order = Window.partitionBy("doc").orderBy("y0", "x0")
    before = F.lag("y1").over(order)
    shared = F.least(before, F.col("y1")) - F.greatest(F.lag("y0").over(order), F.col("y0"))
    new = F.when(before.isNull() | (shared < overlap * (F.col("y1") - F.col("y0"))), 1).otherwise(0)
    return lines.withColumn("__new", new).withColumn("row", F.sum("__new").over(order) - 1).drop("__new")


def table_columns(rows: DataFrame, gap: float) -> DataFrame:
    """Rows with a column number: centres of a document that lie within ``gap`` of each other in a chain are one column."""
    centre = (F.col("x0") + F.col("x1")) / 2
    order = Window.partitionBy("doc").orderBy("__c")
    marked = rows.withColumn("__c", centre).withColumn("__new", F.when(F.col("__c") - F.lag("__c").over(order) > gap, 1).otherwise(0))
    return marked.withColumn("col", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("__c", "__new")


def grid(cells: DataFrame) -> DataFrame:
    """(doc, row, cells): texts of each row by column, those of one cell joined by a space; the first row without a number is the header."""
    cell = cells.groupBy("doc", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"))
    row = cell.groupBy("doc", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "text")))).alias("cells"))
    words = ~F.exists(F.map_values("cells"), lambda t: t.rlike("[0-9]"))
    first = F.min(F.when(words, F.col("row"))).over(Window.partitionBy("doc"))
    return row.withColumn("header", F.coalesce(F.col("row") == first, F.lit(False)))


def receipt_fields(lines: DataFrame) -> DataFrame:
    """(doc, field, value): the text behind an anchor on its line, else the next line; the first anchor of a field wins."""
    after = F.lead("text").over(Window.partitionBy("doc").orderBy("line"))
    out = None
    for field, anchor in ANCHORS.items():
        same = F.trim(F.regexp_replace(F.regexp_extract("text", rf"(?:{anchor})[^:：]*[:：]?\s*(.*)$", 1), r"^[:：\s]+", ""))
        hit = lines.withColumn("after", after).where(F.col("text").rlike(anchor)).select("doc", "line", F.lit(field).alias("field"), F.when(same != "", same).otherwise(F.trim("after")).alias("value"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("doc", "field").agg(F.min_by("value", "line").alias("value"))


def card_fields(lines: DataFrame) -> DataFrame:
    """(doc, field, value) of business cards: each line serves one field, in this order of preference; the shortest free line is the name."""
    kind = (
        F.when(F.col("text").rlike(r"[\w.+-]+@[\w-]+\.[\w.]+"), "email").when(F.col("text").rlike(r"\+?\d[\d ()-]{6,}\d"), "phone")
        .when(F.col("text").rlike(r"(?i)公司|集团|大学|\b(inc|ltd|llc|gmbh|corp|university)\b"), "company").when(F.col("text").rlike(r"(?i)经理|总监|工程师|主任|\b(manager|director|engineer|ceo|cto)\b"), "title")
        .when(F.col("text").rlike(r"(?i)路|街|号|\b(street|road|avenue|st\.|rd\.)"), "address").otherwise("name")
    )
    named = lines.withColumn("field", kind)
    order = F.when(F.col("field") == "name", F.length("text") * 1000 + F.col("line")).otherwise(F.col("line"))
    return named.groupBy("doc", "field").agg(F.min_by("text", order).alias("value"))


def blocks(lines: DataFrame, page_width: float) -> DataFrame:
    """Lines in reading order of two columns with a block kind: title, list, caption, footer or paragraph."""
    column = F.when(F.col("x1") - F.col("x0") > 0.6 * page_width, 0).when(F.col("x0") >= page_width / 2, 2).otherwise(1)
    tall = (F.col("y1") - F.col("y0")) / F.avg(F.col("y1") - F.col("y0")).over(Window.partitionBy("doc"))
    low = F.col("y0") > 0.93 * F.max("y1").over(Window.partitionBy("doc"))
    kind = F.when(tall > 1.4, "title").when(F.col("text").rlike(r"^\s*([-*•]|\d+[.)])\s"), "list").when(F.lower("text").rlike(r"^(figure|table|图|表)\s*\d"), "caption").when(low, "footer").otherwise("paragraph")
    order = Window.partitionBy("doc").orderBy("column", "y0", "x0")
    return lines.withColumn("column", column).withColumn("kind", kind).withColumn("position", F.row_number().over(order))


def html_tables(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, table, row, cells): cell texts of all tables by a plain split on tr and td/th."""
    tables = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1))).alias("table", "t"))
    rows = tables.select(page, "table", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)(<tr\b.*?)(?=<tr\b|</table>)"), F.lit(1))).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</tr>|$)"), F.lit(1)), lambda c: collapse_space(F.regexp_replace(c, "(?s)<[^>]*>", " ")))
    return rows.select(page, "table", "row", cells.alias("cells"))


def scene(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("invoice|receipt|发票|收据"), "receipt").when(low.rlike("card|名片"), "card").when(low.rlike("licen[cs]e|执照"), "licence").when(low.rlike("table|表"), "table").otherwise("document")


def agreement(a: Column, b: Column) -> Column:
    return F.regexp_replace(a, r"\s", "") == F.regexp_replace(b, r"\s", "")
