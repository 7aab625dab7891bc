"""Tags, taxonomy checks, suggestions, audits and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_index(items: DataFrame, item: str, tags_json: str) -> DataFrame:
    """(item, dim, val) from a JSON object of arrays; broken JSON has no rows."""
    parsed = F.from_json(tags_json, "map<string,array<string>>")
    return items.select(item, F.explode(parsed).alias("dim", "vals")).select(item, "dim", F.explode("vals").alias("val")).distinct()


def taxonomy_violations(index: DataFrame, item: str, required: list[str], single: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """(item, dim, problem): missing required dimensions, several values in single-valued ones, values that aren't allowed."""
    items = index.select(item).distinct()
    need = items.withColumn("dim", F.explode(F.array(*map(F.lit, required)))) if required else items.limit(0).withColumn("dim", F.lit(""))
    missing = need.join(index.select(item, "dim").distinct(), [item, "dim"], "left_anti").withColumn("problem", F.lit("missing"))
    many = index.where(F.col("dim").isin(*single)).groupBy(item, "dim").agg(F.countDistinct("val").alias("n")).where("n > 1").select(item, "dim", F.lit("several").alias("problem"))
    out = missing.unionByName(many)
    for dim, values in allowed.items():
        wrong = index.where((F.col("dim") == dim) & ~F.col("val").isin(*values)).select(item, "dim", F.lit("value").alias("problem")).distinct()
        out = out.unionByName(wrong)
    return out


def suggestions(cards: list[DataFrame], dismissed: DataFrame, muted: DataFrame) -> DataFrame:
    """Suggestion cards (kind, signature, weight) of all rules, without dismissed signatures and muted kinds, once each."""
    out = cards[0]
    for c in cards[1:]:
        out = out.unionByName(c)
    once = out.groupBy("kind", "signature").agg(F.max("weight").alias("weight"))
    return once.join(dismissed, ["kind", "signature"], "left_anti").join(muted, "kind", "left_anti").orderBy("kind", "signature")


def ratchet(metrics: DataFrame) -> DataFrame:
    """Metrics whose threshold is looser than the baseline: metric, threshold, baseline, higher_is_better."""
    loose = F.when(F.col("higher_is_better"), F.col("threshold") < F.col("baseline")).otherwise(F.col("threshold") > F.col("baseline"))
    return metrics.where(loose)


def streak_decision(kind: Column, samples: Column, rate: Column, tier: Column, ladder: list[str]) -> Column:
    """For judge-type agents with 20 samples and a failure rate over 0.30: the next tier, or disable at the end of the ladder; else keep."""
    nxt = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in zip(ladder, ladder[1:]) for x in p]), tier), F.lit("disable"))
    return F.when((kind == "llm_judge") & (samples >= 20) & (rate > 0.30), nxt).otherwise("keep")


#: Rows of a report, which one task puts together.
MOST_LINES = 100_000


def markdown_table(frame: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row, column markdown: a table of a report of ``MOST_LINES`` rows at most, an error beyond; pipes are escaped, nulls are empty."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit(r"\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda s: s["line"]), "\n")
    head = "| " + " | ".join(columns) + " |\n|" + "|".join(" --- " for _ in columns) + "|\n"
    report = frame.limit(MOST_LINES + 1).agg(F.count("*").alias("n"), F.concat(F.lit(head), rows).alias("markdown"))
    return report.select(F.when(F.col("n") > MOST_LINES, F.raise_error(F.lit(f"more than {MOST_LINES} rows for a report"))).otherwise(F.col("markdown")).alias("markdown"))


def write_audit_csv(frame: DataFrame, path: str) -> None:
    """RFC 4180 CSV with a header; quotes are doubled and formula starts are defused."""
    safe = [F.when(F.col(c).cast("string").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c) for c in frame.columns]
    frame.select(*safe).write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)


def export_memories(memories: DataFrame, path: str, key: str | None = None) -> None:
    """Memory bundle as JSON lines; with a key (16, 24 or 32 characters) the rows are AES-GCM encrypted."""
    rows = memories.select(F.to_json(F.struct(*memories.columns)).alias("value"))
    if key:
        rows = rows.select(F.hex(F.aes_encrypt("value", F.lit(key), F.lit("GCM"))).alias("value"))
    rows.write.text(path)


def import_memories(existing: DataFrame, bundle: DataFrame, key: str | None = None) -> DataFrame:
    """Rows of a bundle that aren't there yet, by kind and source hashes, in the existing schema."""
    raw = F.aes_decrypt(F.unhex("value"), F.lit(key), F.lit("GCM")).cast("string") if key else F.col("value")
    rows = bundle.select(F.from_json(raw, existing.schema).alias("m")).select("m.*")
    return rows.join(existing, ["kind", "source_hashes"], "left_anti").select(existing.columns)
