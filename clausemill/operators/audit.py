"""Auditing plans and documents: citations, internal references, values in conflict, names, chapters and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.operators.lexical import contained

#: Value rules: name, pattern of the value, least and most, and how grave a conflict is.
VALUE_RULES = (
    ("养护时间", r"养护[^。\n]{0,20}?(?:^|[^0-9.])(\d+)\s*(?:d|天)", 1.0, 90.0, "low"),
    ("压实系数", r"压实系数[^。\n]{0,10}?(?:^|[^0-9.])(0\.\d+)", 0.5, 1.0, "high"),
    ("开挖深度", r"开挖深度[^。\n]{0,10}?(?:^|[^0-9.])?(\d+(?:\.\d+)?\s*(?:mm|m))", 0.1, 50.0, "high"),
    ("灰缝", r"灰缝[^。\n]{0,20}?(?:^|[^0-9.])?(\d+)\s*mm", 1.0, 50.0, "high"),
    ("饱满度", r"饱满度[^。\n]{0,20}?(?:^|[^0-9.])?(\d+)\s*%", 1.0, 100.0, "high"),
    ("成活率", r"成活率[^。\n]{0,20}?(?:^|[^0-9.])?(\d+)\s*%", 1.0, 100.0, "high"),
)


def rule_values(paragraphs: DataFrame, text: str) -> DataFrame:
    """Values that paragraphs give for each rule, depths in metres, those out of range left out."""
    found = None
    for name, pattern, least, most, level in VALUE_RULES:
        raw = F.regexp_extract(text, pattern, 1)
        number = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
        value = F.when(raw.endswith("mm"), number / 1000).otherwise(number)
        part = paragraphs.withColumns({"rule": F.lit(name), "level": F.lit(level), "value": value}).filter((F.col("value") >= least) & (F.col("value") <= most))
        found = part if found is None else found.unionByName(part)
    return found


def value_conflicts(paragraphs: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """Rules for which a document gives more than one value, with the values and places."""
    grouped = rule_values(paragraphs, text).groupBy(key, "rule", "level").agg(F.array_sort(F.collect_set("value")).alias("found"), F.array_sort(F.collect_set(place)).alias("places"))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "|")
    return grouped.filter(F.size("found") > 1).select(key, "rule", "level", joined(F.col("found")).alias("found"), joined(F.col("places")).alias("places"))


def mentions(text: Column) -> Column:
    """Clause numbers that a text refers to."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"第\s*(\d+(?:\.\d+)+)\s*[条款节]"), F.lit(1)))


def broken_references(mentioned: DataFrame, headings: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions (keys) that no heading answers."""
    return mentioned.select(*keys).distinct().join(headings.select(*keys).distinct(), keys, "left_anti")


def citation_verdict(error: Column, status: Column, deleted: Column, notes: Column) -> Column:
    """fail for errors, abolished standards and deleted clauses; warn for notes and standards not in force; else pass."""
    return F.when(error | (status == "abolished") | deleted, "fail").when(notes | F.coalesce(status.isin("superseded", "unknown"), F.lit(True)), "warn").otherwise("pass")


def longest_keyword(rows: DataFrame, key: str, text: str, words: DataFrame, kind: str, most: int = 3) -> DataFrame:
    """Kinds whose longest keyword in a text is the longest of all, ties up to a few."""
    hits = contained(rows.select(key, text), text, words, "word", kind)
    best = hits.groupBy(key, kind).agg(F.max(F.length("word")).alias("score"))
    top = best.withColumn("best", F.max("score").over(Window.partitionBy(key))).filter("score = best")  # one row a kind
    return top.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(kind))).filter(F.col("r") <= most).select(key, kind, "score")


def latest_versions(rows: DataFrame, code: str, year: str, id_: str) -> DataFrame:
    """Rows marked as the latest edition of their code, an older one, or the same edition again."""
    newest = F.max(year).over(Window.partitionBy(code))
    again = F.row_number().over(Window.partitionBy(code, year).orderBy(id_)) > 1
    return rows.withColumn("state", F.when(F.col(year) < newest, "old").when(again, "duplicate").otherwise("latest"))


def first_rule(rows: DataFrame, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The first rule (pattern, label) that fits each text; null where none does."""
    label = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        label = F.when(F.col(text).rlike(pattern), name).otherwise(label)
    return rows.withColumn("label", label)


def tolerance_check(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Files held against their copies: missing, changed in size by more than a hundredth, or in content."""
    both = old.select(key, F.col("size").alias("a"), F.col("digest").alias("da")).join(new.select(key, F.col("size").alias("b"), F.col("digest").alias("db")), key, "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.abs(F.col("a") - F.col("b")) > 0.01 * F.col("a"), "size").when(~F.col("da").eqNullSafe(F.col("db")), "content").otherwise("same")
    return both.select(key, state.alias("state"))
