"""Checks of documents and citations that are put together to one report, and repairs of names and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.functions import support as fn

# Codes as they are written in texts, words that make a foreign standard a mere reference, and units.
CITED = r"((?:GB|JGJ|CJJ|TCECS|CECS|DB\d{2})(?:/T)? \d{4,5}-\d{4})"
NAMED = r"《([^《》\n]{3,60})》" + CITED
REFERENCE_WORDS = "参照|参考|借鉴|类似|例如|如|对比|比照"
BEFORE, BEHIND = 60, 40
VALUE = r"(\d+(?:\.\d+)?\s*(?:mm|cm|km|kN|MPa|kPa|min|kg|m|h|d|%|N|t))"


def plain_code(official: Column) -> Column:
    """GB/T 12345-2010 as GBT12345."""
    return F.regexp_replace(F.regexp_replace(official, r"-\d{4}$", ""), "[/ ]", "")


def cited_codes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Codes that texts cite: key, official, code, and the text's context around the first place of each."""
    found = texts.filter(F.col(text).isNotNull()).select(key, text, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)))).alias("official"))
    at = F.instr(F.col(text), F.col("official"))
    context = F.substr(text, F.greatest(at - BEFORE, F.lit(1)), F.least(at - 1, F.lit(BEFORE)) + F.length("official") + BEHIND)
    return found.select(key, "official", plain_code(F.col("official")).alias("code"), context.alias("context"))


def unknown_codes(cited: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Cited codes that the list doesn't have: key, code."""
    return cited.select(key, "code").distinct().join(listed.select(F.col("standard_code").alias("code")), "code", "left_anti").select(key, "code")


def foreign_regions(cited: DataFrame, key: str, home: Column) -> DataFrame:
    """Local standards of another region than a text's own, unless words around them make them a mere reference."""
    region = F.regexp_extract("official", r"^(DB\d{2})", 1)
    rows = cited.withColumns({"region": region, "home": home}).filter("region <> '' and home <> '' and region <> home")
    return rows.filter(~F.col("context").rlike(REFERENCE_WORDS)).select(key, "code")


def wrong_names(texts: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """Codes cited with a name other than the list's, blanks and joining signs aside: key, code."""
    same = lambda c: F.regexp_replace(c, r"[\s·—–-]", "")
    found = texts.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({NAMED})"), F.lit(1)))).alias("cite"))
    parts = found.select(key, same(F.regexp_extract("cite", NAMED, 1)).alias("name"), plain_code(F.regexp_extract("cite", NAMED, 2)).alias("code"))
    known = listed.select(F.col("standard_code").alias("code"), same(F.col("standard_name")).alias("own")).filter("own is not null")
    return parts.join(known, "code").filter("name <> own").select(key, "code").distinct()


def dead_references(texts: DataFrame, key: str, text: str, headings: DataFrame) -> DataFrame:
    """Clauses of other standards that texts cite and no heading has: key, code, clause_no. headings: (code, clause_no)."""
    found = texts.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CITED}第\\d+(?:\\.\\d+)+条)"), F.lit(1)))).alias("cite"))
    parts = found.select(key, plain_code(F.regexp_extract("cite", CITED, 1)).alias("code"), F.regexp_extract("cite", r"第(\d+(?:\.\d+)+)条", 1).alias("clause_no"))
    return parts.join(headings.select("code", "clause_no").distinct(), ["code", "clause_no"], "left_anti").select(key, "code", "clause_no").distinct()


def resolved_claims(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """Claims by how far they hold: item_id, tier.

    claims: (item_id, code, clause_ref, claimed), clauses: (code, clause_no, text). The clause cited holds the value; else
    another clause of the standard does, by the values that its clauses state; else any standard does; else the clause is
    there with another value, or missing. Values are joined as written without blanks, so no claim meets every clause.
    """
    bare = F.regexp_replace(fn.without_comparison(F.col("claimed")), r"\s+", "")
    rows = claims.withColumn("bare", bare)
    own = rows.join(clauses.select("code", F.col("clause_no").alias("clause_ref"), "text"), ["code", "clause_ref"])
    own = own.groupBy("item_id").agg(F.bool_or(fn.claim_in_text(F.col("claimed"), F.col("text"))).alias("matched"))
    stated = clauses.select("code", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(VALUE), F.lit(1)), lambda v: F.regexp_replace(v, r"\s+", "")))).alias("bare")).distinct()
    rows = rows.join(own, "item_id", "left").join(stated.withColumn("same", F.lit(True)), ["code", "bare"], "left").join(stated.select("bare").distinct().withColumn("anywhere", F.lit(True)), "bare", "left")
    tier = F.when(F.col("matched"), "matched").when(F.col("same"), "same_standard").when(F.col("anywhere"), "elsewhere").when(F.col("matched").isNotNull(), "value_mismatch").otherwise("missing_clause")
    return rows.select("item_id", tier.alias("tier"))


def chapter_fit(lines: DataFrame, key: str, listed: DataFrame, topics: DataFrame) -> DataFrame:
    """Cited codes held against the chapter they stand in: key, code, chapter, expected, fits (null without expectation).

    lines: (key, line_no, line); a short line that begins with a number of one figure begins a chapter. topics: (topic,
    expected), the chapter of standards whose name holds the topic, the first by topic.
    """
    heading = F.when(F.length("line") < 60, F.nullif(F.regexp_extract("line", r"^#?\s*([1-9])[\s.]", 1), F.lit("")))
    own = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # a document's lines
    at = lines.select(key, "line_no", F.regexp_extract_all("line", F.lit(CITED), F.lit(1)).alias("cites"), F.coalesce(F.last(heading, ignorenulls=True).over(own), F.lit("1")).alias("chapter"))
    cited = at.select(key, "chapter", F.explode("cites").alias("official")).select(key, "chapter", plain_code(F.col("official")).alias("code")).distinct()
    first = listed.filter("standard_name is not null").join(F.broadcast(topics), F.col("standard_name").contains(F.col("topic"))).groupBy(F.col("standard_code").alias("code")).agg(F.min_by("expected", "topic").alias("expected"))
    return cited.join(first, "code", "left").select(key, "code", "chapter", "expected", (F.col("chapter") == F.col("expected")).alias("fits"))


def name_problems(name: Column) -> Column:
    """What is wrong with a file's name, by rule."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    count = lambda sign: F.length(stem) - F.length(F.replace(stem, F.lit(sign), F.lit("")))
    rules = {
        "double space": stem.contains("  "), "space before suffix": name.rlike(r"(?i) \.pdf$"), "capital suffix": name.endswith(".PDF"),
        "no space behind code": name.rlike(r"(?:GB|JGJ|CJJ|CECS|DB\d{2})(?:[/_]?T)? ?\d{2,6}(?:-\d{4})?[一-鿿]"), "no space in code": stem.rlike(r"^(?:GB|JGJ|CJJ|CECS)\d{2,6}"),
        "dash": stem.rlike("[—–－]"), "division sign": stem.contains("∕"), "wide tilde": stem.contains("～"),
        "odd brackets": count("(") != count(")"), "odd wide brackets": count("（") != count("）"), "mixed brackets": stem.contains("(") & stem.contains("）") | stem.contains("（") & stem.contains(")"),
        "underscore": stem.rlike(r"\d_[^\d]") & ~stem.contains("_T"),
    }
    return F.array_compact(F.array(*[F.when(test, rule) for rule, test in rules.items()]))


def name_warnings(name: Column) -> Column:
    """What may be wrong with a file's name."""
    return F.array_compact(F.array(F.when(name.rlike(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}"), "date first"), F.when(name.rlike("副本|拷贝"), "copy")))


#: Repairs of a name's stem in order: pattern and replacement.
REPAIRS = (
    ("∕", "_"), ("～", "-"), ("[—–]", "-"), (" {2,}", " "), (r" +$", ""), (r"^(GB|JGJ|CJJ|CECS)(\d{2,6})", "$1 $2"), (r"(\d{4})([一-鿿])", "$1 $2"), (" （", "（"),
    (r"(\d[-.]\d+)_([一-鿿])", "$1 $2"), (r"^JGJ-(\d{1,3}-\d{4})", "JGJ $1"),
)


def repaired_name(name: Column) -> Column:
    """A file's name put right: signs, blanks, code, year, brackets and suffix."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    for pattern, by in REPAIRS:
        stem = F.regexp_replace(stem, pattern, by)
    stem = F.when(stem.contains("(") & stem.contains("）"), F.replace(stem, F.lit("("), F.lit("（"))).otherwise(stem)
    stem = F.when(stem.contains("（") & stem.contains(")"), F.replace(stem, F.lit(")"), F.lit("）"))).otherwise(stem)
    return F.concat(F.trim(stem), F.when(name.rlike(r"(?i)\.pdf$"), ".pdf").otherwise(""))


def glossary_sections(sections: DataFrame, key: str) -> DataFrame:
    """Sections that lie in a file's glossary: from the heading that is 术语 up to the next chapter from 3 on."""
    start = sections.filter(F.col("heading").rlike(r"^[\d.]*\s*术语(?:和符号|和定义)?\s*$")).groupBy(key).agg(F.min("pos").alias("start"))
    rows = sections.join(start, key).filter("pos >= start")
    chapter = F.regexp_extract("heading", r"^(\d+)\s", 1).try_cast("int") >= 3
    stop = rows.filter(chapter & (F.col("pos") > F.col("start"))).groupBy(key).agg(F.min("pos").alias("stop"))
    return rows.join(stop, key, "left").filter("stop is null or pos < stop").drop("start", "stop")


def import_parts(files: DataFrame, manifest: DataFrame, most_bytes: int, part_chars: int, least_entropy: float) -> DataFrame:
    """Files to import as parts (file, part, start, length): new by name and code, of text quality, large ones cut.

    files: (file, code, text, entropy); manifest: (file, code) of what was imported. A file of up to most_bytes in UTF-8
    is one part; others are cut every part_chars characters.
    """
    new = files.join(manifest.select("file").distinct(), "file", "left_anti").join(manifest.filter("code <> ''").select("code").distinct(), "code", "left_anti")
    good = new.filter((F.col("entropy") >= least_entropy) & (F.length("text") > 0))
    step = F.when(F.octet_length("text") > most_bytes, F.lit(part_chars)).otherwise(F.length("text"))
    sized = good.select("file", F.length("text").alias("size"), step.alias("step"))
    cut = sized.select("file", "size", "step", F.posexplode(F.sequence(F.lit(0), F.col("size") - 1, F.col("step"))).alias("part", "start"))
    return cut.select("file", (F.col("part") + 1).alias("part"), "start", F.least("step", F.col("size") - F.col("start")).alias("length"))
