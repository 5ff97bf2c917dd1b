"""Visually identical text with different characters: look-alike folding and classes under a Unicode collation.

Every piece of text that holds a deviating character is folded by a look-alike table; pieces equal under Spark's accent-
and case-sensitive UNICODE collation (which takes combining accents as their precomposed letters and passes over
characters without width) form a class; the class's canonical member is joined back to the pieces. Signs with a meaning
of their own (², ℃, φ, α, Ω, ①, Ⅱ, ～, Chinese punctuation) stay as they are.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clausemill.session import read, read_wide

# Letters of other scripts that are drawn as the Latin letter beside them.
CYRILLIC = "АВЕЅІЈКМНОРСТУХѴаеѕіјорсухѵһԁԛԝӓӧӑӗёї"
CYRILLIC_AS = "ABESIJKMHOPCTYXVaesijopcyxvhdqwäöăĕëï"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρυκ"
GREEK_AS = "ABEZHIKMNOPTYXovipuk"
#: Greek letters that are signs of their own unless a Latin letter stands beside them.
GREEK_SIGNS = "νιρυκ"
FULL_WIDTH = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
FULL_WIDTH_SIGNS = "％．／"
FULL_WIDTH_AS = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH + FULL_WIDTH_SIGNS)
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF]))


def _ideographs() -> dict[str, str]:
    """Radicals and compatibility ideographs, and styled mathematical letters, with what Unicode says they stand for."""
    blocks = (range(0x2E80, 0x2FD6), range(0xF900, 0xFB00), range(0x1D400, 0x1D800), range(0x2F800, 0x2FA20))
    table = {chr(c): unicodedata.normalize("NFKC", chr(c)) for block in blocks for c in block}
    table |= {"⻅": "见", "⻆": "角", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻚": "页", "⻛": "风", "⻜": "飞", "⻢": "马", "⻥": "鱼", "⻩": "黄", "⻬": "齐", "⻰": "龙"}
    greek = set(unicodedata.normalize("NFKC", "".join(map(chr, range(0x1D6A8, 0x1D7CC)))))
    return {a: b for a, b in table.items() if a != b and len(b) == 1 and b not in greek}


IDEOGRAPHS = _ideographs()
LOOKALIKES = CYRILLIC + "".join(c for c in GREEK if c not in GREEK_SIGNS) + "".join(IDEOGRAPHS)
_CAPITALS = len(GREEK) - len(GREEK_SIGNS)
FROM = FULL_WIDTH + FULL_WIDTH_SIGNS + CYRILLIC + GREEK[: _CAPITALS - 1] + "ο" + SPACES + "".join(IDEOGRAPHS)
TO = FULL_WIDTH_AS + CYRILLIC_AS + GREEK_AS[: _CAPITALS - 1] + "o" + " " * len(SPACES) + "".join(IDEOGRAPHS.values())


def _set(chars: str) -> str:
    """A Java character class of as few ranges as possible: every range is tested in turn."""
    codes = sorted(map(ord, set(chars)))
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


COMBINING = r"[\p{L}][\x{300}-\x{36F}]"
SIGN_AS_LETTER = f"[A-Za-z]{_set(GREEK_SIGNS)}|{_set(GREEK_SIGNS)}[A-Za-z]"
#: Width signs count beside other full-width characters or digits.
WIDTH = f"{_set(FULL_WIDTH)}|[0-9A-Za-z]{_set(FULL_WIDTH_SIGNS)}|{_set(FULL_WIDTH_SIGNS)}[0-9A-Za-z]"
KINDS = {
    "width": WIDTH,
    "combining": COMBINING,
    "invisible": _set(INVISIBLE),
    "space": _set(SPACES),
    "lookalike": f"{_set(LOOKALIKES)}|{SIGN_AS_LETTER}",
}
DEVIATING = "|".join(KINDS.values())
#: Passed by every deviating text and by few others, at one class test a character.
SUSPECT = "[^\\x00-\\x7F\\x{3001}\\x{3002}\\x{4E00}-\\x{9FFF}\\x{FF08}\\x{FF09}\\x{FF0C}\\x{FF1A}\\x{FF1B}\\x{B2}\\x{B1}\\x{2103}\\x{2264}\\x{FF5E}]"
#: Pieces end at line ends, plain spaces and Chinese punctuation, which are proper signs.
PIECE_ENDS = r"[ \n\r\t，。；：、（）《》]+"


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Letters with combining accents in composed form; only run on the classes' members."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def folded(text: Column) -> Column:
    """The text with every character of the look-alike tables replaced, the Greek signs only beside Latin letters."""
    text = F.translate(text, FROM, TO)
    for sign, letter in zip(GREEK, GREEK_AS):
        if sign in GREEK_SIGNS:
            text = F.regexp_replace(text, f"(?<=[A-Za-z]){sign}|{sign}(?=[A-Za-z])", letter)
    return text


def canonical_pieces(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, text) -> src_table, row_id, piece, canonical for each distinct deviating piece of a row."""
    pieces = F.filter(F.array_distinct(F.split("text", PIECE_ENDS)), lambda p: p.rlike(SUSPECT) & p.rlike(DEVIATING))
    found = rows.filter(F.col("text").rlike(SUSPECT)).select("src_table", "row_id", F.explode(pieces).alias("piece"))
    members = found.select("piece").distinct().withColumn("folded", folded(F.col("piece")))
    keyed = members.withColumn("key", F.collate("folded", "UNICODE"))
    signs = F.length(F.regexp_replace("folded", f"{COMBINING}|{KINDS['invisible']}", "")) - F.length("folded")
    classes = keyed.groupBy("key").agg(F.min(F.struct((-signs).alias("signs"), "folded")).alias("best"))
    chosen = composed(F.regexp_replace("best.folded", KINDS["invisible"], ""))
    classes = classes.select("key", chosen.alias("canonical"))
    named = keyed.join(classes, "key").select("piece", "canonical")
    return found.join(named, "piece").select("src_table", "row_id", "piece", "canonical")


def kinds_of(piece: Column, canonical: Column) -> Column:
    """The kinds in which a piece deviates from its class's member: signs of that kind which the member doesn't have.

    An accent that no letter is composed with stays in the member, and counts all the same.
    """
    return F.array_compact(F.array(*[F.when(piece.rlike(p) & (F.lit(k == "combining") | ~canonical.rlike(p)), k) for k, p in KINDS.items()]))


def normalise_lookalikes(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, text) -> src_table, row_id, text, kinds with one consistent form of each text.

    A row delivered twice counts once, null texts stay null, texts without deviation come back as they are with an empty
    kinds. A piece that stands in many rows is joined by AQE's skew join.
    """
    rows = rows.select("src_table", "row_id", "text")
    pieces = canonical_pieces(rows)
    per_row = pieces.groupBy("src_table", "row_id").agg(
        F.map_from_entries(F.collect_set(F.struct("piece", "canonical"))).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(kinds_of(F.col("piece"), F.col("canonical")))))).alias("kinds"),
    )
    # The pieces are put back between the separators they were cut at.
    parts = F.transform(F.split("text", PIECE_ENDS), lambda p: F.coalesce(F.try_element_at("pairs", p), p))
    ends = F.regexp_extract_all("text", F.lit(f"({PIECE_ENDS})"), F.lit(1))
    rebuilt = F.array_join(F.zip_with(parts, ends, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    one = rows.dropDuplicates(["src_table", "row_id"]).join(per_row, ["src_table", "row_id"], "left")
    text = F.when(F.col("pairs").isNull(), F.col("text")).otherwise(rebuilt)
    return one.select("src_table", "row_id", text.alias("text"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and clause texts as (src_table, row_id, text)."""
    queries = read(spark, sf_dir, "golden_queries").select(F.lit("golden_queries").alias("src_table"), F.col("query_id").alias("row_id"), F.col("query").alias("text"))
    clauses = read_wide(spark, sf_dir, "read_clause_full").select(F.lit("read_clause_full").alias("src_table"), F.col("rec_id").alias("row_id"), F.col("clause_text").alias("text"))
    return queries.unionByName(clauses)


def p6_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every query and clause text."""
    return normalise_lookalikes(source_rows(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the kinds of deviating characters in them."""
    pieces = canonical_pieces(source_rows(spark, sf_dir))
    return pieces.select("src_table", "row_id", F.explode(kinds_of(F.col("piece"), F.col("canonical"))).alias("kind")).distinct()


QUERIES = {"p6_normalised": p6_normalised, "p6_found": p6_found}
_ROWS = """with texts as (select distinct 'golden_queries' as src_table, query_id as row_id, query as body from golden_queries
union select distinct 'read_clause_full', rec_id, clause_text from read_clause_full)
"""
#: Whole blocks of Unicode, written apart from the tables above; the SQL has no classes and tests the texts alone.
_BLOCKS = {
    "width": r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]|[0-9A-Za-z][％．／]|[％．／][0-9A-Za-z]",
    "combining": r"\p{L}[\x{300}-\x{36F}]",
    "invisible": r"\p{Cf}|\x{34F}",
    "space": r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]",
    "lookalike": r"\p{Cyrillic}|[ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο]|[\x{2E80}-\x{2FDF}\x{F900}-\x{FAFF}\x{1D400}-\x{1D7FF}\x{2F800}-\x{2FA1F}]|[A-Za-z][νιρυκ]|[νιρυκ][A-Za-z]",
}
ORACLES = {
    "p6_found": _ROWS
    + " union ".join(f"select src_table, row_id, '{kind}' as kind from texts where regexp_matches(body, '{pattern}')" for kind, pattern in _BLOCKS.items())
}
