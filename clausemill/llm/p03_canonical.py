"""Mapping free-entered values to a canonical list by an n-gram inverted index and weighted cosine.

A code's number is indexed by its signs with each one left out in turn, so any two numbers one slip apart share a gram
and few others do; a name by its three thirds, one of which two changes leave whole. The index gives the candidates,
whole vectors of weighted n-grams their cosine; candidates further away than the slips allowed are no candidates, and
the best of the others is accepted from a least cosine and a least lead over the next.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.session import read

UNMATCHED = "UNMATCHED"
#: Least cosine of an accepted entry, and least lead over the next.
LEAST, MARGIN = 0.1, 0.02
#: Slips of a number, and changed characters of a name.
NUMBER_SLIPS, NAME_SLIPS = 1, 2
#: Shares of the number and the name in the squared length of a value's vector.
NUMBER_SHARE, NAME_SHARE = 0.64, 0.36
#: Slots of the table of document frequencies of name grams: its size doesn't depend on the list.
SLOTS = 1 << 16
#: Most code families (GB, JGJ and the like) of a list; they are taken from its codes, and more are refused.
MOST_FAMILIES = 1000

LETTERS_AS_DIGITS = str.maketrans("OQDILSBZG", "000115826")
IDEOGRAPHS = re.compile(r"[㐀-鿿豈-﫿]+")
REMARKS = re.compile(r"[(（\[【〔][^)）\]】〕]*[)）\]】〕]|第[\d.]+[条款章节]")


def family_of(code: str) -> tuple[str, str] | None:
    """Family and number of a list's code; the letter of a recommended standard at the family's end is left out."""
    match = re.match(r"^(.*?[A-Z])[\s_/\-.]*(\d[\d.]*)$", unicodedata.normalize("NFKC", code).upper())
    if not match:
        return None
    letters = re.sub(r"[\s_/\-.]", "", match[1])
    return (letters[:-1] if len(letters) > 2 and letters.endswith("T") else letters), match[2]


def code_pattern(families: list[str]) -> re.Pattern:
    """A typed code: a family in any spelling and a number, or a number alone; letters drawn like digits may be digits."""
    spelled = "|".join(r"[\s/_\-.]*".join(map(re.escape, f)) for f in sorted(families, key=lambda f: (-len(f), f)))
    family = rf"(?:(?P<family>{spelled})[\s_/\-.]*T?[\s_/\-.]*)?" if families else "(?P<family>(?!))?"
    return re.compile(rf"(?<![A-Z0-9]){family}(?P<number>(?=[A-Z]?\d|[A-Z]{{2}}\d\d)[0-9OILSBZQDG]{{3,7}})(?![0-9A-Z.])")


def parse_value(value: str | None, pattern: re.Pattern) -> tuple[str | None, str | None, str | None]:
    """Family, number and name that a typed value gives; each is null where it gives none."""
    text = unicodedata.normalize("NFKC", value or "").upper()
    text = re.sub(r"\s*[-‐-―−]\s*(?=\d{2,4}(?:\D|$))", "-", text)
    match = pattern.search(text)
    family = re.sub(r"[\s/_\-.]", "", match["family"]) if match and match["family"] else None
    name = "".join(IDEOGRAPHS.findall(REMARKS.sub("", text)))
    return family, match["number"] if match else None, name if len(name) >= 4 else None


def number_grams(number: str) -> list[str]:
    """A number's signs, whole and with each one left out: numbers one slip apart share at least one."""
    return list(dict.fromkeys([number, *(number[:k] + number[k + 1 :] for k in range(len(number)))]))


def thirds(name: str) -> list[str]:
    """A name cut into as many parts as it may have changes, and one more: one of them stays whole."""
    edges = [len(name) * k // (NAME_SLIPS + 1) for k in range(NAME_SLIPS + 2)]
    return [name[a:b] for a, b in zip(edges, edges[1:]) if a < b]


def name_grams(name: str) -> list[str]:
    """Triples of a name's characters and its ends."""
    marked = f"^{name}$"
    return list(dict.fromkeys(marked[k : k + 3] for k in range(len(name))))


def slot(gram: str) -> int:
    """A gram's place in the table of document frequencies."""
    return zlib.crc32(gram.encode()) % SLOTS


def slips(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours being one; most + 1 where there are more than most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _digits(number: str) -> str:
    return number.translate(LETTERS_AS_DIGITS)


class Scorer:
    """Weighted cosines between values and entries; gram weights are those of the list."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.name = lru_cache(100_000)(self._name)
        self.number = lru_cache(100_000)(lambda number: frozenset(number_grams(number)))

    def _name(self, name: str) -> tuple[dict[str, float], float]:
        squares = {g: float(self.weights[slot(g)]) ** 2 for g in name_grams(name)}
        return squares, sum(squares.values()) ** 0.5

    def cosine(self, number: str | None, name: str | None, entry_number: str | None, entry_name: str | None) -> float:
        """Each view's part is a unit vector times the root of its share; an entry's views that the value lacks don't count."""
        dot = own = other = 0.0
        if number:
            own += NUMBER_SHARE
        if name:
            own += NAME_SHARE
        other = NUMBER_SHARE * bool(number and entry_number) + NAME_SHARE * bool(name and entry_name)
        if number and entry_number:
            a, b = self.number(_digits(number)), self.number(entry_number)
            # repeated signs give equal grams: lengths count places, so that they don't bring a number nearer
            dot += NUMBER_SHARE * (1.0 if _digits(number) == entry_number else len(a & b) / ((len(number) + 1) * (len(entry_number) + 1)) ** 0.5)
        if name and entry_name:
            (a, norm_a), (b, norm_b) = self.name(name), self.name(entry_name)
            dot += NAME_SHARE * sum(w for g, w in a.items() if g in b) / (norm_a * norm_b)
        return dot / (own * other) ** 0.5 if own and other else 0.0


def holds(number: str | None, name: str | None, entry_number: str | None, entry_name: str | None) -> str | None:
    """What a value has of an entry within the slips allowed, or null."""
    if number and entry_number:
        if number == entry_number:
            return "number"
        if _digits(number) == entry_number or slips(number, entry_number, NUMBER_SLIPS) <= NUMBER_SLIPS:
            near = "number with slip"
        else:
            near = None
    else:
        near = None
    if name and entry_name:
        if entry_name in name:
            return "name"
        if near is None and slips(name, entry_name, NAME_SLIPS) <= NAME_SLIPS:
            return "name with slip"
    return near


def map_to_list(values: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct values (value) and a list (standard_code, standard_name) -> value, standard_code, how, score.

    Every distinct non-blank value gives one row, with UNMATCHED where no entry agrees or where two agree alike. Values
    are looked up once however many rows hold them; the candidates come from the inverted index alone, which is complete
    for the slips allowed. Names that share a third with many entries have as many candidates.
    """
    spark = entries.sparkSession
    entries = entries.select(F.col("standard_code").alias("entry"), F.col("standard_name").alias("listed")).filter("entry is not null").distinct()
    def over(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        return lambda batches: map(f, batches)

    def index_entries(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for entry, listed in zip(batch["entry"], batch["listed"]):
            family, number = family_of(entry) or (None, None)
            name = "".join(IDEOGRAPHS.findall(REMARKS.sub("", unicodedata.normalize("NFKC", listed or "").upper())))
            name = name if len(name) >= 4 else None
            keys = [f"{f}:{g}" for g in number_grams(number) for f in (family, "")] if number else []
            rows.append((entry, family, number, name, keys + [f"#{g}" for g in dict.fromkeys(thirds(name or ""))], [slot(g) for g in name_grams(name)] if name else [], sorted({len(x) for x in thirds(name or "")})))
        return pd.DataFrame(rows, columns=["entry", "family", "entry_number", "entry_name", "keys", "slots", "spans"])

    listed = entries.mapInPandas(over(index_entries), "entry string, family string, entry_number string, entry_name string, keys array<string>, slots array<int>, spans array<int>")
    families = [r.family for r in listed.select("family").filter("family is not null").distinct().limit(MOST_FAMILIES + 1).collect()]
    if len(families) > MOST_FAMILIES:
        raise ValueError(f"more than {MOST_FAMILIES} code families")
    pattern = code_pattern(families)
    counts = listed.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect()  # at most SLOTS rows
    size = max(1, entries.count())
    weights = np.full(SLOTS, np.log(1 + size), np.float32)
    for r in counts:
        weights[r["slot"]] = np.log(1 + size / r["count"])
    spans = sorted(r.n for r in listed.select(F.explode("spans").alias("n")).distinct().collect())  # lengths of name parts
    shared = spark.sparkContext.broadcast(weights)

    def index_values(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for value in batch["value"]:
            family, number, name = parse_value(value, pattern)
            keys = [f"{family or ''}:{g}" for g in dict.fromkeys([*number_grams(number), *number_grams(_digits(number))])] if number else []
            keys += dict.fromkeys(f"#{name[k : k + n]}" for n in spans for k in range(len(name) - n + 1)) if name else []
            rows.append((value, number, name, keys))
        return pd.DataFrame(rows, columns=["value", "number", "name", "keys"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        text = lambda x: x if isinstance(x, str) else None
        for batch in batches:
            rows = []
            for value, entry, *views in batch[["value", "entry", "number", "name", "entry_number", "entry_name"]].itertuples(index=False):
                views = list(map(text, views))
                if (cosine := scorer.cosine(*views)) >= LEAST and (how := holds(*views)):
                    rows.append((value, entry, how, cosine))
            yield pd.DataFrame(rows, columns=["value", "entry", "how", "cosine"])

    values = values.select("value").filter("trim(value) <> ''").distinct()
    typed = values.mapInPandas(over(index_values), "value string, number string, name string, keys array<string>")
    index = listed.select("entry", "entry_number", "entry_name", F.explode("keys").alias("key"))
    pairs = typed.select("value", "number", "name", F.explode("keys").alias("key")).join(index, "key")
    # names that only share a third with an entry's are passed over before they are brought together
    near = F.levenshtein("name", "entry_name", NAME_SLIPS) >= 0
    pairs = pairs.filter(F.col("key").startswith("#").eqNullSafe(False) | F.col("name").contains(F.col("entry_name")) | near).drop("key")
    scored = pairs.dropDuplicates(["value", "entry"]).mapInPandas(score, "value string, entry string, how string, cosine double")
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("cosine"), "entry"))
    best = scored.withColumn("rank", rank).filter("rank <= 2").groupBy("value")  # no more than two a value are sorted on
    best = best.agg(F.min_by(F.struct("entry", "how", "cosine"), "rank").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("cosine"))).alias("next"))
    clear = F.col("first.cosine") - F.coalesce("next", F.lit(0.0)) >= MARGIN
    chosen = best.filter(clear).select("value", "first.entry", "first.how", F.round("first.cosine", 4).alias("score"))
    return values.join(chosen, "value", "left").select("value", F.coalesce("entry", F.lit(UNMATCHED)).alias("standard_code"), "how", "score")


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank typed values: src_table, src_field, row_id, value; rows delivered twice count once."""
    citations = read(spark, sf_dir, "plan_writer_citation_summary_sample")
    queries = read(spark, sf_dir, "golden_queries")
    fields = F.array(F.struct(F.lit("code").alias("src_field"), F.col("code").alias("value")), F.struct(F.lit("official_code").alias("src_field"), F.col("official_code").alias("value")))
    cited = citations.select(F.lit("plan_writer_citation_summary_sample").alias("src_table"), F.col("item_id").alias("row_id"), F.inline(fields))
    asked = queries.select(F.lit("golden_queries").alias("src_table"), F.col("query_id").alias("row_id"), F.lit("expected_standard_code").alias("src_field"), F.col("expected_standard_code").alias("value"))
    blank = r"^[\s\u00a0\u2000-\u200b\u202f\u205f\u3000\ufeff]*$"
    return cited.unionByName(asked).filter(F.col("value").isNotNull() & ~F.col("value").rlike(blank)).distinct()


def p3_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value with the list entry it means, how it was found and its score."""
    values = typed_values(spark, sf_dir)
    mapped = map_to_list(values.select("value"), read(spark, sf_dir, "standard_status").select("standard_code", "standard_name"))
    return values.join(mapped, "value").select("src_table", "src_field", "row_id", "value", "standard_code", "how", "score")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard each typed value means, or UNMATCHED."""
    return p3_mapped(spark, sf_dir).select("src_table", "src_field", "row_id", "standard_code")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values no entry was found for, with the number of rows that hold them."""
    return p3_mapped(spark, sf_dir).filter(F.col("standard_code") == UNMATCHED).groupBy("value").agg(F.count("*").alias("n_rows"))


QUERIES = {"p3_mapped": p3_mapped, "p3_found": p3_found, "p3_unmatched": p3_unmatched}
ORACLES: dict[str, str] = {}
