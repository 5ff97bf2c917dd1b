"""Frequency of every distinct term: range-partitioned sort of terms, records and places, and a run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.session import read

#: White space of Unicode, the ideographic space included, and the separators that count as such.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

RUNS = "field string, term string, occurrences bigint, records bigint"


def split_terms(text: Column) -> Column:
    """Lower-case pieces of a text between white space; an empty array for null or blank texts."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), WHITE, " " * len(WHITE))
    return F.filter(F.split(plain, " "), lambda x: x != "")


def trimmed_codes(codes: Column) -> Column:
    """The non-blank entries of an array, trimmed and in upper case; an empty array for null."""
    cleaned = F.transform(codes, lambda x: F.upper(F.btrim(x, F.lit(WHITE))))
    return F.coalesce(F.filter(cleaned, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of places that come sorted by field, term, record and place; equal rows count once.

    A run cut by a batch's end gives two rows.
    """
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        field, term, record, place = batch.columns
        equal = lambda a, b: pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same = [equal(c.slice(1), c.slice(0, n - 1)) for c in (field, term, record, place)]
        same_term = pc.and_(same[0], same[1])
        same_record = pc.and_(same_term, same[2])
        head = tuple(c[0].as_py() for c in batch.columns)
        begins = lambda first, rest: pa.concat_arrays([pa.array([first]), pc.invert(rest)]).to_numpy(zero_copy_only=False)
        new_term = begins(True, same_term)
        records = begins(last is None or head[:3] != last[:3], same_record).cumsum()
        places = begins(head != last, pc.and_(same_record, same[3])).cumsum()
        starts = np.flatnonzero(new_term)
        ends = np.append(starts[1:], n) - 1
        upto = lambda c: np.diff(c[ends], prepend=0)
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([field.take(at), term.take(at), pa.array(upto(places)), pa.array(upto(records))], names=["field", "term", "occurrences", "records"])
        last = tuple(c[n - 1].as_py() for c in batch.columns)


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """(field, term, record, place) -> occurrences and distinct records of every term.

    place tells the occurrences of a term in a record apart; a record delivered again has the same ones, so nothing is
    brought together to count it once. The rows are range-partitioned on field, term and record, so a hot term spreads
    over many tasks and the places of a record meet in one. Null terms are dropped, rows without record are one record,
    an empty input gives no row.
    """
    pairs = pairs.select("field", "term", "record", "place").filter("term is not null")
    ordered = pairs.repartitionByRange("field", "term", "record").sortWithinPartitions("field", "term", "record", "place")
    runs = ordered.mapInArrow(scan_runs, RUNS)
    return runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def log_pairs(logs: DataFrame) -> DataFrame:
    """Terms of the search log with their records and places."""
    placed = lambda name, terms: F.transform(terms, lambda x, i: F.struct(F.lit(name).alias("field"), x.alias("term"), i.alias("place")))
    return logs.select(F.col("log_id").alias("record"), F.inline(F.concat(placed("q", split_terms(F.col("q"))), placed("c", trimmed_codes(F.col("c"))))))


def p4_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term and code with its counts and mark; mark is null for the useful ones."""
    logs = read(spark, sf_dir, "search_log").select("log_id", "q", "c")
    total = read(spark, sf_dir, "search_log").agg(F.countDistinct("log_id").alias("total"))
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") * 20 >= F.col("total"), "common")
    return term_frequencies(log_pairs(logs)).crossJoin(F.broadcast(total)).select("field", "term", "occurrences", "records", mark.alias("mark"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and codes too rare or too common to be of use."""
    return p4_frequency(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


QUERIES = {"p4_frequency": p4_frequency, "p4_found": p4_found}

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_COUNTS = rf"""
with logs as (select log_id, any_value(q) as q, any_value(c) as c from search_log group by log_id),
pairs as (
  select 'q' as field, log_id, unnest(regexp_split_to_array(lower(q), '{_SPACE}')) as term from logs where q is not null
  union all
  select 'c', log_id, upper(regexp_replace(regexp_replace(x, '^{_SPACE}', ''), '{_SPACE}$', '')) from (select log_id, unnest(c) as x from logs where c is not null) as entries where x is not null),
counts as (select field, term, count(*) as occurrences, count(distinct log_id) as records from pairs where term is not null and term <> '' group by field, term),
marked as (select field, term, occurrences, records, case when records = 1 then 'rare' when records * 20 >= (select count(*) from logs) then 'common' end as mark from counts)
"""
ORACLES = {
    "p4_frequency": _COUNTS + "select field, term, occurrences, records, mark from marked",
    "p4_found": _COUNTS + "select field, term, mark from marked where mark is not null",
}
