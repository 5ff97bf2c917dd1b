"""How distinctive a term is per record: log-odds with an informative Dirichlet prior, as z-scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.session import read, read_wide

#: Pseudo-counts that the prior spreads over the terms in proportion to their counts in the collection.
PRIOR_MASS = 10.0
#: Most terms of a list; they go to every task as one automaton of about a kilobyte a term. Longer lists are refused.
MOST_TERMS = 200_000
#: A term is characteristic of a record from this z-score: more frequent in it than in the rest.
LEAST_Z = 0.0


def term_counter(terms: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A mapper from (rec_id, text) to (rec_id, term, n), the non-overlapping occurrences of each term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for rec_id, text in zip(batch["rec_id"], batch["text"]):
                counts: dict[str, int] = {}
                free: dict[str, int] = {}
                for end, term in automaton.iter(text):
                    if end - len(term) >= free.get(term, -1):
                        counts[term] = counts.get(term, 0) + 1
                        free[term] = end
                rows.extend((rec_id, term, n) for term, n in counts.items())
            yield pd.DataFrame(rows, columns=["rec_id", "term", "n"])

    return count


def log_odds_z(y: Column, n: Column, all_y: Column, all_n: Column) -> Column:
    """z-score of a term seen y times among n in a record, against the rest of a collection with all_y of all_n."""
    prior = all_y * PRIOR_MASS / all_n
    rest_y, rest_n = all_y - y, all_n - n
    record = F.log((y + prior) / (n + F.lit(PRIOR_MASS) - y - prior))
    rest = F.log((rest_y + prior) / (rest_n + F.lit(PRIOR_MASS) - rest_y - prior))
    return (record - rest) / F.sqrt(1 / (y + prior) + 1 / (rest_y + prior))


def distinctive_terms(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(rec_id, text) and a list of terms -> rec_id, term, n, df, total_records, z.

    The term list is collected, up to MOST_TERMS: it is a vocabulary given by the caller. Records delivered
    twice count once, records without text count in total_records only, a single-term collection gives z null, and empty
    inputs give no rows. Only the counted triples are shuffled, never the texts.
    """
    named = terms.select(F.col(terms.columns[0]).alias("term")).filter("term <> ''").distinct()
    words = sorted(r.term for r in named.limit(MOST_TERMS + 1).collect())
    if len(words) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    schema = "rec_id bigint, term string, n bigint"
    texts = records.select("rec_id", "text").filter("text is not null and text <> '' and rec_id is not null")
    counts = texts.mapInPandas(term_counter(words), schema).groupBy("rec_id", "term").agg(F.max("n").alias("n"))
    per_record = counts.groupBy("rec_id").agg(F.sum("n").alias("record_n"), F.collect_list(F.struct("term", "n")).alias("hits"))
    counts = per_record.select("rec_id", "record_n", F.inline("hits"))
    per_term = counts.groupBy("term").agg(F.sum("n").alias("all_y"), F.count("*").alias("df"))
    totals = per_term.agg(F.sum("all_y").alias("all_n"))
    size = records.agg(F.countDistinct("rec_id").alias("total_records"))
    stats = per_term.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(size))  # at most one row a listed term
    z = F.when(F.col("all_n") > F.col("all_y"), log_odds_z(F.col("n"), F.col("record_n"), F.col("all_y"), F.col("all_n")))
    return counts.join(F.broadcast(stats), "term").select("rec_id", "term", "n", "df", "total_records", F.round(z, 6).alias("z"))


def p5_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scores of every listed term of every clause record."""
    records = read_wide(spark, sf_dir, "read_clause_full").select("rec_id", F.col("clause_text").alias("text"))
    return distinctive_terms(records, read(spark, sf_dir, "term_map").select("term"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characteristic terms that stand three times in a record and are shared by two records up to one per cent of all."""
    kept = p5_distinctive(spark, sf_dir).filter((F.col("z") > LEAST_Z) & F.expr("n >= 3 and df >= 2 and df * 100 <= total_records"))
    return kept.select("rec_id", "term")


QUERIES = {"p5_distinctive": p5_distinctive, "p5_found": p5_found}

_COUNTS = """
with records as (select rec_id, any_value(clause_text) as body from read_clause_full group by rec_id),
counts as (select rec_id, m.term, cast((length(body) - length(replace(body, m.term, ''))) // length(m.term) as bigint) as n
  from records join term_map m on contains(body, m.term)),
per_record as (select rec_id, sum(n) as record_n from counts group by rec_id),
per_term as (select term, sum(n) as all_y, count(*) as df from counts group by term),
totals as (select sum(all_y) as all_n from per_term),
scored as (select c.rec_id, c.term, c.n, t.df, (select count(*) from records) as total_records,
  cast(c.n as double) as y, cast(r.record_n as double) as rn, cast(t.all_y as double) as ay, cast(totals.all_n as double) as an, t.all_y * 10.0 / totals.all_n as a
  from counts c join per_record r using (rec_id) join per_term t using (term), totals)
"""
_Z = """(ln((y + a) / (rn + 10.0 - y - a)) - ln((ay - y + a) / (an - rn + 10.0 - (ay - y) - a)))
  / sqrt(1 / (y + a) + 1 / (ay - y + a))"""
ORACLES = {
    "p5_distinctive": _COUNTS + f"select rec_id, term, n, df, total_records, round({_Z}, 6) as z from scored",
    "p5_found": _COUNTS + f"select rec_id, term from scored where n >= 3 and df >= 2 and df * 100 <= total_records and {_Z} > 0",
}
