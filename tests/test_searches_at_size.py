"""Searches by many queries: none is refused, and ways taken at size give what the plain ones give."""

import pytest

from clausemill.operators import search
from clausemill.plans import registry, search as plans
from clausemill.plans.lexical import all_questions

DATA = "/root/testdata/sf0.001"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_more_queries_than_are_broadcast(spark, monkeypatch):
    """More queries and words than go to every task at once give the same results; they were refused before."""
    asked = plans._questions(spark)
    want = rows(plans.d1_keyword_search(spark, DATA, asked)), rows(plans.d4_title_lookup(spark, DATA, asked))
    monkeypatch.setattr(search, "MOST_ASKED", 2)
    monkeypatch.setattr(search, "MOST_WORDS", 3)
    assert want == (rows(plans.d1_keyword_search(spark, DATA, asked)), rows(plans.d4_title_lookup(spark, DATA, asked))) and want[0]


def test_best_segments_where_they_lie(spark):
    """The best of a file's segments, ties going to the first file, as taken from all results."""
    heads = [("_seg0_GB 1-2000 模板_p0001-0002_7.md", 0), ("_seg1_GB 1-2000 模板_p0003-0004_5.md", 1), ("_seg1_GB 1-2000 模板_p0003-0004_5.md", 0), ("_seg0_GB 2-2000 支架_p0001-0002_6.md", 0), ("别的.md", 0)]
    places = spark.createDataFrame([(f, "GB1" if "GB 1" in f else "", k, f"3.1.{k} 模板", f"3.1.{k} 模板与支架，C40{'。' * 400}", 420) for f, k in heads], "file string, code string, sid int, heading string, segment string, length int")
    asked = spark.createDataFrame([("a", "模板 支架"), ("b", "支架 c40 无此词"), ("c", "gb1"), ("d", ""), ("e", None), ("f", "模板　支架")], "qid string, text string")
    every = search.keyword_search(asked, places)
    assert rows(search.dedup_segments(every).drop("hits")) == rows(search.keyword_search(asked, places, segments=False).drop("hits"))
    assert {r.qid for r in every.select("qid").collect()} == {"a", "b", "f"} and len({r.file for r in every.collect()}) == 4


def test_halves_are_rounded_as_by_sql():
    assert search.half_up(search.np.array([5.95, 0.25, 7.449999999999999, -0.25, 2.0]), {}).tolist() == [6.0, 0.3, 7.4, -0.3, 2.0]


@pytest.mark.parametrize("name", ["x9_hybrid_golden", "x8_version_golden", "x3_authority_golden", "x9_routed_golden"])
def test_every_golden_query_is_asked(spark, name):
    """Queries of any id are answered, by code and by SQL; before only those divisible by 20 were."""
    asked = {r.qid for r in all_questions(spark, DATA).select("qid").collect()}
    ids = {r.query_id for r in spark.read.parquet(f"{DATA}/golden_queries.parquet").filter("query is not null").select("query_id").collect()}
    got = {r.qid for r in registry.queries()[name](spark, DATA).select("qid").distinct().collect()}
    assert asked == ids and got <= ids and any(q % 20 for q in got)
    assert "% 20" not in registry.oracle_sql().get(name, "")
