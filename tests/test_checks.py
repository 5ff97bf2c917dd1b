"""Checks of texts, names and imports on small fixtures: hits, nulls, ties and empty frames."""

import pytest
from pyspark.sql import functions as F

from clausemill.operators import checks, support

LISTED = [("GB10001", "甲设计标准", "GB 10001-2020"), ("DB91T4025", "乙 施工规程", "DB91/T 4025-2008"), ("GB10009", None, None)]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(LISTED, "standard_code string, standard_name string, official_code string")


def texts(spark, *rows):
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id int, text string")


def test_unknown_codes(spark, listed):
    cited = checks.cited_codes(texts(spark, "见GB 10001-2020和GB/T 99999-2020", None, "", "无"), "doc_id", "text")
    assert [(r.doc_id, r.code) for r in checks.unknown_codes(cited, "doc_id", listed).collect()] == [(0, "GBT99999")]
    assert {r.context for r in cited.collect()} == {"见GB 10001-2020和GB/T 99999-2020"}


def test_foreign_regions(spark):
    far = "甲" * 100
    rows = texts(spark, "应符合DB95/T 4025-2008的规定", "可参照DB95/T 4025-2008执行", "参照" + far + "DB95/T 4025-2008", "DB91/T 4025-2008", "GB 10001-2020")
    got = checks.foreign_regions(checks.cited_codes(rows, "doc_id", "text"), "doc_id", F.lit("DB91")).collect()
    assert sorted(r.doc_id for r in got) == [0, 2]


def test_wrong_names_and_dead_references(spark, listed):
    rows = texts(spark, "《甲设计标准》GB 10001-2020", "《丙设计标准》GB 10001-2020", "《乙施工规程》DB91/T 4025-2008", "《任何》GB 10009-2020", None)
    assert [(r.doc_id, r.code) for r in checks.wrong_names(rows, "doc_id", "text", listed).collect()] == [(1, "GB10001")]
    cited = texts(spark, "GB 10001-2020第3.1.1条和GB 10001-2020第9.9.9条", None)
    held = spark.createDataFrame([("GB10001", "3.1.1"), ("GB10001", "3.1.1")], "code string, clause_no string")
    assert [(r.doc_id, r.clause_no) for r in checks.dead_references(cited, "doc_id", "text", held).collect()] == [(0, "9.9.9")]


def test_claims_by_tier(spark):
    clauses = spark.createDataFrame([("A", "1.1", "间距不应大于200mm。"), ("A", "1.2", "厚度30 mm"), ("B", "1.1", "埋深5m")], "code string, clause_no string, text string")
    claims = spark.createDataFrame([(1, "A", "1.1", "不大于200mm"), (2, "A", "1.1", "30mm"), (3, "A", "1.1", "5m"), (4, "A", "1.1", "77kN"), (5, "A", "9.9", "77kN"), (6, None, None, "200mm")], "item_id int, code string, clause_ref string, claimed string")
    assert {r.item_id: r.tier for r in checks.resolved_claims(claims, clauses).collect()} == {1: "matched", 2: "same_standard", 3: "elsewhere", 4: "value_mismatch", 5: "missing_clause", 6: "elsewhere"}
    assert checks.resolved_claims(claims.limit(0), clauses).count() == 0


def test_chapter_fit(spark, listed):
    lines = spark.createDataFrame([(1, 0, "前言GB 10001-2020"), (1, 1, "3 安全"), (1, 2, "按GB 10001-2020执行"), (1, 3, "4 质量" + "长" * 80), (1, 4, "DB91/T 4025-2008")], "doc_id int, line_no int, line string")
    topics = spark.createDataFrame([("设计", "3"), ("标准", "9")], "topic string, expected string")
    got = {(r.chapter, r.code): (r.expected, r.fits) for r in checks.chapter_fit(lines, "doc_id", listed, topics).collect()}
    assert got == {("1", "GB10001"): ("9", False), ("3", "GB10001"): ("9", False), ("3", "DB91T4025"): (None, None)}


@pytest.mark.parametrize("name, problems, warnings, fixed", [
    ("GB50011抗震.PDF", {"capital suffix", "no space behind code", "no space in code"}, set(), "GB 50011 抗震.pdf"),
    ("GB 50011-2010 抗震  规范 .pdf", {"double space", "space before suffix"}, set(), "GB 50011-2010 抗震 规范.pdf"),
    ("GB 50011—2010 抗震(规范）.pdf", {"dash", "odd brackets", "odd wide brackets", "mixed brackets"}, set(), "GB 50011-2010 抗震（规范）.pdf"),
    ("2024-01-02 抗震副本.pdf", set(), {"date first", "copy"}, "2024-01-02 抗震副本.pdf"),
    ("14S501-1_铸铁", {"underscore"}, set(), "14S501-1 铸铁"), ("JGJ-59-2011 检查", set(), set(), "JGJ 59-2011 检查"), ("", set(), set(), ""),
])
def test_names(spark, name, problems, warnings, fixed):
    row = spark.createDataFrame([(name,)], "n string").select(checks.name_problems(F.col("n")).alias("p"), checks.name_warnings(F.col("n")).alias("w"), checks.repaired_name(F.col("n")).alias("f")).first()
    assert (set(row.p), set(row.w), row.f) == (problems, warnings, fixed)


def test_glossary(spark):
    rows = spark.createDataFrame([("a", 1, "1 总则", 0), ("a", 2, "2 术语", 10), ("a", 3, "2.1 甲", 20), ("a", 4, "3 设计", 30), ("a", 5, "2 又", 40), ("b", 6, "术语", 0), ("b", 7, "乙", 9), ("c", 8, "3 设计", 0)], "file string, section_id int, heading string, pos int")
    assert sorted(r.section_id for r in checks.glossary_sections(rows, "file").collect()) == [2, 3, 6, 7]


def test_import_parts(spark):
    files = spark.createDataFrame([("a", "X", "甲" * 25, 5.0), ("b", "Y", "甲" * 5, 5.0), ("c", "Z", "甲" * 5, 5.0), ("d", "", "甲" * 5, 1.0), ("e", "", "", 5.0), ("f", None, "ab", 5.0)], "file string, code string, text string, entropy double")
    manifest = spark.createDataFrame([("b", ""), ("old", "Z")], "file string, code string")
    got = sorted((r.file, r.part, r.start, r.length) for r in checks.import_parts(files, manifest, 30, 10, 4.5).collect())
    assert got == [("a", 1, 0, 10), ("a", 2, 10, 10), ("a", 3, 20, 5), ("f", 1, 0, 2)]


PAIR = "id string, required_clauses array<struct<standard_code:string,official_code:string,clause_no:string,clause_type:string>>, required_facts array<struct<fact:string,value:string,unit:string,condition:string>>, acceptable_alternatives array<struct<standard_code:string,clause_no:string>>, forbidden_hits array<struct<standard_code:string,clause_no:string>>, result_code string, result_status string, text string, rank int"


def test_alternatives_forbidden_and_prefixes(spark):
    wanted, fact = [("A", "A", "1.1", "normative")], [("间距", "200", "mm", "")]
    rows = [
        ("i", wanted, fact, [("B", "2.2")], [("C", "3.3")], "B", "effective", "2.2 水", 1), ("i", wanted, fact, [("B", "2.2")], [("C", "3.3")], "A", "effective", "9.9 间距200mm", 2), ("i", wanted, fact, None, [("C", "3.3")], "C", "effective", "3.3 间距200mm", 3),
    ]
    judged = support.judge(spark.createDataFrame(rows, PAIR))
    got = {r.rank: (r.clause_hit, r.action, r.missing) for r in judged.collect()}
    assert got == {1: (True, "warn_insufficient_support", "fact"), 2: (False, "warn_insufficient_support", "clause"), 3: (False, "block_forbidden", "standard|clause|forbidden")}
    items = spark.createDataFrame([("i", fact)], "id string, required_facts array<struct<fact:string,value:string,unit:string,condition:string>>")
    at = {r.k: (r.support_ok, r.version_ok) for r in support.evaluated(judged, items, 3).collect()}
    assert at == {1: (False, True), 2: (True, True), 3: (False, False)}, "evidence adds up until a forbidden result spoils it"
