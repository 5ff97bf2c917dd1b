"""Queries over sources on small fixtures, expansion, lattice matches, heading scores and clause reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.operators import lexical, sections
from clausemill.session import read, read_wide
from clausemill.sources import files

LAYOUT = (
    ("a", '[{"type":"text","text":"1 总则","page_idx":0,"text_level":1},{"type":"header","text":"GB 50204","page_idx":0},{"type":"list","text":"","page_idx":1,"list_items":["1 甲","2 乙"]},{"type":"text","text":"正文内容","page_idx":1}]'),
    ("b", '[{"type":"text","text":"第二","page_idx":3},{"type":"text","text":"第一段","page_idx":2},{"type":"image","text":"","page_idx":2}]'), ("c", "no json"), ("d", None),
)
STATUS_PAGE = '<table><tr><th>标准号</th><th>状态</th></tr><tr><td>GB <b>50204</b>-2015</td><td> 现行 </td></tr></table>'


def _layout(spark: SparkSession) -> DataFrame:
    return files.layout_blocks(spark.createDataFrame(LAYOUT, "name string, content string"), "name", "content")


def s4_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts of layout files, by page."""
    return files.full_text(_layout(spark), "name")


def s5_running_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks that carry running text."""
    return files.running_text(_layout(spark)).select("name", "idx", "text")


def s10_status_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a status page."""
    rows = spark.createDataFrame([(STATUS_PAGE,)], "html string").select(F.posexplode(files.status_cells(F.col("html"))).alias("i", "cells"))
    return rows.select("i", F.array_join("cells", "|").alias("cells"))


def d2_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of golden queries with the synonyms of the terms among them."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", F.explode(F.split("query", r"[\s　]+")).alias("word")).distinct().filter("word <> ''")
    synonyms = read(spark, sf_dir, "term_map").select(F.col("term").alias("word"), F.explode("syn").alias("syn"))
    return asked.join(synonyms, "word").select("query_id", "word", "syn")


def d8_lattice_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substrings of two to seven signs of golden queries that are terms, with their weight by the files they lead to."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "query").distinct().filter(F.length("query") >= 2)
    starts = F.sequence(F.lit(1), F.length("query") - 1)
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(7), F.length("query") - i + 1)), lambda n: F.substr("query", i, n))))
    texts = asked.select("query_id", F.explode(F.array_distinct(pieces)).alias("term"))
    index = read(spark, sf_dir, "kb_search_index").select("file", "heading").distinct().filter("heading is not null")
    degree = lexical.contained(index, "heading", read(spark, sf_dir, "term_map"), "term").groupBy("term").agg(F.countDistinct("file").alias("files"))
    terms = read(spark, sf_dir, "term_map").select("term").join(degree, "term", "left")
    return texts.join(terms, "term").select("query_id", "term", F.round(F.log(1 + 5 / F.greatest(F.coalesce("files", F.lit(0)), F.lit(1))), 6).alias("weight"))


def w3_body_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the body of each file begins."""
    at = sections.lines(read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"]), "file", "text")
    toc = F.min(F.when(F.col("line").rlike(sections.TOC_LINE), F.col("pos"))).over(Window.partitionBy("file"))
    at = at.withColumn("toc", toc).filter(F.col("line").rlike(sections.BODY_LINE) & (F.col("pos") > F.coalesce("toc", F.lit(-1))))
    return at.groupBy("file").agg(F.min("pos").alias("body_start"))


def w15_heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that look like headings: short, numbered, before a longer line, unlike the file's usual length."""
    at = sections.lines(read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"]), "file", "text").filter("line <> ''")
    n = F.length("line")
    usual = at.groupBy("file").agg(F.avg(n).alias("mean"))
    rows = at.join(usual, "file").withColumn("next", F.lead(n).over(Window.partitionBy("file").orderBy("line_no")))
    score = (n < 30).cast("int") + F.col("line").rlike(r"^(#{1,3}\s+)?(\d+(\.\d+)*|附录)\s").cast("int") * 2 + F.coalesce(F.col("next") > n, F.lit(False)).cast("int") + (n * 2 < F.col("mean")).cast("int")
    return rows.withColumn("score", score).groupBy("file", "score").agg(F.count("*").alias("n"))


def x13_located_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered clauses of the files: from their line up to the next numbered line or heading."""
    at = sections.lines(read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"]), "file", "text")
    own = Window.partitionBy("file").orderBy("line_no")
    head = F.col("line").rlike(r"^#{1,3}\s|^\d+\.\d+(\.\d+)*\s")
    block = F.sum(head.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = at.withColumn("block", block).withColumn("number", F.regexp_extract("line", r"^(\d+\.\d+\.\d+)\s", 1))
    found = rows.groupBy("file", "block").agg(F.max("number").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return found.filter("number <> ''").select("file", "block", "number", F.length("body").alias("chars"), F.md5("body").alias("fingerprint"))


def a20_citation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of citations by kind: unknown codes, missing clauses, states, values."""
    rows = read(spark, sf_dir, "plan_writer_citation_summary_sample").dropDuplicates(["item_id"])
    listed = read(spark, sf_dir, "standard_status").select("official_code", F.lit(True).alias("known"))
    rows = rows.join(listed, "official_code", "left")
    issue = lambda kind, when: rows.filter(when).select("plan_id", "item_id", F.lit(kind).alias("issue"))
    out = issue("unknown_code", F.col("official_code").isNotNull() & F.col("known").isNull())
    out = out.unionByName(issue("clause", ~F.coalesce("in_clause", F.lit(True)))).unionByName(issue("version", F.col("version_status").isin("abolished", "superseded")))
    return out.unionByName(issue("value", F.array_contains("review_reasons", "value_mismatch"))).groupBy("plan_id", "issue").agg(F.count("*").alias("n"))


def x26_citation_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause of its standard for each document that names one of its terms: the first record."""
    terms = read(spark, sf_dir, "term_map")
    hit = lambda frame, key, text: lexical.contained(frame, text, terms, "term").select(*key, "term")
    clauses = read_wide(spark, sf_dir, "read_clause_full").select("rec_id", "standard_code", "clause_text").distinct().filter("clause_text is not null")
    best = hit(clauses, ["rec_id", "standard_code"], "clause_text").groupBy("standard_code", "term").agg(F.min("rec_id").alias("rec_id"))
    docs = hit(read_wide(spark, sf_dir, "documents").select("doc_id", "standard_code", "text"), ["doc_id", "standard_code"], "text")
    return docs.join(best, ["standard_code", "term"]).groupBy("doc_id").agg(F.countDistinct("term").alias("terms"), F.min("rec_id").alias("rec_id"))


def bm25_parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of one term in every clause over a grid of k1 and b: the best clause of each setting."""
    from clausemill.operators.lexical import term_count, token_count

    grid = spark.createDataFrame([(k, b) for k in (0.9, 1.2, 1.5, 2.0) for b in (0.3, 0.5, 0.75, 1.0)], "k1 double, b double")
    rows = read_wide(spark, sf_dir, "read_clause_full").select("rec_id", "clause_text").distinct().filter("clause_text <> ''")
    rows = rows.select("rec_id", token_count(F.col("clause_text")).alias("dl"), term_count(F.col("clause_text"), "模板").alias("tf"))
    mean = rows.agg(F.avg("dl").alias("avgdl"))
    scored = rows.filter("tf > 0").crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(grid))
    score = F.round(F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("dl") / F.col("avgdl"))), 5)
    return scored.withColumn("score", score).groupBy("k1", "b").agg(F.max("score").alias("score"), F.min_by("rec_id", F.struct(-F.col("score"), "rec_id")).alias("rec_id"))


QUERIES = {f.__name__: f for f in (s4_layout_text, s5_running_blocks, s10_status_cells, d2_expansion, d8_lattice_matches, w3_body_start, w15_heading_scores, x13_located_clauses, a20_citation_issues, x26_citation_suggestions, bm25_parameter_grid)}

_FILES = "files as (select file, any_value(text) as body, any_value(length(text)) as size from kb_md group by file)"
_LINES = f"{_FILES}, split as (select file, string_split(body, chr(10)) as ls from files), ls as (select file, unnest(range(0, len(ls))) as line_no, unnest(ls) as line from split), lines as (select *, cast(coalesce(sum(length(line) + 1) over (partition by file order by line_no rows between unbounded preceding and 1 preceding), 0) as int) as pos from ls)"
ORACLES = {
    "s4_layout_text": "select * from (values ('a', '1 总则' || chr(10) || 'GB 50204' || chr(10) || '1 甲' || chr(10) || '2 乙' || chr(10) || '正文内容'), ('b', '第一段' || chr(10) || '第二')) v(name, text)",
    "s5_running_blocks": "select * from (values ('a', 0, '1 总则'), ('a', 3, '正文内容'), ('b', 1, '第一段')) v(name, idx, text)",
    "s10_status_cells": "select * from (values (0, '标准号|状态'), (1, 'GB 50204-2015|现行')) v(i, cells)",
    "d2_expansion": "with q as (select distinct query_id, unnest(regexp_split_to_array(query, '[\\s　]+')) as word from golden_queries), t as (select term as word, unnest(syn) as syn from term_map) select query_id, word, syn from q join t using (word) where word <> ''",
    "d8_lattice_matches": "with q as (select distinct query_id, query from golden_queries), d as (select term, count(distinct file) as files from kb_search_index join term_map on contains(heading, term) group by term) select query_id, m.term, round(ln(1 + 5 / greatest(coalesce(files, 0), 1)), 6) as weight from q join term_map m on contains(query, m.term) and length(m.term) between 2 and 7 left join d on d.term = m.term",
    "w3_body_start": f"with {_LINES}, t as (select *, min(case when regexp_matches(line, '{sections.TOC_LINE}') then pos end) over (partition by file) as toc from lines) select file, min(pos) as body_start from t where regexp_matches(line, '{sections.BODY_LINE}') and pos > coalesce(toc, -1) group by file",
    "w15_heading_scores": rf"with {_LINES}, m as (select *, avg(length(line)) over (partition by file) as mean, lead(length(line)) over (partition by file order by line_no) as nx from lines where line <> ''), s as (select file, (length(line) < 30)::int + regexp_matches(line, '^(#{{1,3}}\s+)?(\d+(\.\d+)*|附录)\s')::int * 2 + coalesce(nx > length(line), false)::int + (length(line) * 2 < mean)::int as score from m) select file, score, count(*) as n from s group by all",
    "x13_located_clauses": rf"with {_LINES}, b as (select *, sum(regexp_matches(line, '^#{{1,3}}\s|^\d+\.\d+(\.\d+)*\s')::int) over (partition by file order by line_no) as block, regexp_extract(line, '^(\d+\.\d+\.\d+)\s', 1) as number from lines), g as (select file, block, max(number) as number, string_agg(line, chr(10) order by line_no) as body from b group by all) select file, block, number, length(body) as chars, md5(body) as fingerprint from g where number <> ''",
    "a20_citation_issues": "with r as (select distinct on (item_id) * from plan_writer_citation_summary_sample), i as (select plan_id, 'unknown_code' as issue from r where official_code is not null and official_code not in (select official_code from standard_status) union all select plan_id, 'clause' from r where not coalesce(in_clause, true) union all select plan_id, 'version' from r where version_status in ('abolished', 'superseded') union all select plan_id, 'value' from r where list_contains(review_reasons, 'value_mismatch')) select plan_id, issue, count(*) as n from i group by all",
    "x26_citation_suggestions": "with c as (select standard_code, term, min(rec_id) as rec_id from read_clause_full join term_map on contains(clause_text, term) group by all) select doc_id, count(distinct c.term) as terms, min(rec_id) as rec_id from documents d join c on d.standard_code = c.standard_code and contains(d.text, c.term) group by doc_id",
    "bm25_parameter_grid": r"""with g as (select * from (select unnest([0.9, 1.2, 1.5, 2.0])::double as k1) a, (select unnest([0.3, 0.5, 0.75, 1.0])::double as b) c), r as (select distinct rec_id, clause_text as t from read_clause_full where clause_text <> ''),
k as (select rec_id, len(regexp_extract_all(lower(t), '[a-z0-9]{2,}')) + coalesce(list_sum(list_transform(regexp_extract_all(t, '[一-鿿]{2,}'), lambda x: length(x) - 1)), 0) as dl, (length(t) - length(replace(t, '模板', ''))) / 2 as tf from r),
s as (select k1, b, rec_id, round(tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (select avg(dl) from k))), 5) as score from k, g where tf > 0), o as (select *, row_number() over (partition by k1, b order by score desc, rec_id) as n from s) select k1, b, score, rec_id from o where n = 1""",
}
