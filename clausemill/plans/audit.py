"""Queries that audit documents, citations and files, and the remaining joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.operators import audit as ops, lexical, search
from clausemill.session import read, read_wide

PARAGRAPHS = (
    ("curing conflict", 1, "养护不应少7天的要求"), ("curing conflict", 2, "养护时间不应少14天"), ("curing single", 1, "养护不应少7天"), ("compaction conflict", 1, "压实系数不小于0.95"), ("compaction conflict", 2, "压实系数不小于0.97"),
    ("compaction equal", 1, "压实系数不小于0.95"), ("compaction equal", 2, "压实系数≥0.95"), ("depth unit", 1, "最大开挖深度1.5m"), ("depth unit", 2, "开挖深度1500mm"), ("depth conflict", 1, "开挖深度3m"), ("depth conflict", 2, "开挖深度5m"),
    ("joint", 1, "灰缝10mm"), ("joint", 2, "灰缝12mm"), ("fullness", 1, "饱满度80%"), ("fullness", 2, "饱满度90%"), ("survival", 1, "成活率95%"), ("survival", 2, "成活率98%"), ("unrelated", 1, "本工程位于江苏省南京市"),
)
ANNOTATIONS = [(r"第\s*\d+(\.\d+)+\s*条", "clause"), (r"(GB|JGJ|CJJ|CECS|DB\d{2})", "standard_code"), (r"区别|对比", "comparison"), (r"废止|现行|版本|替代", "version"), (r"\d+(\.\d+)?(mm|m|d|h|kN|%)", "parameter")]


def a26_value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts in fixed paragraph sets."""
    rows = spark.createDataFrame(PARAGRAPHS, "name string, idx int, text string")
    return ops.value_conflicts(rows, "name", "idx", "text")


def a26_document_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts between the paragraphs of every document."""
    rows = read_wide(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("idx", "text"))
    return ops.value_conflicts(rows, "doc_id", "idx", "text")


def x29_broken_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that a standard's clause texts refer to but none of its files has."""
    texts = read(spark, sf_dir, "read_clause_full").select("rec_id", "standard_code", "clause_text").distinct().filter("clause_text is not null")
    mentioned = texts.select("standard_code", F.explode(ops.mentions(F.col("clause_text"))).alias("clause_no"))
    held = read(spark, sf_dir, "read_clause_full").select("standard_code", "clause_no")
    return ops.broken_references(mentioned, held, ["standard_code", "clause_no"])


def x24_citation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of a standard's clause in documents."""
    found = F.regexp_extract_all("text", F.lit(r"((?:GB|JGJ|CJJ|TCECS|CECS|DB\d{2})(?:/T)? \d{4,5}-\d{4}第\d+(?:\.\d+)+条)"), F.lit(1))
    rows = read_wide(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("cite"))
    return rows.select("doc_id", F.regexp_extract("cite", r"^(.*)第", 1).alias("official"), F.regexp_extract("cite", r"第(.*)条", 1).alias("clause_no")).groupBy("doc_id", "official", "clause_no").agg(F.count("*").alias("n"))


def x23_citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited clauses by how they are found: in the standard, only the standard, or not at all."""
    cites = x24_citation_mining(spark, sf_dir).withColumn("code", F.regexp_replace(F.regexp_replace("official", r"-\d{4}$", ""), "[/ ]", ""))
    clauses = read(spark, sf_dir, "read_clause_full").filter("clause_text <> ''").select(F.col("standard_code").alias("code"), "clause_no", F.lit(1).alias("exact")).distinct()
    held = read(spark, sf_dir, "standard_status").select(F.col("standard_code").alias("code"), F.lit(1).alias("known"))
    rows = cites.join(clauses, ["code", "clause_no"], "left").join(held, "code", "left")
    return rows.select("doc_id", "code", "clause_no", F.when(F.col("exact") == 1, "clause").when(F.col("known") == 1, "standard").otherwise("none").alias("tier"))


def x14_read_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause records with verdict and citation."""
    rows = read(spark, sf_dir, "read_clause_full").dropDuplicates(["rec_id"])
    error = F.coalesce(F.col("failure_reason"), F.lit("")) != ""
    deleted = F.coalesce(F.col("clause_text").contains("本条删除"), F.lit(False))
    verdict = ops.citation_verdict(error, F.col("version_status"), deleted, F.coalesce("source_file", F.lit("")) == "")
    return rows.select("rec_id", verdict.alias("verdict"), F.concat_ws(" ", "official_code", "clause_no").alias("citation"))


def x15_crossref_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short clauses that point at a clause of the same standard, with the clause pointed at."""
    rows = read(spark, sf_dir, "read_clause_full").select("rec_id", "standard_code", "clause_no", "clause_text").distinct().filter("clause_text is not null")
    short = rows.filter(F.length("clause_text") < 80).withColumn("to", F.regexp_extract("clause_text", r"第(\d+(?:\.\d+)+)[条款]", 1)).filter("to <> '' and to <> clause_no")
    target = rows.groupBy("standard_code", F.col("clause_no").alias("to")).agg(F.min("rec_id").alias("target_id"))
    return short.join(target, ["standard_code", "to"]).select("rec_id", "to", "target_id")


def x16_image_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in clause texts by how many of some words their clause holds."""
    rows = read(spark, sf_dir, "read_clause_full").select("rec_id", "clause_text").distinct().filter(F.col("clause_text").contains("images/"))
    words = F.array(*map(F.lit, ("应", "模板", "钢筋", "施工")))
    hits = F.size(F.filter(words, lambda w: F.col("clause_text").contains(w)))
    return rows.select("rec_id", F.explode(F.regexp_extract_all("clause_text", F.lit(r"\((images/[^)]+)\)"), F.lit(1))).alias("image"), hits.alias("hits")).filter("hits > 0")


def x27_chapter_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three headings of each file that hold a word of a topic, else its first."""
    rows = read(spark, sf_dir, "kb_search_index").select("file", "heading", "pos").distinct().filter("heading is not null")
    rows = rows.withColumn("hit", F.col("heading").rlike("脚手架|模板"))
    r = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("hit"), "pos", "heading"))
    return rows.withColumn("r", r).filter("(hit and r <= 3) or r = 1").select("file", "r", "heading", "hit")


def x30_standards_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards in force of two kinds of subject, no local ones, eighteen at most."""
    rows = read(spark, sf_dir, "standard_status").filter("status = 'effective' and standard_level <> 'local'").filter(F.col("standard_name").rlike("安全|质量"))
    return rows.orderBy(F.desc("year"), "standard_code").limit(18).select("standard_code", "standard_name", "year")


def x31_chapter_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans whose paragraphs cite too little or enough."""
    rows = read(spark, sf_dir, "plan_writer_citation_summary_sample").select("item_id", "plan_id", "para").distinct()
    return rows.groupBy("plan_id").agg(F.countDistinct("para").alias("paragraphs"), F.count("*").alias("citations")).withColumn("deep", F.col("citations") >= F.col("paragraphs") * 1.2)


def x33_auto_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged queries by the first pattern that fits."""
    rows = read(spark, sf_dir, "search_log").select("log_id", "q").distinct().filter("q is not null")
    return ops.first_rule(rows, "q", ANNOTATIONS).groupBy("label").agg(F.count("*").alias("n"))


def x34_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the log that are frequent, of ideographs, and not yet terms."""
    words = read(spark, sf_dir, "search_log").select("log_id", "q").distinct().select(F.explode(F.split(F.lower("q"), r"[\s　]+")).alias("word")).filter(F.col("word").rlike("^[一-鿿]{3,8}$"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 10")
    return counts.join(read(spark, sf_dir, "term_map").select(F.col("term").alias("word")), "word", "left_anti")


def x35_golden_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made from templates and the list of standards."""
    templates = spark.createDataFrame([("version", "%s 是否现行"), ("name", "%s 适用范围")], "kind string, template string")
    listed = read(spark, sf_dir, "standard_status").select("standard_code", "official_code")
    return listed.crossJoin(F.broadcast(templates)).select("standard_code", "kind", F.replace("template", F.lit("%s"), F.col("official_code")).alias("query"))


def x36_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported files held against their first import."""
    rows = read(spark, sf_dir, "kb_md").select("file", "imported_at", F.length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    first = rows.groupBy("file").agg(F.min_by("size", "imported_at").alias("size"), F.min_by("digest", "imported_at").alias("digest"))
    last = rows.groupBy("file").agg(F.max_by("size", "imported_at").alias("size"), F.max_by("digest", "imported_at").alias("digest"))
    return ops.tolerance_check(first, last, "file")


def x37_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections without a file, and files indexed before their last import."""
    index = read(spark, sf_dir, "kb_search_index").groupBy("file").agg(F.max("indexed_at").alias("indexed_at"))
    files = read(spark, sf_dir, "kb_md").groupBy("file").agg(F.max("imported_at").alias("imported_at"))
    both = index.join(files, "file", "full_outer")
    state = F.when(F.col("imported_at").isNull(), "orphan").when(F.col("indexed_at").isNull(), "unlinked").when(F.col("imported_at") > F.col("indexed_at") + F.expr("interval 1 hour"), "stale").otherwise("fresh")
    return both.select("file", state.alias("state"))


def w13_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by edition of their standard's code."""
    rows = read(spark, sf_dir, "kb_md").select("file").distinct()
    rows = rows.select("file", F.regexp_extract("file", r"_seg\d+_(\S+ \d+)-\d{4}", 1).alias("code"), F.regexp_extract("file", r"_seg\d+_\S+ \d+-(\d{4})", 1).cast("int").alias("year"))
    return ops.latest_versions(rows.filter("code <> ''"), "code", "year", "file").select("file", "state")


def a25_repeated_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs equal to the one before."""
    rows = read_wide(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "p"))
    before = F.lag("p").over(Window.partitionBy("doc_id").orderBy("i"))
    return rows.withColumn("same", (F.col("p") == before) & (F.length("p") > 0)).filter("same").groupBy("doc_id").agg(F.count("*").alias("n"))


def a30_type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of terms that titles of documents name at greatest length."""
    words = read(spark, sf_dir, "term_map").select(F.col("term").alias("word"), F.col("term_group").alias("kind"))
    rows = read(spark, sf_dir, "golden_queries").select("query_id", "query").distinct().filter("query is not null")
    return ops.longest_keyword(rows, "query_id", "query", words, "kind")


def j4_used_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards of the list that citations use."""
    used = read(spark, sf_dir, "plan_writer_citation_summary_sample").select("official_code").distinct()
    return read(spark, sf_dir, "standard_status").join(used, "official_code", "left_semi").select("standard_code")


def j5_unused_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards of the list that no citation uses."""
    used = read(spark, sf_dir, "plan_writer_citation_summary_sample").select("official_code").distinct()
    return read(spark, sf_dir, "standard_status").join(used, "official_code", "left_anti").select("standard_code")


def j9_bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards for which a group of terms is in a file: the first group by name."""
    rows = read(spark, sf_dir, "kb_search_index").select("file", "heading").distinct().filter("heading is not null")
    hits = lexical.contained(rows, "heading", read(spark, sf_dir, "term_map"), "term", "term_group")
    return hits.groupBy("file").agg(F.min("term_group").alias("first_group"), F.countDistinct("term_group").alias("n_groups"))


def j10_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each document's standard: from the list, else from a file, else none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("standard_code").alias("code"))
    listed = read(spark, sf_dir, "standard_status").select(F.col("standard_code").alias("code"), F.col("standard_name").alias("a"))
    held = read(spark, sf_dir, "kb_md").filter("standard_code is not null and title is not null").groupBy(F.col("standard_code").alias("code")).agg(F.min("title").alias("b"))
    tier = F.when(F.col("a").isNotNull(), "list").when(F.col("b").isNotNull(), "file").otherwise("none")
    return docs.join(listed, "code", "left").join(held, "code", "left").select("doc_id", F.coalesce("a", "b").alias("name"), tier.alias("tier"))


def j13_scalar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that took three times the mean."""
    logs = read(spark, sf_dir, "search_log").dropDuplicates(["log_id"]).select("log_id", "duration_ms")
    mean = logs.agg(F.avg("duration_ms").alias("mean"))
    return logs.crossJoin(F.broadcast(mean)).filter("duration_ms > 3 * mean").select("log_id")


def u4_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes on both sides and on one side of the list and the files."""
    listed = read(spark, sf_dir, "standard_status").select("standard_code")
    held = read(spark, sf_dir, "kb_md").select("standard_code").filter("standard_code is not null").distinct()
    both = listed.intersect(held).withColumn("side", F.lit("both"))
    return both.unionByName(listed.exceptAll(held).withColumn("side", F.lit("list"))).unionByName(held.exceptAll(listed).withColumn("side", F.lit("files")))


def u5_heading_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the index with those of clause records that it doesn't have, by their first forty signs."""
    norm = lambda c: F.substring(F.regexp_replace(c, r"\s+", ""), 1, 40)
    a = read(spark, sf_dir, "kb_search_index").select(norm("heading").alias("h")).filter("h <> ''").distinct()
    b = read(spark, sf_dir, "read_clause_full").select(norm("source_heading").alias("h")).filter("h <> ''").distinct()
    return a.withColumn("origin", F.lit("index")).unionByName(b.join(a, "h", "left_anti").withColumn("origin", F.lit("records"))).groupBy("origin").agg(F.count("*").alias("n"))


def u6_distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found codes without repeats, in order."""
    rows = read(spark, sf_dir, "search_log").dropDuplicates(["log_id"]).filter("c is not null")
    return rows.select("log_id", F.array_join(F.array_distinct(F.filter("c", lambda x: x.isNotNull())), "|").alias("codes"))


def f35_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and long hashes of file texts."""
    return read_wide(spark, sf_dir, "kb_md").select("file", F.substring(F.md5("text"), 1, 8).alias("short"), F.sha2("text", 256).alias("long")).distinct()


def f37_document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six runs of ideographs of a title that hold no stop word."""
    runs = F.filter(F.regexp_extract_all("title", F.lit("([一-鿿]{2,})"), F.lit(1)), lambda r: ~r.rlike("的|关于|汇总"))
    return read(spark, sf_dir, "documents").filter("title is not null").select("doc_id", F.array_join(F.slice(runs, 1, 6), " ").alias("keywords"))


def f38_citable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents that give a value but no source, by document."""
    rows = read_wide(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n\n", -1)).alias("p"))
    citable = (F.length("p") >= 20) & F.col("p").rlike(r"\d+(\.\d+)?\s*(mm|m|kN|d|h|%|℃)") & ~F.col("p").rlike(r"(GB|JGJ|CJJ|CECS|DB\d{2})(/T)? ?\d{4}")
    return rows.filter(citable).groupBy("doc_id").agg(F.count("*").alias("n"))


def f39_order_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of candidates in answers: written out, else the first letters named."""
    rows = spark.createDataFrame([("B>A>C",), ("排序：C > A > B。",), ("A 最好，其次 C",), ("无",)], "raw string")
    written = F.regexp_extract("raw", r"([ABC]\s*>\s*[ABC]\s*>\s*[ABC])", 1)
    named = F.slice(F.array_distinct(F.regexp_extract_all("raw", F.lit("([ABC])"), F.lit(1))), 1, 3)
    return rows.select("raw", F.when(written != "", F.regexp_replace(written, r"\s", "")).otherwise(F.array_join(named, ">")).alias("ranking"))


def s7_split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges into which long segments are cut."""
    from clausemill.sources.files import split_plan

    rows = read(spark, sf_dir, "kb_md").select("file", (F.regexp_extract("file", r"_p\d+-(\d+)_", 1).try_cast("int")).alias("pages")).distinct().filter("pages is not null")
    return rows.select("file", F.inline(split_plan(F.col("pages") * 0.5, F.col("pages"))))


def x4_preferred_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose front matter has a tag that is asked for, with the gain of their score."""
    tags = F.split(F.regexp_replace(F.regexp_extract("text", r"(?m)^tags:\s*\[(.*?)\]", 1), r"\s", ""), ",")
    rows = read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"])
    boosted = F.arrays_overlap(tags, F.array(F.lit("管道试压"), F.lit("张拉")))
    return rows.select("file", F.when(boosted, search.TAG_GAIN).otherwise(1.0).alias("gain"))


QUERIES = {
    f.__name__: f
    for f in (
        a26_value_conflicts, a26_document_conflicts, x29_broken_refs, x24_citation_mining, x23_citation_resolution, x14_read_clause, x15_crossref_hop, x16_image_search, x27_chapter_recommendation, x30_standards_list, x31_chapter_depth, x33_auto_annotation,
        x34_term_candidates, x35_golden_templates, x36_integrity, x37_provenance, w13_latest_versions, a25_repeated_neighbours, a30_type_scores, j4_used_standards, j5_unused_standards, j9_bridge_join, j10_fallback_chain, j13_scalar_join,
        u4_set_operations, u5_heading_merge, u6_distinct_in_order, f35_fingerprints, f37_document_keywords, f38_citable, f39_order_parse, s7_split_plan, x4_preferred_tags,
    )
}


def _conflicts(rows: str, key: str, place: str) -> str:
    parts = []
    for name, pattern, least, most, level in ops.VALUE_RULES:
        raw = f"regexp_extract(text, '{pattern}', 1)"
        value = rf"try_cast(regexp_extract({raw}, '(\d+(?:\.\d+)?)', 1) as double) / case when {raw} like '%mm' then 1000 else 1 end"
        parts.append(f"select {key}, {place}, '{name}' as rule, '{level}' as level, {value} as value from {rows} where {value} >= {least} and {value} <= {most}")
    return f"v as ({' union all '.join(parts)}) select {key}, rule, level, array_to_string(list_transform(list_sort(list(distinct value)), lambda x: cast(x as varchar)), '|') as found, array_to_string(list_sort(list(distinct {place})), '|') as places from v group by {key}, rule, level having count(distinct value) > 1"


_PARAS = ", ".join(f"('{n}', {i}, '{t}')" for n, i, t in PARAGRAPHS)
_R = "rc as (select distinct on (rec_id) * from read_clause_full)"
_CITES = r"ct as (select doc_id, regexp_extract(c, '^(.*)第', 1) as official, regexp_extract(c, '第(.*)条', 1) as clause_no, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '(?:GB|JGJ|CJJ|TCECS|CECS|DB\d{2})(?:/T)? \d{4,5}-\d{4}第\d+(?:\.\d+)+条')) as c from documents) u group by all)"
_RULES = "case " + " ".join(f"when regexp_matches(q, '{p}') then '{n}'" for p, n in ANNOTATIONS) + " end"
ORACLES = {
    "a26_value_conflicts": f"with p as (select * from (values {_PARAS}) t(name, idx, text)), {_conflicts('p', 'name', 'idx')}",
    "a26_document_conflicts": f"with p as (select doc_id, unnest(range(0, len(s))) as idx, unnest(s) as text from (select doc_id, string_split(text, chr(10) || chr(10)) as s from documents) u), {_conflicts('p', 'doc_id', 'idx')}",
    "x29_broken_refs": rf"with {_R}, m as (select distinct standard_code, unnest(regexp_extract_all(clause_text, '第\s*(\d+(?:\.\d+)+)\s*[条款节]', 1)) as clause_no from rc where clause_text is not null) select standard_code, clause_no from m where not exists (select 1 from rc where rc.standard_code = m.standard_code and rc.clause_no = m.clause_no)",
    "x24_citation_mining": f"with {_CITES} select * from ct",
    "x23_citation_resolution": rf"with {_R}, {_CITES}, k as (select *, replace(replace(regexp_replace(official, '-\d{{4}}$', ''), '/', ''), ' ', '') as code from ct) select doc_id, code, clause_no, case when exists (select 1 from rc where rc.standard_code = code and rc.clause_no = k.clause_no and clause_text <> '') then 'clause' when code in (select standard_code from standard_status) then 'standard' else 'none' end as tier from k",
    "x14_read_clause": f"with {_R} select rec_id, case when coalesce(failure_reason, '') <> '' or version_status = 'abolished' or coalesce(contains(clause_text, '本条删除'), false) then 'fail' when coalesce(source_file, '') = '' or coalesce(version_status in ('superseded', 'unknown'), true) then 'warn' else 'pass' end as verdict, concat_ws(' ', official_code, clause_no) as citation from rc",
    "x15_crossref_hop": rf"with {_R}, s as (select rec_id, standard_code, clause_no, regexp_extract(clause_text, '第(\d+(?:\.\d+)+)[条款]', 1) as tt from rc where clause_text is not null and length(clause_text) < 80), t as (select standard_code, clause_no, min(rec_id) as target_id from rc where clause_text is not null group by all) select rec_id, tt as \"to\", target_id from s join t on s.standard_code = t.standard_code and s.tt = t.clause_no where tt <> '' and tt <> s.clause_no".replace('\\"', '"'),
    "x16_image_search": rf"with {_R}, i as (select rec_id, unnest(regexp_extract_all(clause_text, '\((images/[^)]+)\)', 1)) as image, len(list_filter(['应', '模板', '钢筋', '施工'], lambda w: contains(clause_text, w))) as hits from rc where contains(clause_text, 'images/')) select * from i where hits > 0",
    "x27_chapter_recommendation": "with r as (select distinct file, heading, pos from kb_search_index where heading is not null), h as (select *, regexp_matches(heading, '脚手架|模板') as hit from r), k as (select *, row_number() over (partition by file order by hit desc, pos, heading) as r from h) select file, r, heading, hit from k where hit and r <= 3 or r = 1",
    "x30_standards_list": "select standard_code, standard_name, year from standard_status where status = 'effective' and standard_level <> 'local' and regexp_matches(standard_name, '安全|质量') order by year desc nulls last, standard_code limit 18",
    "x31_chapter_depth": "with r as (select distinct item_id, plan_id, para from plan_writer_citation_summary_sample) select plan_id, count(distinct para) as paragraphs, count(*) as citations, count(*) >= count(distinct para) * 1.2 as deep from r group by plan_id",
    "x33_auto_annotation": f"with q as (select distinct log_id, q from search_log where q is not null) select {_RULES} as label, count(*) as n from q group by 1",
    "x34_term_candidates": "with w as (select unnest(regexp_split_to_array(lower(q), '[\\s　]+')) as word from (select distinct log_id, q from search_log) u) select word, count(*) as n from w where regexp_matches(word, '^[一-鿿]{3,8}$') and word not in (select term from term_map) group by word having count(*) >= 10",
    "x35_golden_templates": "select standard_code, kind, replace(template, '%s', official_code) as query from standard_status, (values ('version', '%s 是否现行'), ('name', '%s 适用范围')) t(kind, template)",
    "x36_integrity": "with f as (select file, arg_min(length(text), imported_at) as a, arg_max(length(text), imported_at) as b, arg_min(sha256(text), imported_at) as da, arg_max(sha256(text), imported_at) as db from kb_md group by file) select file, case when abs(a - b) > 0.01 * a then 'size' when da is distinct from db then 'content' else 'same' end as state from f",
    "x37_provenance": "with i as (select file, max(indexed_at) as t from kb_search_index group by 1), f as (select file, max(imported_at) as m from kb_md group by 1) select coalesce(i.file, f.file) as file, case when m is null then 'orphan' when t is null then 'unlinked' when m > t + interval 1 hour then 'stale' else 'fresh' end as state from i full join f on i.file = f.file",
    "w13_latest_versions": r"with r as (select distinct file, regexp_extract(file, '_seg\d+_(\S+ \d+)-\d{4}', 1) as code, regexp_extract(file, '_seg\d+_\S+ \d+-(\d{4})', 1) as year from kb_md) select file, case when year < max(year) over (partition by code) then 'old' when row_number() over (partition by code, year order by file) > 1 then 'duplicate' else 'latest' end as state from r where code <> ''",
    "a25_repeated_neighbours": "with p as (select doc_id, unnest(range(0, len(s))) as i, unnest(s) as p from (select doc_id, string_split(text, chr(10)) as s from documents) u), l as (select *, lag(p) over (partition by doc_id order by i) as b from p) select doc_id, count(*) as n from l where p = b and length(p) > 0 group by doc_id",
    "a30_type_scores": "with q as (select distinct query_id, query from golden_queries where query is not null), b as (select query_id, term_group as kind, max(length(term)) as score from q join term_map on contains(query, term) group by all), t as (select *, max(score) over (partition by query_id) as best from b), r as (select *, row_number() over (partition by query_id order by kind) as r from t where score = best) select query_id, kind, score from r where r <= 3",
    "j4_used_standards": "select standard_code from standard_status where official_code in (select official_code from plan_writer_citation_summary_sample)",
    "j5_unused_standards": "select standard_code from standard_status s where not exists (select 1 from plan_writer_citation_summary_sample c where c.official_code = s.official_code)",
    "j9_bridge_join": "with h as (select distinct file, heading from kb_search_index where heading is not null) select file, min(term_group) as first_group, count(distinct term_group) as n_groups from h join term_map on contains(heading, term) group by file",
    "j10_fallback_chain": "with k as (select standard_code, min(title) as b from kb_md where standard_code is not null and title is not null group by 1) select doc_id, coalesce(standard_name, b) as name, case when standard_name is not null then 'list' when b is not null then 'file' else 'none' end as tier from documents d left join standard_status s on d.standard_code = s.standard_code left join k on d.standard_code = k.standard_code",
    "j13_scalar_join": "with l as (select log_id, any_value(duration_ms) as d from search_log group by 1) select log_id from l where d > 3 * (select avg(d) from l)",
    "u4_set_operations": "with l as (select standard_code from standard_status), h as (select distinct standard_code from kb_md where standard_code is not null) select standard_code, 'both' as side from l where standard_code in (select * from h) union all select standard_code, 'list' from l where standard_code not in (select * from h) union all select standard_code, 'files' from h where standard_code not in (select * from l)",
    "u5_heading_merge": r"with a as (select distinct substr(regexp_replace(heading, '\s+', '', 'g'), 1, 40) as h from kb_search_index), b as (select distinct substr(regexp_replace(source_heading, '\s+', '', 'g'), 1, 40) as h from read_clause_full) select 'index' as origin, count(*) as n from a where h <> '' union all select 'records', count(*) from b where h <> '' and h not in (select h from a where h is not null)",
    "u6_distinct_in_order": "with l as (select log_id, any_value(c) as c from search_log group by 1) select log_id, array_to_string(list_filter(c, lambda x, i: x is not null and list_position(c, x) = i), '|') as codes from l where c is not null",
    "f35_fingerprints": 'select distinct file, substr(md5(text), 1, 8) as short, sha256(text) as "long" from kb_md',
    "f37_document_keywords": "select doc_id, array_to_string(list_filter(regexp_extract_all(title, '[一-鿿]{2,}'), lambda r: not regexp_matches(r, '的|关于|汇总'))[1:6], ' ') as keywords from documents where title is not null",
    "f38_citable": r"with p as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as p from documents) select doc_id, count(*) as n from p where length(p) >= 20 and regexp_matches(p, '\d+(\.\d+)?\s*(mm|m|kN|d|h|%|℃)') and not regexp_matches(p, '(GB|JGJ|CJJ|CECS|DB\d{2})(/T)? ?\d{4}') group by doc_id",
    "f39_order_parse": r"with r as (select * from (values ('B>A>C'), ('排序：C > A > B。'), ('A 最好，其次 C'), ('无')) v(raw)), w as (select raw, regexp_extract(raw, '([ABC]\s*>\s*[ABC]\s*>\s*[ABC])', 1) as w, regexp_extract_all(raw, '[ABC]') as l from r) select raw, case when w <> '' then replace(w, ' ', '') else array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '>') end as ranking from w",
    "s7_split_plan": r"""with r as (select distinct file, try_cast(regexp_extract(file, '_p\d+-(\d+)_', 1) as int) as pages from kb_md), p as (select file, pages, cast(greatest(ceil(pages / 200), ceil(pages * 0.5 / 200.0), 1) as int) as parts from r where pages is not null),
s as (select *, cast(ceil(pages / parts) as int) as step from p), x as (select file, pages, step, unnest(range(1, parts + 1)) as k from s) select file, cast((k - 1) * step + 1 as int) as first, cast(least(k * step, pages) as int) as last from x where (k - 1) * step + 1 <= least(k * step, pages)""",
    "x4_preferred_tags": r"with f as (select file, any_value(text) as t from kb_md group by file) select file, cast(case when len(list_intersect(string_split(regexp_replace(regexp_extract(t, '(?m)^tags:\s*\[(.*?)\]', 1), '\s', '', 'g'), ','), ['管道试压', '张拉'])) > 0 then 1.15 else 1.0 end as double) as gain from f",
}
