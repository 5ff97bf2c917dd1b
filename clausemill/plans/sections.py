"""Queries over files, sections and clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.functions.codes import extract_standard
from clausemill.operators import sections as ops
from clausemill.session import read, read_wide


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"])


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "kb_search_index").select("section_id", "file", "sid", "heading", "pos", "type", "leaf").distinct()


def s1_list_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the size of their text."""
    return _files(spark, sf_dir).select("file", F.length("text").alias("chars"))


def w1_line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every file by offset, as counts and sums a file."""
    at = ops.lines(_files(spark, sf_dir), "file", "text")
    return at.groupBy("file").agg(F.count("*").alias("n_lines"), F.sum("pos").alias("pos_sum"), F.max(F.col("pos") + F.length("line")).alias("last_end"))


def w4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every file."""
    return ops.sections(_files(spark, sf_dir), "file", "text")


def w1_section_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the indexed sections by the next position, beside the stored one."""
    rows = read(spark, sf_dir, "kb_search_index").select("section_id", "file", "pos", "length").distinct()
    files = _files(spark, sf_dir).select("file", F.length("text").alias("size"))
    order = ops.Window.partitionBy("file").orderBy("pos")
    out = rows.join(files, "file").withColumn("true_length", F.coalesce(F.lead("pos").over(order), F.col("size")) - F.col("pos"))
    return out.select("section_id", "true_length", F.coalesce(F.col("length") != F.col("true_length"), F.lit(True)).alias("stale"))


def f8_front_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that are front matter or contents, by file."""
    at = ops.lines(_files(spark, sf_dir), "file", "text").withColumn("heading", F.regexp_extract("line", ops.HEADING, 1)).filter("heading <> ''")
    return at.filter(ops.is_front_heading(F.trim("heading"))).groupBy("file").agg(F.count("*").alias("n"))


def f9_toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are table-of-contents entries: short, or two of the first five lines like one."""
    head = F.slice(F.split("text", "\n", -1), 1, 5)
    like = F.size(F.filter(head, lambda x: x.rlike(r"(…{1,}|\.{3,})\s*\d+\s*$")))
    entry = (F.length("text") < 50) | (F.size(F.split("text", "\n", -1)) >= 3) & (like >= 2)
    return _files(spark, sf_dir).select("file", entry.alias("is_toc"))


def f10_front_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without what stands before the first chapter, if that is near the start."""
    found = F.when(F.col("text").startswith("# 1 总则\n"), 1).otherwise(F.instr("text", "\n# 1 总则\n") + 1)
    near = (found > 1) & (found <= F.least(F.lit(500), F.length("text")))
    return _files(spark, sf_dir).select("file", F.when(near, F.length("text") - found + 1).otherwise(F.length("text")).alias("kept"))


def w2_section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by type and kind."""
    return w4_sections(spark, sf_dir).groupBy("type", "leaf").agg(F.count("*").alias("n"), F.sum("length").alias("chars"))


def w5_clause_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sections of the index with their parents."""
    return ops.clauses(_index(spark, sf_dir), "file").select("section_id", "number", "parent", "title")


def w6_clause_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that a standard's clause number stands for."""
    stem = F.regexp_replace("file", r"_\d+\.md$", "")
    rows = ops.clauses(_index(spark, sf_dir), "file").withColumn("code", extract_standard(stem)["standard_code"])
    best = ops.keep_best(rows, ["code", "number"], ops.type_priority(F.col("type")), "file", "pos")
    return best.select("code", "number", "section_id", "type")


def j7_section_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that holds each table row of a file."""
    files = _files(spark, sf_dir)
    points = ops.lines(files, "file", "text").filter(F.col("line").startswith("| ")).select("file", "line_no", F.col("pos").alias("at"))
    order = ops.Window.partitionBy("file").orderBy("pos")
    spans = _index(spark, sf_dir).join(files.select("file", F.length("text").alias("size")), "file")
    spans = spans.withColumn("length", F.coalesce(F.lead("pos").over(order), F.col("size")) - F.col("pos"))
    return ops.section_at(points, spans, "file", "at").groupBy("file", "sid").agg(F.count("*").alias("n_rows"))


def j8_asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign-up of a user at or before each error."""
    events = read(spark, sf_dir, "events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    marks = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("heading_id"))
    marks = marks.groupBy("user_id", "ts").agg(F.max("heading_id").alias("heading_id"))
    return ops.last_before(errors, marks, ["user_id"], "ts", "heading_id").filter("heading_id is not null").select("event_id", "heading_id")


def w17_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter of every section: the last heading of one number before it."""
    order = ops.Window.partitionBy("file").orderBy("pos").rowsBetween(ops.Window.unboundedPreceding, 0)
    chapter = F.last(F.nullif(F.regexp_extract("heading", r"^(\d+)\s", 1), F.lit("")), ignorenulls=True).over(order)
    return _index(spark, sf_dir).select("section_id", chapter.alias("chapter"))


def w18_section_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of numbered sections, and the shortest of equal titles in a file."""
    rows = ops.clauses(_index(spark, sf_dir), "file").withColumn("depth", F.length("number") - F.length(F.replace("number", F.lit("."), F.lit(""))) + 1)
    best = ops.keep_best(rows.filter("title <> ''"), ["file", "title"], F.length("number"), "pos")
    return best.select("file", "title", "number", "depth")


def s12_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to index and sections to drop: those on one side only."""
    files, indexed = read(spark, sf_dir, "kb_md").select("file").distinct(), read(spark, sf_dir, "read_clause_full").filter("source_file <> ''").select(F.col("source_file").alias("file")).distinct()
    new = files.join(indexed, "file", "left_anti").select("file", F.lit("add").alias("action"))
    return new.unionByName(indexed.join(files, "file", "left_anti").select("file", F.lit("drop").alias("action")))


def s14_preferred_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of files, supplemented by those of the list of standards for codes without a file."""
    held = read(spark, sf_dir, "kb_md").filter("standard_code is not null and title is not null").groupBy("standard_code").agg(F.min("title").alias("name"))
    listed = read(spark, sf_dir, "standard_status").select("standard_code", F.col("standard_name").alias("name"))
    return held.withColumn("origin", F.lit("file")).unionByName(listed.join(held, "standard_code", "left_anti").withColumn("origin", F.lit("list")))


def s13_renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for imported standards; a name that is taken gets a number."""
    rows = read(spark, sf_dir, "kb_md").filter("title is not null").select("file", "title").distinct()
    n = F.row_number().over(ops.Window.partitionBy("title").orderBy("file"))
    return rows.withColumn("n", n).select("file", F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat_ws("_", "title", "n")).alias("name"))


def s15_segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page offsets at which the segments of a standard are put together."""
    rows = read(spark, sf_dir, "kb_md").select("file").distinct()
    base = F.regexp_extract("file", r"^_seg(\d+)_(.+)_p(\d+)-(\d+)_\d+\.md$", 2)
    part = [F.regexp_extract("file", r"^_seg(\d+)_(.+)_p(\d+)-(\d+)_\d+\.md$", k).cast("int") for k in (1, 3, 4)]
    rows = rows.filter(F.col("file").rlike(r"^_seg\d+_.+_p\d+-\d+_\d+\.md$")).select("file", base.alias("base"), part[0].alias("seg"), (part[2] - part[1] + 1).alias("pages"))
    before = ops.Window.partitionBy("base").orderBy("seg", "file").rowsBetween(ops.Window.unboundedPreceding, -1)
    return rows.select("file", "pages", F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("offset"))


def s20_embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause texts that are embedded: of 20 characters or more, cut at 2,000."""
    rows = read(spark, sf_dir, "read_clause_full").select("rec_id", "clause_text").distinct().filter(F.length("clause_text") >= 20)
    return rows.select("rec_id", F.md5(F.substring("clause_text", 1, 2000)).alias("fingerprint"))


def f24_base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names without segment and page marks."""
    base = F.regexp_replace(F.regexp_replace("file", r"^_seg\d+_", ""), r"_p\d+-\d+_\d+\.md$", "")
    return read(spark, sf_dir, "kb_md").select("file").distinct().select("file", base.alias("base"))


def f28_extract_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents that begin with a clause number, by the first pattern that fits; equal numbers appended."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("i", "p"))
    number = F.coalesce(*[F.nullif(F.regexp_extract("p", pattern, 1), F.lit("")) for pattern in (r"^(§\s*\d+)", r"^(第[一二三四五六七八九十百\d]+条)", r"^(\d+(?:\.\d+)*)[.、\s]", r"^([一二三四五六七八九十]+)、")])
    rows = rows.withColumn("number", number).filter("number is not null and length(p) >= 20")
    text = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), "\n"), 1, 4000)
    return rows.groupBy("doc_id", "number").agg(F.length(text).alias("chars"), F.md5(text).alias("fingerprint"))


QUERIES = {
    f.__name__: f
    for f in (
        s1_list_corpus, w1_line_offsets, w4_sections, w1_section_length, f8_front_headings, f9_toc_entries, f10_front_trim, w2_section_types, w5_clause_parents, w6_clause_lookup, j7_section_at, j8_asof_heading,
        w17_carry_forward, w18_section_depth, s12_incremental_index, s14_preferred_union, s13_renamed_files, s15_segment_offsets, s20_embedding_inputs, f24_base_names, f28_extract_clauses,
    )
}

_FILES = "files as (select file, any_value(text) as body, any_value(length(text)) as size from kb_md group by file)"
_LINES = f"""{_FILES}, split as (select file, size, string_split(body, chr(10)) as ls from files), ls as (select file, size, unnest(range(0, len(ls))) as line_no, unnest(ls) as line from split),
lines as (select *, cast(coalesce(sum(length(line) + 1) over (partition by file order by line_no rows between unbounded preceding and 1 preceding), 0) as int) as pos from ls)"""
_BARE = r"regexp_replace(h, '[ 　]', '', 'g')"
_NOISE = "|".join((*ops.NOISE, *ops.NOISE_ENGLISH))


def _front(h: str) -> str:
    bare = f"regexp_replace({h}, '[ 　]', '', 'g')"
    return rf"""(regexp_matches({h}, '……\s*\d{{1,4}}\s*$') or regexp_matches({h}, '[\s…]{{2,}}\d{{2,4}}\s*$') or regexp_matches({bare}, '{_NOISE}') and not regexp_matches({h}, '{ops.COMMENTARY}')
 or length({h}) > 60 and not regexp_matches({h}, '\d+\.\d+|[IVXLCDM\x{{2160}}-\x{{217B}}]+\s'))"""


_SECTIONS = rf"""{_LINES}, t as (select *, min(case when regexp_matches(line, '{ops.TOC_LINE}') then pos end) over (partition by file) as toc from lines),
b as (select *, coalesce(min(case when regexp_matches(line, '{ops.BODY_LINE}') and pos > coalesce(toc, -1) then pos end) over (partition by file), 0) as body from t),
m as (select *, regexp_matches(line, '{ops.HEADING}') as marked from b where pos >= body and (regexp_matches(line, '{ops.HEADING}') or regexp_matches(line, '{ops.LEAF}'))),
h as (select *, trim(case when marked then regexp_extract(line, '{ops.HEADING}', 1) else line end) as heading from m),
k as (select *, min(case when marked and regexp_matches(heading, '{ops.COMMENTARY}') then pos end) over (partition by file) as cs, min(case when marked and heading like '引用标准名录%' then pos end) over (partition by file) as rs from h where not {_front('heading')}),
secs as (select file, row_number() over (partition by file order by pos) - 1 as sid, substr(heading, 1, 120) as heading, pos, coalesce(lead(pos) over (partition by file order by pos), size) - pos as length,
 case when pos >= cs then 'commentary' when contains(heading, '附录') then 'appendix' when pos >= rs then 'reference' else 'normative' end as type, not marked as leaf from k)"""
_INDEX = "idx as (select distinct section_id, file, sid, heading, pos, type, leaf from kb_search_index)"
_CLAUSES = rf"""{_INDEX}, n as (select *, nullif(regexp_extract(heading, '^(\d+(?:\.\d+)*)\s', 1), '') as arabic, nullif(regexp_extract(heading, '^([IVXLCDM\x{{2160}}-\x{{217B}}]+)\s', 1), '') as roman, nullif(regexp_extract(heading, '^(第[一二三四五六七八九十百千\d]+条)', 1), '') as cn from idx),
c as (select *, coalesce(arabic, roman, cn) as number, last_value(coalesce(arabic, cn) ignore nulls) over (partition by file order by pos rows between unbounded preceding and 1 preceding) as prev from n where coalesce(arabic, roman, cn) is not null),
clauses as (select *, case when contains(number, '.') then regexp_replace(number, '\.\d+$', '') when regexp_matches(number, '^[IVXLCDM\x{{2160}}-\x{{217B}}]+$') then prev end as parent, trim(substr(heading, length(number) + 1)) as title from c)"""
_SEG = r"^_seg(\d+)_(.+)_p(\d+)-(\d+)_\d+\.md$"
ORACLES = {
    "s1_list_corpus": f"with {_FILES} select file, size as chars from files",
    "w1_line_offsets": f"with {_LINES} select file, count(*) as n_lines, cast(sum(pos) as bigint) as pos_sum, max(pos + length(line)) as last_end from lines group by file",
    "w4_sections": f"with {_SECTIONS} select * from secs",
    "w2_section_types": f"with {_SECTIONS} select type, leaf, count(*) as n, cast(sum(length) as bigint) as chars from secs group by type, leaf",
    "w1_section_length": f"with {_FILES}, r as (select distinct section_id, file, pos, length from kb_search_index), x as (select section_id, length, coalesce(lead(pos) over (partition by file order by pos), size) - pos as true_length from r join files using (file)) select section_id, true_length, coalesce(length <> true_length, true) as stale from x",
    "f8_front_headings": f"with {_LINES}, h as (select file, trim(regexp_extract(line, '{ops.HEADING}', 1)) as h from lines where regexp_extract(line, '{ops.HEADING}', 1) <> '') select file, count(*) as n from h where {_front('h')} group by file",
    "f9_toc_entries": rf"with {_FILES}, s as (select file, body, string_split(body, chr(10)) as ls from files) select file, length(body) < 50 or len(ls) >= 3 and len(list_filter(ls[1:5], lambda x: regexp_matches(x, '(…{{1,}}|\.{{3,}})\s*\d+\s*$'))) >= 2 as is_toc from s",
    "f10_front_trim": f"with {_FILES}, s as (select file, size, case when body like '# 1 总则' || chr(10) || '%' then 1 else instr(body, chr(10) || '# 1 总则' || chr(10)) + 1 end as fs from files) select file, case when fs > 1 and fs <= least(500, size) then size - fs + 1 else size end as kept from s",
    "w5_clause_parents": f"with {_CLAUSES} select section_id, number, parent, title from clauses",
    "w6_clause_lookup": rf"""with {_CLAUSES}, coded as (select *, regexp_replace(regexp_replace(regexp_extract(file, '_seg\d+_([A-Z]+\d*(?:_T)? \d+)', 1), '_T ', 'T'), ' ', '') as code, case type when 'commentary' then 1 when 'appendix' then 2 when 'reference' then 3 else 0 end as prio from clauses),
ranked as (select *, row_number() over (partition by code, number order by prio, file, pos) as r from coded) select code, number, section_id, type from ranked where r = 1""",
    "j7_section_at": f"with {_LINES}, {_INDEX}, spans as (select file, sid, pos as start, coalesce(lead(pos) over (partition by file order by pos), size) as stop from idx join files using (file)) select l.file, s.sid, count(*) as n_rows from lines l join spans s on l.file = s.file and l.pos >= s.start and l.pos < s.stop where l.line like '| %' group by all",
    "j8_asof_heading": "with e as (select event_id, user_id, ts from events where event_type = 'error'), s as (select user_id, ts, max(event_id) as heading_id from events where event_type = 'signup' group by all) select event_id, heading_id from e asof join s on e.user_id = s.user_id and e.ts >= s.ts",
    "w17_carry_forward": rf"with {_INDEX} select section_id, last_value(nullif(regexp_extract(heading, '^(\d+)\s', 1), '') ignore nulls) over (partition by file order by pos rows unbounded preceding) as chapter from idx",
    "w18_section_depth": f"with {_CLAUSES}, r as (select *, row_number() over (partition by file, title order by length(number), pos) as r from clauses where title <> '') select file, title, number, length(number) - length(replace(number, '.', '')) + 1 as depth from r where r = 1",
    "s12_incremental_index": "with f as (select distinct file from kb_md), i as (select distinct source_file as file from read_clause_full where source_file <> '') select file, 'add' as action from f where file not in (select file from i) union all select file, 'drop' from i where file not in (select file from f)",
    "s14_preferred_union": "with h as (select standard_code, min(title) as name from kb_md where standard_code is not null and title is not null group by 1) select standard_code, name, 'file' as origin from h union all select standard_code, standard_name, 'list' from standard_status where standard_code not in (select standard_code from h)",
    "s13_renamed_files": "with r as (select distinct file, title from kb_md where title is not null), n as (select *, row_number() over (partition by title order by file) as n from r) select file, case when n = 1 then title else title || '_' || n end as name from n",
    "s15_segment_offsets": rf"with r as (select distinct file from kb_md), p as (select file, regexp_extract(file, '{_SEG}', 2) as base, cast(regexp_extract(file, '{_SEG}', 1) as int) as seg, cast(regexp_extract(file, '{_SEG}', 4) as int) - cast(regexp_extract(file, '{_SEG}', 3) as int) + 1 as pages from r where regexp_matches(file, '{_SEG}')) select file, pages, coalesce(cast(sum(pages) over (partition by base order by seg, file rows between unbounded preceding and 1 preceding) as bigint), 0) as offset from p",
    "s20_embedding_inputs": "with r as (select distinct rec_id, clause_text from read_clause_full) select rec_id, md5(substr(clause_text, 1, 2000)) as fingerprint from r where length(clause_text) >= 20",
    "f24_base_names": r"select distinct file, regexp_replace(regexp_replace(file, '^_seg\d+_', ''), '_p\d+-\d+_\d+\.md$', '') as base from kb_md",
    "f28_extract_clauses": r"""with p as (select doc_id, unnest(range(0, len(string_split(text, chr(10) || chr(10))))) as i, unnest(string_split(text, chr(10) || chr(10))) as p from documents),
n as (select *, coalesce(nullif(regexp_extract(p, '^(§\s*\d+)', 1), ''), nullif(regexp_extract(p, '^(第[一二三四五六七八九十百\d]+条)', 1), ''), nullif(regexp_extract(p, '^(\d+(?:\.\d+)*)[.、\s]', 1), ''), nullif(regexp_extract(p, '^([一二三四五六七八九十]+)、', 1), '')) as number from p),
t as (select doc_id, number, substr(string_agg(p, chr(10) order by i, p), 1, 4000) as t from n where number is not null and length(p) >= 20 group by all) select doc_id, number, length(t) as chars, md5(t) as fingerprint from t""",
}
