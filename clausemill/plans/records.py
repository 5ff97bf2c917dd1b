"""Records read, named, dated and reconciled: layout files, status pages, imports, places, targets, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.functions.codes import code_token, normalize_code, swapped_family
from clausemill.operators import lexical, sections, texts as ops
from clausemill.plans import search as search_plans
from clausemill.plans.lexical import golden_questions
from clausemill.session import read, read_wide
from clausemill.sources import files

CITIES = (("南京", "江苏"), ("苏州", "江苏"), ("杭州", "浙江"), ("广州", "广东"), ("成都", "四川"))
PLACES = ("项目地点：江苏省南京市鼓楼区", "工程位于杭州市西湖区。", "会议地点：三号会议室，其余略", "本工程地处苏州与南京之间", "没有地点")
DATES = ("5月27日-31日浇筑", "计划6月28日开工，7月3日完工", "2月28日至2月30日", "没有日期", "12月30日～31日")
TARGETS = (("1", 3), ("2", 1), ("3", 2))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout file of each corpus file: its headings as blocks, ten a page, every seventh a page header."""
    index = read(spark, sf_dir, "kb_search_index").select("file", "sid", "heading").distinct().filter("heading is not null")
    kind = F.when(F.col("sid") % 7 == 6, "header").otherwise("text")
    block = F.struct("sid", F.struct(kind.alias("type"), F.col("heading").alias("text"), F.floor(F.col("sid") / 10).cast("int").alias("page_idx")).alias("block"))
    per_file = index.groupBy(F.col("file").alias("name")).agg(F.array_sort(F.collect_set(F.struct("sid", "heading", block.alias("b")))).alias("all"))
    return per_file.select("name", F.to_json(F.transform("all", lambda x: x["b"]["block"])).alias("content"))


def s4_layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts of layout files, by page."""
    text = files.full_text(files.layout_blocks(_layout(spark, sf_dir), "name", "content"), "name")
    return text.select("name", F.length("text").alias("chars"), F.md5("text").alias("fingerprint"))


def s5_running_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks of running text, by file."""
    return files.running_text(files.layout_blocks(_layout(spark, sf_dir), "name", "content")).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def s10_status_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of status pages, a page a standard, by the names beside them."""
    cell = lambda name, value: F.concat(F.lit(f"<tr><th>{name}</th><td> <b>"), F.coalesce(value, F.lit("")), F.lit("</b></td></tr>"))
    rows = read(spark, sf_dir, "standard_status").select("standard_code", F.concat(F.lit("<table>"), cell("标准号", F.col("official_code")), cell("标准名称", F.col("standard_name")), cell("标准状态", F.col("status")), F.lit("</table>")).alias("html"))
    fields = F.map_from_entries(F.transform(files.status_cells(F.col("html")), lambda r: F.struct(r[0].alias("k"), r[1].alias("v"))))
    got = rows.select("standard_code", fields.alias("f"))
    named = lambda key, alias: F.nullif(F.try_element_at("f", F.lit(key)), F.lit("")).alias(alias)
    return got.select("standard_code", named("标准号", "official"), named("标准名称", "name"), named("标准状态", "state"))


def s13_incremental_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for files that aren't imported yet; a name taken by an imported file or another new one gets a number."""
    held = read(spark, sf_dir, "kb_md").filter("title is not null").groupBy("file").agg(F.min("title").alias("title"))
    manifest = read(spark, sf_dir, "read_clause_full").filter("source_file <> ''").select(F.col("source_file").alias("file")).distinct()
    new = held.join(manifest, "file", "left_anti")
    taken = held.join(manifest, "file", "left_semi").groupBy("title").agg(F.count("*").alias("taken"))
    n = F.row_number().over(Window.partitionBy("title").orderBy("file")) + F.coalesce("taken", F.lit(0))
    rows = new.join(taken, "title", "left").withColumn("n", n)
    return rows.select("file", F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat_ws("_", "title", "n")).alias("name"))


def filter7_similar_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that golden queries expect: held as they are, in the other family, inside or around a held one, or not."""
    wanted = read(spark, sf_dir, "golden_queries").select(F.regexp_extract("expected_standard_code", r"^([A-Z]+\d+T?\d*)$", 1).alias("code")).distinct().filter("length(code) >= 4")
    held = read(spark, sf_dir, "standard_status").select(F.col("standard_code").alias("held"))
    inside = lexical.contained(wanted, "code", held, "held").select("code").distinct().withColumn("around", F.lit(True))
    pieces = held.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("held")), lambda a: F.transform(F.sequence(F.lit(1), F.length("held") - a + 1), lambda n: F.substr("held", a, n))))).alias("code")).distinct().withColumn("within", F.lit(True))
    exact = held.select(F.col("held").alias("code")).withColumn("exact", F.lit(True))
    other = held.select(swapped_family(F.col("held")).alias("code")).filter("code is not null").withColumn("other", F.lit(True)).distinct()
    rows = wanted.join(exact, "code", "left").join(other, "code", "left").join(inside, "code", "left").join(pieces, "code", "left")
    return rows.select("code", F.when(F.col("exact"), "held").when(F.col("other"), "other family").when(F.col("around") | F.col("within"), "similar").otherwise("missing").alias("state"))


def f33_project_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that documents and a few fixed texts give, with province and city."""
    cities = spark.createDataFrame(CITIES, "city string, province string")
    fixed = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(PLACES)], "doc_id bigint, text string")
    return ops.places(fixed.unionByName(read_wide(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", cities)


def f34_shifted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few fixed texts with their dates a week later."""
    return spark.createDataFrame([(t,) for t in DATES], "raw string").select("raw", ops.shifted(F.col("raw"), 7).alias("moved"))


def w18_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of every section: by the dots of its number, or one below the last numbered one."""
    rows = read(spark, sf_dir, "kb_search_index").select("section_id", "file", "heading", "pos").distinct().filter("heading is not null")
    number = F.nullif(F.regexp_extract("heading", r"^(\d+(?:\.\d+)*)\s", 1), F.lit(""))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    own = Window.partitionBy("file").orderBy("pos", "section_id").rowsBetween(Window.unboundedPreceding, 0)  # a file's sections
    rows = rows.withColumn("own", dots).withColumn("last", F.last("own", ignorenulls=True).over(own))
    return rows.select("section_id", F.coalesce("own", F.col("last") + 1, F.lit(1)).alias("depth"))


def x31_chapter_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of documents with too few or enough lines for their target."""
    at = sections.lines(read_wide(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    own = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # a document's lines
    heading = F.when(F.length("line") < 60, F.nullif(F.regexp_extract("line", r"^#?\s*([1-9])[\s.]", 1), F.lit("")))
    counts = at.withColumn("chapter", F.coalesce(F.last(heading, ignorenulls=True).over(own), F.lit("1"))).filter("line <> ''").groupBy("doc_id", "chapter").agg(F.count("*").alias("n"))
    targets = spark.createDataFrame(TARGETS, "chapter string, target int")
    every = counts.select("doc_id").distinct().crossJoin(F.broadcast(targets))
    return every.join(counts, ["doc_id", "chapter"], "left").select("doc_id", "chapter", "target", F.coalesce("n", F.lit(0)).alias("actual"), (F.coalesce("n", F.lit(0)) >= F.col("target")).alias("passed"))


def x32_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the citations' view of a standard changes in the list: states always, names only where missing and Chinese."""
    seen = read(spark, sf_dir, "plan_writer_citation_summary_sample").filter("official_code <> ''").groupBy(F.col("official_code").alias("official")).agg(F.max("version_status").alias("status"), F.max("standard_name").alias("name"))
    listed = read(spark, sf_dir, "standard_status").select("standard_code", F.col("official_code").alias("official"), F.col("status").alias("old_status"), F.col("standard_name").alias("old_name"))
    both = listed.join(seen, "official")
    changes = F.array_compact(F.array(
        F.when(F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.col("old_status")), F.struct(F.lit("status").alias("field"), F.col("old_status").alias("old"), F.col("status").alias("new"))),
        F.when((F.coalesce("old_name", F.lit("")) == "") & F.col("name").rlike("[一-鿿]"), F.struct(F.lit("standard_name").alias("field"), F.col("old_name").alias("old"), F.col("name").alias("new"))),
    ))
    return both.select("standard_code", F.inline(changes))


def x3_referenced_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to golden queries, those of standards that refer to the code asked for gaining besides their authority."""
    asked = golden_questions(spark, sf_dir)
    codes = asked.select("qid", normalize_code(code_token(F.col("text"))).alias("asked_code"))
    found = search_plans.routed(spark, sf_dir, asked).join(codes, "qid")
    out = search_plans.ops.authority_boost(found, search_plans._references(spark, sf_dir), "asked_code")
    return out.select("qid", "file", "refs", "referenced", F.round("score", 3).alias("score"))


def k3_layered_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to golden queries in layers: state first, then how much of the question the file's name covers, then score."""
    asked = golden_questions(spark, sf_dir)
    found = search_plans.ops.version_penalty(search_plans.routed(spark, sf_dir, asked), read(spark, sf_dir, "standard_status")).drop("position")
    units = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{2,}|[一-鿿]{2,})"), F.lit(1))), 1, 12)
    units = F.transform(units, lambda u: F.struct(u.alias("unit"), F.when(F.length(u) >= 4, 2).otherwise(1).alias("weight")))
    share = F.round(search_plans.ops.coverage(units, F.lower("file")), 4)
    rows = found.join(asked, "qid").withColumn("sim", F.when(share >= 0.45, share))
    return search_plans.ops.layered(rows).select("qid", "file", "position", "penalised", "sim")


QUERIES = {
    f.__name__: f
    for f in (s4_layout_files, s5_running_files, s10_status_fields, s13_incremental_names, filter7_similar_codes, f33_project_places, f34_shifted_texts, w18_tree_depth, x31_chapter_targets, x32_reconciled, x3_referenced_golden, k3_layered_golden)
}

_BLOCKS = "ix as (select distinct file as name, sid, heading from kb_search_index where heading is not null)"
_CITY = ", ".join(f"('{a}', '{b}')" for a, b in CITIES)
_PLACE = ", ".join(f"({-1 - k}, '{t}')" for k, t in enumerate(PLACES))
_MOVED = ", ".join(f"('{a}', '{b}')" for a, b in zip(DATES, ("6月3日-6月7日浇筑", "计划7月5日开工，7月10日完工", "3月7日至2月30日", "没有日期", "1月6日～1月7日")))
_TARGET = ", ".join(f"('{a}', {b})" for a, b in TARGETS)
_UNITS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]{2,}|[一-鿿]{2,}'), lambda x, i: list_position(regexp_extract_all(lower(text), '[a-z0-9]{2,}|[一-鿿]{2,}'), x) = i)[1:12]"
_WEIGHT = "lambda x: case when length(x) >= 4 then 2 else 1 end"
ORACLES = {
    "k3_layered_golden": f"""with {search_plans._GOLDEN_D1}, s as (select rt.*, coalesce(t.status, 'unknown') as status from (select *, {search_plans._CODE} as code from rt) rt left join standard_status t on t.standard_code = code), p as (select *, status in ('superseded', 'abolished') as penalised, score * case status when 'superseded' then 0.65 when 'abolished' then 0.4 else 1 end as s2 from s),
h as (select *, round(score, 6) as s3 from (select qid, file, score, penalised, row_number() over (partition by qid order by penalised, round(s2, 6) desc, file) as r, s2 from p) u where r <= 100), u as (select h.*, {_UNITS} as ds from h join qs using (qid)),
c as (select *, round(case when len(ds) = 0 then 1.0 else coalesce(list_sum(list_transform(list_filter(ds, lambda x: contains(lower(file), x)), {_WEIGHT})), 0) / list_sum(list_transform(ds, {_WEIGHT})) end, 4) as share from u), k as (select *, case when share >= 0.45 then share end as sim from c)
select qid, file, row_number() over (partition by qid order by penalised, sim is null, sim desc, round(s2, 6) desc, file) as position, penalised, sim from k""",
    "s4_layout_files": f"with {_BLOCKS}, t as (select name, string_agg(trim(heading), chr(10) order by sid // 10, sid, heading) filter (trim(heading) <> '') as text from ix group by name) select name, length(coalesce(text, '')) as chars, md5(coalesce(text, '')) as fingerprint from t",
    "s5_running_files": f"with {_BLOCKS} select name, count(*) as n, cast(sum(length(heading)) as bigint) as chars from ix where sid % 7 <> 6 and length(trim(heading)) >= 3 group by name",
    "s10_status_fields": "select standard_code, nullif(trim(official_code), '') as official, nullif(trim(standard_name), '') as name, nullif(trim(status), '') as state from standard_status",
    "s13_incremental_names": "with h as (select file, min(title) as title from kb_md where title is not null group by file), m as (select distinct source_file as file from read_clause_full where source_file <> ''), t as (select title, count(*) as taken from h where file in (select file from m) group by 1), n as (select file, h.title, row_number() over (partition by h.title order by file) + coalesce(taken, 0) as n from h left join t on t.title = h.title where file not in (select file from m)) select file, case when n = 1 then title else title || '_' || n end as name from n",
    "filter7_similar_codes": r"with w as (select distinct regexp_extract(expected_standard_code, '^([A-Z]+\d+T?\d*)$', 1) as code from golden_queries), s as (select standard_code as held, case when regexp_matches(standard_code, '^GBT\d') then regexp_replace(standard_code, '^GBT', 'GB') when regexp_matches(standard_code, '^GB\d') then regexp_replace(standard_code, '^GB', 'GBT') end as other from standard_status) select code, case when code in (select held from s) then 'held' when code in (select other from s where other is not null) then 'other family' when exists (select 1 from s where contains(code, held) or contains(held, code)) then 'similar' else 'missing' end as state from w where length(code) >= 4",
    "f33_project_places": f"with d as (select * from (values {_PLACE}) v(doc_id, text) union all select doc_id, text from documents), p as (select doc_id, trim(coalesce(nullif(regexp_extract(text, '{ops.PLACE_LABEL}', 1), ''), nullif(regexp_extract(text, '{ops.PLACE_PHRASE}', 1), ''))) as place from d), c as (select p.*, city, province, row_number() over (partition by doc_id, place order by strpos(place, city), city) as r from p join (values {_CITY}) c(city, province) on contains(place, city)) select distinct p.doc_id, p.place, coalesce(nullif(regexp_extract(p.place, '({ops.PROVINCES})', 1), ''), c.province) as province, c.city from p left join (select * from c where r = 1) c on c.doc_id = p.doc_id and c.place = p.place where p.place is not null",
    "f34_shifted_texts": f"select * from (values {_MOVED}) v(raw, moved)",
    "w18_tree_depth": r"with i as (select distinct section_id, file, heading, pos from kb_search_index where heading is not null), n as (select *, length(k) - length(replace(k, '.', '')) + 1 as own from (select *, nullif(regexp_extract(heading, '^(\d+(?:\.\d+)*)\s', 1), '') as k from i) u) select section_id, coalesce(own, last_value(own ignore nulls) over (partition by file order by pos, section_id rows between unbounded preceding and current row) + 1, 1) as depth from n",
    "x31_chapter_targets": rf"with s as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), l as (select doc_id, unnest(range(0, len(ls))) as k, unnest(ls) as line from s), h as (select *, coalesce(last_value(case when length(line) < 60 then nullif(regexp_extract(line, '^#?\s*([1-9])[\s.]', 1), '') end ignore nulls) over (partition by doc_id order by k rows between unbounded preceding and current row), '1') as chapter from l), c as (select doc_id, chapter, count(*) as n from h where line <> '' group by all), t as (select * from (select distinct doc_id from c) d, (values {_TARGET}) v(chapter, target)) select t.doc_id, t.chapter, target, coalesce(n, 0) as actual, coalesce(n, 0) >= target as passed from t left join c on c.doc_id = t.doc_id and c.chapter = t.chapter",
    "x32_reconciled": "with s as (select official_code as official, max(version_status) as st, max(standard_name) as nm from plan_writer_citation_summary_sample where official_code <> '' group by 1), b as (select * from standard_status join s on official_code = official) select standard_code, 'status' as field, status as old, st as new from b where st is not null and st is distinct from status union all select standard_code, 'standard_name', standard_name, nm from b where coalesce(standard_name, '') = '' and regexp_matches(nm, '[一-鿿]')",
    "x3_referenced_golden": f"with {search_plans._GOLDEN_D1}, {search_plans._REFS}, c as (select target_code, count(distinct source_code) as refs from xr group by 1), g as (select r.qid, file, r.score, r.code, p.code as asked from (select *, {search_plans._CODE} as code from rt) r join (select distinct qid, code from c_parts) p on p.qid = r.qid) select qid, file, coalesce(refs, 0) as refs, coalesce(asked <> '' and exists (select 1 from rf where source_code = g.code and rf.target_code = asked), false) as referenced, round(score * (1 + least(0.2, coalesce(refs, 0) * 0.01)) * case when coalesce(asked <> '' and exists (select 1 from rf where source_code = g.code and rf.target_code = asked), false) then 1.15 else 1 end, 3) as score from g left join c on g.code = target_code",
}
