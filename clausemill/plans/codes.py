"""Queries over standard codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.functions import codes
from clausemill.session import read

SPELLINGS = (
    "GB/T 50720-2011", "GB_T 50720-2011", "GB_T50720", "GBT50720", "GB／T50720", "GB/T50720", "GB 50204-2015", "GB50011", "JGJ/T 79-2012", "JGJ 79-2012", "CJJ_T 287-2018",
    "CJJ/T 287-2018", "CECS 164-2004", "DB32/T 3700-2019", "DB323700", "DB32370", "DB11/T 1234", "JC/T 547-2017", "JCT 973", "JTG/T F20-2015", "CJJ 1-2008", "TCECS 1000", "T/CECS 1000",
    "RISN-TG026-2020 建筑", "CJJ_T 287-2018 园林绿化养护标准", "_seg0_GB_T 50720-2011 建设工程施工现场消防安全技术标准(2025 年版).md", "_seg1_JGJ 79-2012 建筑地基处理技术规范_p0001-0128.md", "图集",
)


def _spellings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SPELLINGS], "raw string")


def f1_normalize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, dated and official forms of known spellings."""
    raw = F.col("raw")
    return _spellings(spark).select("raw", codes.normalize_code(raw).alias("code"), codes.normalize_code_with_year(raw).alias("dated"), codes.official_code(raw).alias("official"))


def f1_cited_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes of all citations, with the number of citations."""
    cited = read(spark, sf_dir, "plan_writer_citation_summary_sample").select("item_id", "code").distinct()
    return cited.filter("code is not null").groupBy(codes.normalize_code(F.col("code")).alias("standard_code")).agg(F.count("*").alias("n"))


def f3_official_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official forms of the display codes of the list of standards."""
    listed = read(spark, sf_dir, "standard_status")
    return listed.select("standard_code", codes.official_code(F.col("display_code")).alias("official"), codes.normalize_code_with_year(F.col("display_code")).alias("dated"))


def f4_extract_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, name and year in the file names of the corpus."""
    stem = F.regexp_replace("file", r"_\d+\.md$", "")
    files = read(spark, sf_dir, "kb_md").select("file", stem.alias("stem")).distinct()
    return files.select("file", codes.extract_standard(F.col("stem")).alias("s")).select("file", "s.standard_code", "s.official_code", "s.standard_name", "s.year")


def f5_query_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search forms of the list's codes, with the swapped national prefix."""
    listed = read(spark, sf_dir, "standard_status").select("standard_code", "official_code")
    forms = F.array_join(codes.query_forms(F.col("official_code")), "|")
    return listed.select("standard_code", forms.alias("forms"), codes.swapped_family(F.col("standard_code")).alias("swapped"))


def f29_direct_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that name a code and a clause: the code and the clause number."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "query").distinct().filter("query is not null")
    clause = F.regexp_extract("query", r"第?\s*(\d+(?:\.\d+){1,4})\s*条?", 1)
    parsed = asked.select("query_id", codes.normalize_code(codes.code_token(F.col("query"))).alias("code"), clause.alias("clause"))
    return parsed.filter("code <> '' and clause <> ''")


def f30_query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by whether they hold a code or end like a standard's name."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "query").distinct().filter("query is not null")
    has_code = F.upper("query").rlike(r"(GB|JGJ|CJJ|CECS|DB\d{2}|JC|JTG)[/_ ]?T?\s*\d{2,}")
    is_name = ~F.col("query").contains(" ") & F.col("query").rlike("(标准|规范|规程|细则|导则|指南)$")
    return asked.groupBy(has_code.alias("has_code"), is_name.alias("is_standard_name")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (f1_normalize_code, f1_cited_codes, f3_official_code, f4_extract_standard, f5_query_forms, f29_direct_query, f30_query_class)}

_FAMILIES = codes.FAMILIES


def _code_sql(source: str, column: str, keep: str) -> str:
    """DuckDB's version of the code forms: c_parts has keep, code, dated and official."""
    lead = codes.LEADING_T
    return f"""
c_text as (select {keep}, upper(replace(coalesce({column}, ''), '／', '/')) as x from {source}),
c_split as (select *, regexp_extract(x, '{lead}', 1) as lead, replace(regexp_extract(x, '^(?s:.*?)({_FAMILIES})(?s:(.*))$', 1), '_', '') as fam, regexp_extract(x, '^(?s:.*?)({_FAMILIES})(?s:(.*))$', 2) as rest,
  regexp_extract(x, '(^|[^0-9])(19[0-9]{{2}}|20[0-9]{{2}})\\b', 2) as year from c_text),
c_t as (select *, fam <> 'TCECS' and fam like '%T' as own_t, regexp_matches(rest, '^\\s*[/_-]?\\s*T\\b') as has_t from c_split),
c_number as (select *, case when lead <> '' then lead when own_t then regexp_replace(fam, 'T$', '') else fam end as prefix,
  case when lead <> '' then true else fam <> 'RISN' and (own_t or has_t) end as t,
  case when lead <> '' then regexp_extract(regexp_replace(x, '{lead}', ''), '{codes.NUMBER}', 1) when fam = 'RISN' then regexp_extract(rest, '^\\s*-?\\s*([A-Z]{{1,2}}\\d+)', 1)
    else regexp_extract(case when has_t then regexp_replace(rest, '^\\s*[/_-]?\\s*T\\b', '') else rest end, '{codes.NUMBER}', 1) end as num from c_t),
c_local as (select *, prefix like 'DB%' as local, prefix = 'DB' and regexp_matches(num, '^[0-9]{{5,}}$') as glued from c_number),
c_own as (select *, case when glued then substr(num, 1, 2) else substr(prefix, 3, 2) end as prov, case when glued then substr(num, 3) else num end as own from c_local),
c_parts as (select {keep}, case when num = '' then '' when local then 'DB' || prov || case when t or prov <> '' then 'T' else '' end || own when prefix = 'RISN' then 'RISN-' || num
    when prefix = 'TCECS' or prefix = 'CECS' and t then 'TCECS' || num else prefix || case when t then 'T' else '' end || num end as code,
  case when num = '' then '' else case when local then 'DB' || prov || case when t or prov <> '' then '/T' else '' end || ' ' || own when prefix = 'RISN' then 'RISN-' || num
    when prefix = 'TCECS' or prefix = 'CECS' and t then 'TCECS ' || num else prefix || case when t then '/T' else '' end || ' ' || num end || case when year <> '' then '-' || year else '' end end as official,
  nullif(year, '') as year from c_own),
c_forms as (select *, case when code = '' then '' else concat_ws('-', code, year) end as dated from c_parts)"""


_VALUES = ", ".join("('" + s.replace("'", "''") + "')" for s in SPELLINGS)
_TOKEN = rf"(?i)((?:{_FAMILIES})(?:\s*[/_-]?\s*T?\s*[/_-]?\s*[A-Z]?\d+(?:\.\d+)?)?)"
ORACLES = {
    "f1_normalize_code": f"with c_in as (select * from (values {_VALUES}) v(raw)), {_code_sql('c_in', 'raw', 'raw')} select raw, code, dated, official from c_forms",
    "f1_cited_codes": f"with c_in as (select distinct item_id, code as raw from plan_writer_citation_summary_sample where code is not null), {_code_sql('c_in', 'raw', 'item_id')} select code as standard_code, count(*) as n from c_forms group by 1",
    "f3_official_code": f"with {_code_sql('standard_status', 'display_code', 'standard_code')} select standard_code, official, dated from c_forms",
    "f4_extract_standard": rf"""with c_in as (select distinct file, regexp_replace(file, '_\d+\.md$', '') as stem from kb_md), c_tok as (select file, stem, regexp_extract(stem, '{_TOKEN}', 1) as token from c_in),
{_code_sql('c_tok', 'token', 'file, stem, token')},
named as (select *, trim(regexp_replace(regexp_replace(regexp_replace(substr(stem, instr(stem, token) + length(token)), '(?i)\.(json|md)$', ''), '^[_\s-]+', ''), '_p\d{{4}}-\d{{4}}$', '')) as nm from c_forms)
select file, nullif(code, '') as standard_code, case when code <> '' then official end as official_code, case when code <> '' then case when nm = '' then trim(stem) else nm end end as standard_name,
case when code <> '' then cast(nullif(regexp_extract(upper(stem), '(^|[^0-9])(19[0-9]{{2}}|20[0-9]{{2}})\b', 2), '') as int) end as year from named""",
    "f5_query_forms": f"""with {_code_sql('standard_status', 'official_code', 'standard_code')}
select standard_code, case when code = '' then '' when regexp_replace(code, '^([A-Z]+)([0-9])', '\\1 \\2') = code then code else code || '|' || regexp_replace(code, '^([A-Z]+)([0-9])', '\\1 \\2') end as forms,
case when regexp_matches(standard_code, '^GBT[0-9]') then regexp_replace(standard_code, '^GBT', 'GB') when regexp_matches(standard_code, '^GB[0-9]') then regexp_replace(standard_code, '^GB', 'GBT') end as swapped from c_forms""",
    "f29_direct_query": rf"""with c_in as (select distinct query_id, query, regexp_extract(query, '{_TOKEN}', 1) as token, regexp_extract(query, '第?\s*(\d+(?:\.\d+){{1,4}})\s*条?', 1) as clause from golden_queries where query is not null),
{_code_sql('c_in', 'token', 'query_id, clause')} select query_id, code, clause from c_forms where code <> '' and clause <> ''""",
    "f30_query_class": r"""with asked as (select distinct query_id, query from golden_queries where query is not null)
select regexp_matches(upper(query), '(GB|JGJ|CJJ|CECS|DB\d{2}|JC|JTG)[/_ ]?T?\s*\d{2,}') as has_code, not contains(query, ' ') and regexp_matches(query, '(标准|规范|规程|细则|导则|指南)$') as is_standard_name, count(*) as n from asked group by 1, 2""",
}
