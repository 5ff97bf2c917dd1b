"""Checks over documents, citations and files, and the report that unites them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.operators import audit, checks as ops, lexical, sections
from clausemill.plans.audit import ORACLES as AUDIT_SQL, a26_document_conflicts
from clausemill.session import materialise, read, read_wide

#: The chapter that standards of a topic belong to.
TOPICS = (("安全", "3"), ("质量", "4"), ("试验", "5"), ("监测", "6"), ("抢险", "7"))
HOME = "DB91"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wide(spark, sf_dir, "documents").select("doc_id", "text", "standard_code")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "standard_status").select("standard_code", "standard_name", "official_code", "display_code", "status")


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_wide(spark, sf_dir, "read_clause_full").select("rec_id", F.col("standard_code").alias("code"), "clause_no", F.col("clause_text").alias("text")).dropDuplicates(["rec_id"])
    return rows.filter("text is not null and text <> ''")


def _home(standard_code: str) -> Column:
    """A document's region: that of its own local standard, else the project's."""
    own = F.regexp_extract(F.coalesce(standard_code, F.lit("")), r"^(DB\d{2})", 1)
    return F.when(own != "", own).otherwise(HOME)


def x28_unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes cited in documents that the list doesn't have."""
    return ops.unknown_codes(ops.cited_codes(_documents(spark, sf_dir), "doc_id", "text"), "doc_id", _listed(spark, sf_dir))


def filter9_local_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local standards of another region that documents cite as their own."""
    documents = _documents(spark, sf_dir)
    homes = documents.select("doc_id", _home("standard_code").alias("home"))
    return ops.foreign_regions(ops.cited_codes(documents, "doc_id", "text").join(homes, "doc_id"), "doc_id", F.col("home"))


def x28_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause records that cite a code with a name other than the list's."""
    return ops.wrong_names(_clauses(spark, sf_dir), "rec_id", "text", _listed(spark, sf_dir))


def x28_dead_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that documents cite and no record has."""
    held = read(spark, sf_dir, "read_clause_full").select(F.col("standard_code").alias("code"), "clause_no")
    return ops.dead_references(_documents(spark, sf_dir), "doc_id", "text", held)


def x28_missing_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that a document has to speak of and doesn't: safety, quality."""
    rows = _documents(spark, sf_dir).filter("text is not null")
    missing = F.array_compact(F.array(*[F.when(~F.col("text").rlike(words), name) for name, words in (("safety", "安全|防护|警戒"), ("quality", "验收|检查|检验|复验"))]))
    return rows.select("doc_id", F.explode(missing).alias("subject"))


def x28_verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's issues by check, read from its text."""
    parts = {
        "value_conflict": a26_document_conflicts(spark, sf_dir), "broken_ref": x28_dead_references(spark, sf_dir), "unknown_code": x28_unknown_codes(spark, sf_dir), "missing_subject": x28_missing_subjects(spark, sf_dir),
        "code_name": ops.wrong_names(_documents(spark, sf_dir), "doc_id", "text", _listed(spark, sf_dir)), "foreign_region": filter9_local_region(spark, sf_dir),
    }
    out = None
    for issue, frame in parts.items():
        part = frame.select("doc_id", F.lit(issue).alias("issue"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "issue").agg(F.count("*").alias("n"))


def x23_claim_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of citations by how far they hold."""
    cited = read(spark, sf_dir, "plan_writer_citation_summary_sample").select("item_id", ops.plain_code(F.col("official_code")).alias("code"), "clause_ref", "claimed").dropDuplicates(["item_id"]).filter("claimed is not null and claimed <> ''")
    return ops.resolved_claims(cited, materialise(_clauses(spark, sf_dir).select("code", "clause_no", "text")))


def x25_chapter_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes cited in documents held against the chapter they stand in."""
    topics = spark.createDataFrame(TOPICS, "topic string, expected string")
    at = sections.lines(_documents(spark, sf_dir), "doc_id", "text").select("doc_id", "line_no", "line")
    return ops.chapter_fit(at, "doc_id", _listed(spark, sf_dir), topics)


def x17_file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other standards that files refer to, each once a file."""
    files = read_wide(spark, sf_dir, "kb_md").select("file", "standard_code", "text").dropDuplicates(["file"])
    found = ops.cited_codes(files, "file", "text").join(files.select("file", F.coalesce("standard_code", F.lit("")).alias("source_code")), "file")
    return found.filter("code <> source_code").select("file", "source_code", F.col("code").alias("target_code")).distinct()


def j2_status_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the state of the standard that their code, in any of its written forms, stands for."""
    listed = _listed(spark, sf_dir)
    forms = F.array_distinct(F.array(F.upper("standard_code"), F.upper(F.regexp_replace("official_code", r"[/_ ]|-\d{4}$", "")), F.upper(F.regexp_replace("display_code", r"[/_ ]|-\d{4}$", ""))))
    aliases = listed.select(F.explode(forms).alias("alias"), "standard_code", "status").filter("alias is not null").groupBy("alias").agg(F.min(F.struct("standard_code", "status")).alias("s"))
    rows = _documents(spark, sf_dir).select(F.upper(F.regexp_replace(F.coalesce("standard_code", F.lit("")), r"[/_ ]|-\d{4}$", "")).alias("alias"))
    return rows.join(aliases, "alias", "left").groupBy(F.coalesce("s.status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def j11_file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of clause records with the corpus file they are: of the same name, else the first of the same code."""
    own = read(spark, sf_dir, "read_clause_full").filter("source_file <> ''").groupBy(F.col("source_file").alias("named")).agg(F.min("standard_code").alias("code"))
    held = read(spark, sf_dir, "kb_md").select("file", "standard_code").distinct()
    by_code = held.filter("standard_code is not null").groupBy(F.col("standard_code").alias("code")).agg(F.min("file").alias("by_code"))
    rows = own.join(held.select(F.col("file").alias("named"), F.col("file").alias("exact")).distinct(), "named", "left").join(by_code, "code", "left")
    return rows.select("named", F.coalesce("exact", "by_code").alias("file"), F.when(F.col("exact").isNotNull(), "name").when(F.col("by_code").isNotNull(), "code").otherwise("none").alias("way"))


def f7_clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of clause texts with tags and formulas out of the way."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", " "), r"\$[^$]*\$", " "), r"\s+", " "))
    return _clauses(spark, sf_dir).select("rec_id", F.md5(clean).alias("fingerprint"), F.length(clean).alias("chars"))


def f25_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name of each file's standard: its title, else its file name's, else the commonest of the clause records read from it."""
    files = read(spark, sf_dir, "kb_md").groupBy("file").agg(F.max("title").alias("title"))
    own = F.nullif(F.regexp_extract("file", r"^_seg\d+_\S+ \S+ (.+)_p\d+-\d+_\d+\.md$", 1), F.lit(""))
    names = read(spark, sf_dir, "read_clause_full").filter("source_file <> '' and standard_name is not null").groupBy(F.col("source_file").alias("file"), "standard_name").agg(F.countDistinct("rec_id").alias("n"))
    common = names.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("n"), "standard_name")).alias("c"))
    rows = files.join(common, "file", "left").withColumn("own", own)
    level = F.when(F.col("title").isNotNull(), 1).when(F.col("own").isNotNull(), 2).when(F.col("c").isNotNull(), 3)
    return rows.select("file", F.coalesce("title", "own", "c.standard_name").alias("name"), level.alias("level"))


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files as people write them, several of every standard, beside those of the corpus."""
    listed = _listed(spark, sf_dir).filter("standard_name is not null")
    glued, name = F.regexp_replace("official_code", "[/ ]", ""), F.col("standard_name")
    forms = F.array(
        F.concat(glued, name, F.lit(".PDF")), F.concat(F.replace("official_code", F.lit("/"), F.lit("∕")), F.lit("  "), name, F.lit(" .pdf")), F.concat(F.replace("official_code", F.lit("-"), F.lit("—")), F.lit(" （"), name, F.lit(").pdf")),
        F.concat(F.lit("2024-01-02 "), name, F.lit("副本.pdf")), F.concat(F.lit("14S501-1_"), name), F.concat(F.lit("JGJ-59-2011 "), name, F.lit("～(.pdf")), F.concat_ws(" ", "official_code", name),
    )
    return listed.select(F.explode(forms).alias("file")).unionByName(read(spark, sf_dir, "kb_md").select("file")).distinct()


def f26_name_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of file names and what may be one."""
    return _typed_names(spark, sf_dir).select("file", F.array_join(ops.name_problems(F.col("file")), "|").alias("problems"), F.array_join(ops.name_warnings(F.col("file")), "|").alias("warnings"))


def f27_name_fixer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names put right."""
    return _typed_names(spark, sf_dir).select("file", ops.repaired_name(F.col("file")).alias("fixed"))


def w16_glossary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of files' glossaries, which are no clauses."""
    rows = read(spark, sf_dir, "kb_search_index").select("section_id", "file", "heading", "pos").distinct().filter("heading is not null")
    return ops.glossary_sections(rows, "file").select("section_id", "file", "pos")


def s17_import_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to import, new by name and code and of text quality; those over 8 KiB in parts of 1,000 characters here."""
    files = read_wide(spark, sf_dir, "kb_md").select("file", F.coalesce("standard_code", F.lit("")).alias("code"), "text").dropDuplicates(["file"])
    entropy = lexical.char_entropy(files, "file", "text")
    manifest = read(spark, sf_dir, "read_clause_full").select(F.coalesce("source_file", F.lit("")).alias("file"), F.lit("").alias("code")).distinct()
    return ops.import_parts(files.join(entropy, "file"), manifest, 8 * 1024, 1000, 4.5)


def k4_suggestions_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings suggested for golden queries as they are typed: beginning with all of it, else holding all its words; eight at most."""
    from clausemill.operators.answers import words_of
    from clausemill.plans.lexical import golden_questions

    asked = golden_questions(spark, sf_dir).select("qid", F.lower(F.trim("text")).alias("typed"), words_of(F.col("text")).alias("words"))
    texts = read_wide(spark, sf_dir, "kb_search_index").select(F.regexp_replace("heading", r"^[\d.]+\s+", "").alias("text")).distinct().filter("text is not null").withColumn("low", F.lower("text"))
    words = asked.select("qid", F.size("words").alias("n"), F.explode("words").alias("word"))
    hits = lexical.contained(texts, "low", words, "word", "qid", "n").groupBy("qid", "n", "text", "low").agg(F.countDistinct("word").alias("held")).filter("held = n")
    ranked = hits.join(asked.select("qid", "typed"), "qid").withColumn("tier", F.when(F.col("low").startswith(F.col("typed")), 0).otherwise(1))
    order = audit.Window.partitionBy("qid").orderBy("tier", F.length("text"), "text")
    return ranked.withColumn("r", F.row_number().over(order)).filter("r <= 8").select("qid", "r", "text", "tier")


def a13_hot_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty clauses cited most."""
    rows = read(spark, sf_dir, "plan_writer_citation_summary_sample").dropDuplicates(["item_id"]).filter("official_code <> '' and clause_ref <> ''")
    return rows.groupBy("official_code", "clause_ref").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "official_code", "clause_ref").limit(20)


def a13_rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which rank searches found the codes that the golden queries expect."""
    logs = read(spark, sf_dir, "search_log").dropDuplicates(["log_id"]).select("log_id", F.posexplode("c").alias("i", "code"))
    wanted = read(spark, sf_dir, "golden_queries").select(F.col("expected_standard_code").alias("code")).filter("code <> ''").distinct()
    return logs.join(wanted, "code", "left_semi").groupBy((F.col("i") + 1).alias("rank")).agg(F.count("*").alias("n"))


def a16_search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches without results, with stale standards, and their mean duration, over all and by mode."""
    logs = read(spark, sf_dir, "search_log").dropDuplicates(["log_id"]).select("log_id", F.coalesce("mode", F.lit("unknown")).alias("mode"), "results", "duration_ms", "c")
    stale = _listed(spark, sf_dir).filter("status in ('superseded', 'abolished')").select(F.col("standard_code").alias("code"))
    hit = logs.select("log_id", F.explode("c").alias("code")).join(stale, "code", "left_semi").select("log_id", F.lit(1.0).alias("stale")).distinct()
    out = logs.join(hit, "log_id", "left").rollup("mode").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.coalesce("results", F.lit(0)) == 0, 1.0).otherwise(0.0)), 4).alias("no_result_rate"), F.round(F.avg(F.coalesce("stale", F.lit(0.0))), 4).alias("stale_rate"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"),
    )
    return out.withColumn("mode", F.coalesce("mode", F.lit("all")))


def a22_query_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the last 500 logged queries, three each."""
    logs = read(spark, sf_dir, "search_log").dropDuplicates(["log_id"]).filter("q is not null and trim(q) <> ''").orderBy(F.desc("log_id")).limit(500).select("log_id", F.lower("q").alias("q"))
    hits = lexical.contained(logs, "q", read(spark, sf_dir, "term_map"), "term", "term_group").select("log_id", F.col("term_group").alias("tag")).distinct()
    order = audit.Window.partitionBy("log_id").orderBy("tag")
    return hits.withColumn("r", F.row_number().over(order)).filter("r <= 3").select("log_id", "tag")


def x34_term_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to become terms: mined from the log, and synonyms that are no terms yet."""
    from clausemill.plans.audit import x34_term_candidates

    terms = read(spark, sf_dir, "term_map")
    synonyms = terms.select(F.explode("syn").alias("word")).filter("word <> ''").distinct().join(terms.select(F.col("term").alias("word")), "word", "left_anti")
    return x34_term_candidates(spark, sf_dir).select("word", F.lit("log").alias("origin")).unionByName(synonyms.withColumn("origin", F.lit("synonym")))


def x36_integrity_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against their first import, by layer: naming, size within a hundredth, digest, lines within a twentieth, index."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = read(spark, sf_dir, "kb_md").select("file", "imported_at", F.struct(F.length("text").alias("size"), F.sha2("text", 256).alias("digest"), lines.alias("lines")).alias("s"))
    both = rows.groupBy("file").agg(F.min_by("s", F.struct("imported_at", "s.digest")).alias("a"), F.max_by("s", F.struct("imported_at", "s.digest")).alias("b"))
    indexed = read(spark, sf_dir, "kb_search_index").select("file").distinct().withColumn("indexed", F.lit(True))
    both = both.join(indexed, "file", "left")
    off = lambda f, share: F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) > share * F.col(f"a.{f}")
    layers = F.array_compact(F.array(F.when(~F.col("file").rlike(r"^_seg\d+_.+_p\d+-\d+_\d+\.md$"), "naming"), F.when(off("size", 0.01), "size"), F.when(F.col("a.digest") != F.col("b.digest"), "digest"), F.when(off("lines", 0.05), "lines"), F.when(F.col("indexed").isNull(), "index")))
    return both.select("file", F.array_join(layers, "|").alias("failed"))


QUERIES = {
    f.__name__: f
    for f in (
        x28_unknown_codes, filter9_local_region, x28_code_names, x28_dead_references, x28_missing_subjects, x28_verify_report, x23_claim_resolution, x25_chapter_fit, x17_file_references, j2_status_alias, j11_file_dedup, f7_clean_texts, f25_file_names, f26_name_lint,
        f27_name_fixer, w16_glossary_sections, s17_import_parts, k4_suggestions_golden, a13_hot_clauses, a13_rank_distribution, a16_search_metrics, a22_query_tags, x34_term_promotion, x36_integrity_layers,
    )
}

_P = lambda x: rf"replace(replace(regexp_replace({x}, '-\d{{4}}$', ''), '/', ''), ' ', '')"

_PATTERN = r"(?:GB|JGJ|CJJ|TCECS|CECS|DB\d{2})(?:/T)? \d{4,5}-\d{4}"
_CC = f"cc as (select distinct doc_id, standard_code, text, unnest(regexp_extract_all(text, '{_PATTERN}')) as official from documents where text is not null), ck as (select doc_id, standard_code, official, {_P('official')} as code, substr(text, greatest(strpos(text, official) - 60, 1), least(strpos(text, official) - 1, 60) + length(official) + 40) as context from cc)"
_RC = "rc as (select distinct on (rec_id) rec_id, standard_code as code, clause_no, clause_text as text from read_clause_full), rt as (select * from rc where text is not null and text <> '')"
_UNKNOWN = "uk as (select distinct doc_id, code from ck where code not in (select standard_code from standard_status))"
_REGION = f"fr as (select doc_id, code from ck where regexp_extract(official, '^(DB\\d{{2}})', 1) not in ('', case when regexp_extract(coalesce(standard_code, ''), '^(DB\\d{{2}})', 1) <> '' then regexp_extract(standard_code, '^(DB\\d{{2}})', 1) else '{HOME}' end) and not regexp_matches(context, '{ops.REFERENCE_WORDS}'))"
_DEAD = rf"dc as (select distinct doc_id, unnest(regexp_extract_all(text, '{_PATTERN}第\d+(?:\.\d+)+条')) as cite from documents where text is not null), dd as (select distinct doc_id, {_P(f'regexp_extract(cite, {chr(39)}{_PATTERN}{chr(39)})')} as code, regexp_extract(cite, '第(\d+(?:\.\d+)+)条', 1) as clause_no from dc), dr as (select * from dd where not exists (select 1 from read_clause_full r where r.standard_code = dd.code and r.clause_no = dd.clause_no))"
_MISSING = "ms as (select doc_id, 'safety' as subject from documents where text is not null and not regexp_matches(text, '安全|防护|警戒') union all select doc_id, 'quality' from documents where text is not null and not regexp_matches(text, '验收|检查|检验|复验'))"


def _names(source: str, key: str, name: str) -> str:
    same = lambda x: rf"regexp_replace({x}, '[\s·—–-]', '', 'g')"
    return rf"{name}c as (select distinct {key}, unnest(regexp_extract_all(text, '《[^《》\n]{{3,60}}》{_PATTERN}')) as cite from {source} where text is not null), {name} as (select distinct {key}, {_P(f'regexp_extract(cite, {chr(39)}{_PATTERN}{chr(39)})')} as code from {name}c join standard_status on standard_code = {_P(f'regexp_extract(cite, {chr(39)}{_PATTERN}{chr(39)})')} where standard_name is not null and {same('standard_name')} <> {same(f'regexp_extract(cite, {chr(39)}《([^《》]+)》{chr(39)}, 1)')})"


_COUNT = lambda s: f"length(s) - length(replace(s, '{s}', ''))"
_TYPED = r"""l as (select *, regexp_replace(official_code, '[/ ]', '', 'g') as glued from standard_status where standard_name is not null), tn as (select glued || standard_name || '.PDF' as file from l union select replace(official_code, '/', '∕') || '  ' || standard_name || ' .pdf' from l
union select replace(official_code, '-', '—') || ' （' || standard_name || ').pdf' from l union select '2024-01-02 ' || standard_name || '副本.pdf' from l union select '14S501-1_' || standard_name from l union select 'JGJ-59-2011 ' || standard_name || '～(.pdf' from l union select official_code || ' ' || standard_name from l union select file from kb_md),
ts as (select file, regexp_replace(file, '(?i)\.pdf$', '') as s from tn)"""


def _repaired() -> str:
    s = "s"
    for pattern, by in ops.REPAIRS:
        s = f"regexp_replace({s}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return s


_VAL = r"\d+(?:\.\d+)?\s*(?:mm|cm|km|kN|MPa|kPa|min|kg|m|h|d|%|N|t)"


def _claims() -> str:
    from clausemill.plans.support import _BARE, _base

    return rf"""with {_RC}, c as (select distinct on (item_id) item_id, {_P('official_code')} as code, clause_ref, claimed from plan_writer_citation_summary_sample), b as (select *, {_BARE.format('claimed')} as bare from c where claimed is not null and claimed <> ''),
o as (select item_id, bool_or(contains(t, bare) or num <> '' and contains(t, num) and (unit = '' or contains(t, unit)) or coalesce(len(list_filter(regexp_extract_all(t, '{_VAL}'), lambda v: abs({_base('v')} - {_base('bare')}) < 0.01)) > 0, false)) as matched
 from (select item_id, bare, rt.text as t, regexp_extract(bare, '(\d+(?:\.\d+)?)', 1) as num, trim(regexp_replace(bare, '^[\d.\s]+', '')) as unit from b join rt on rt.code = b.code and rt.clause_no = b.clause_ref) u group by item_id),
v as (select distinct code, regexp_replace(unnest(regexp_extract_all(text, '{_VAL}')), '\s+', '', 'g') as bare from rt)
select b.item_id, case when matched then 'matched' when exists (select 1 from v where v.code = b.code and v.bare = regexp_replace(b.bare, '\s+', '', 'g')) then 'same_standard' when regexp_replace(b.bare, '\s+', '', 'g') in (select bare from v) then 'elsewhere' when matched is not null then 'value_mismatch' else 'missing_clause' end as tier from b left join o using (item_id)"""


_TOPICS = ", ".join(f"('{t}', '{c}')" for t, c in TOPICS)
_FORMS = r"upper(regexp_replace({}, '[/_ ]|-\d{{4}}$', '', 'g'))"
ORACLES = {
    "x28_unknown_codes": f"with {_CC}, {_UNKNOWN} select * from uk",
    "filter9_local_region": f"with {_CC}, {_REGION} select * from fr",
    "x28_code_names": f"with {_RC}, {_names('rt', 'rec_id', 'nm')} select * from nm",
    "x28_dead_references": f"with {_DEAD} select doc_id, code, clause_no from dr",
    "x28_missing_subjects": f"with {_MISSING} select * from ms",
    "x28_verify_report": f"with {_CC}, {_UNKNOWN}, {_REGION}, {_DEAD}, {_MISSING}, {_names('documents', 'doc_id', 'nm')}, vc as ({AUDIT_SQL['a26_document_conflicts']}), i as (select doc_id, 'unknown_code' as issue from uk union all select doc_id, 'foreign_region' from fr union all select doc_id, 'broken_ref' from dr union all select doc_id, 'missing_subject' from ms union all select doc_id, 'code_name' from nm union all select doc_id, 'value_conflict' from vc) select doc_id, issue, count(*) as n from i group by all",
    "x23_claim_resolution": _claims(),
    "x25_chapter_fit": rf"""with s as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), l as (select doc_id, unnest(range(0, len(ls))) as k, unnest(ls) as line from s),
h as (select *, coalesce(last_value(case when length(line) < 60 then nullif(regexp_extract(line, '^#?\s*([1-9])[\s.]', 1), '') end ignore nulls) over (partition by doc_id order by k), '1') as chapter from l), c as (select distinct doc_id, chapter, {_P('o')} as code from (select doc_id, chapter, unnest(regexp_extract_all(line, '{_PATTERN}')) as o from h) u),
e as (select standard_code, arg_min(expected, topic) as expected from standard_status join (values {_TOPICS}) t(topic, expected) on contains(standard_name, topic) group by 1) select doc_id, code, chapter, expected, chapter = expected as fits from c left join e on code = standard_code""",
    "x17_file_references": f"with f as (select file, any_value(standard_code) as own, any_value(text) as text from kb_md group by file), c as (select file, coalesce(own, '') as source_code, unnest(regexp_extract_all(text, '{_PATTERN}')) as o from f) select distinct file, source_code, {_P('o')} as target_code from c where {_P('o')} <> source_code",
    "j2_status_alias": f"with a as (select distinct unnest([upper(standard_code), {_FORMS.format('official_code')}, {_FORMS.format('display_code')}]) as alias, standard_code, status from standard_status), b as (select alias, arg_min(status, standard_code) as status from a where alias is not null group by alias) select coalesce(status, 'unknown') as status, count(*) as n from documents d left join b on alias = {_FORMS.format('coalesce(d.standard_code, chr(39))').replace('chr(39)', chr(39) * 2)} group by 1",
    "j11_file_dedup": "with o as (select source_file as named, min(standard_code) as code from read_clause_full where source_file <> '' group by 1), c as (select standard_code as code, min(file) as f from kb_md where standard_code is not null group by 1) select named, case when named in (select file from kb_md) then named else f end as file, case when named in (select file from kb_md) then 'name' when f is not null then 'code' else 'none' end as way from o left join c using (code)",
    "f7_clean_texts": rf"with {_RC}, k as (select rec_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\$[^$]*\$', ' ', 'g'), '\s+', ' ', 'g')) as t from rt) select rec_id, md5(t) as fingerprint, length(t) as chars from k",
    "f25_file_names": r"with f as (select file, max(title) as title, nullif(regexp_extract(file, '^_seg\d+_\S+ \S+ (.+)_p\d+-\d+_\d+\.md$', 1), '') as own from kb_md group by file), n as (select source_file as file, standard_name, row_number() over (partition by source_file order by count(distinct rec_id) desc, standard_name) as r from read_clause_full where source_file <> '' and standard_name is not null group by 1, 2) select file, coalesce(title, own, standard_name) as name, case when title is not null then 1 when own is not null then 2 when standard_name is not null then 3 end as level from f left join (select * from n where r = 1) c using (file)",
    "f26_name_lint": rf"""with {_TYPED} select file, array_to_string(list_filter([case when contains(s, '  ') then 'double space' end, case when regexp_matches(file, '(?i) \.pdf$') then 'space before suffix' end, case when file like '%.PDF' then 'capital suffix' end, case when regexp_matches(file, '(?:GB|JGJ|CJJ|CECS|DB\d{{2}})(?:[/_]?T)? ?\d{{2,6}}(?:-\d{{4}})?[一-鿿]') then 'no space behind code' end,
case when regexp_matches(s, '^(?:GB|JGJ|CJJ|CECS)\d{{2,6}}') then 'no space in code' end, case when regexp_matches(s, '[—–－]') then 'dash' end, case when contains(s, '∕') then 'division sign' end, case when contains(s, '～') then 'wide tilde' end, case when {_COUNT('(')} <> {_COUNT(')')} then 'odd brackets' end, case when {_COUNT('（')} <> {_COUNT('）')} then 'odd wide brackets' end,
case when contains(s, '(') and contains(s, '）') or contains(s, '（') and contains(s, ')') then 'mixed brackets' end, case when regexp_matches(s, '\d_[^\d]') and not contains(s, '_T') then 'underscore' end], lambda x: x is not null), '|') as problems,
array_to_string(list_filter([case when regexp_matches(file, '^\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}') then 'date first' end, case when regexp_matches(file, '副本|拷贝') then 'copy' end], lambda x: x is not null), '|') as warnings from ts""",
    "f27_name_fixer": rf"with {_TYPED}, a as (select file, {_repaired()} as s from ts), b as (select file, case when contains(s, '(') and contains(s, '）') then replace(s, '(', '（') else s end as s from a), c as (select file, case when contains(s, '（') and contains(s, ')') then replace(s, ')', '）') else s end as s from b) select file, trim(s) || case when regexp_matches(file, '(?i)\.pdf$') then '.pdf' else '' end as fixed from c",
    "w16_glossary_sections": r"with i as (select distinct section_id, file, heading, pos from kb_search_index where heading is not null), s as (select file, min(pos) as start from i where regexp_matches(heading, '^[\d.]*\s*术语(?:和符号|和定义)?\s*$') group by file), e as (select i.file, min(pos) as stop from i join s using (file) where pos > start and try_cast(regexp_extract(heading, '^(\d+)\s', 1) as int) >= 3 group by 1) select section_id, file, pos from i join s using (file) left join e using (file) where pos >= start and (stop is null or pos < stop)",
    "s17_import_parts": """with f as (select file, any_value(text) as t from kb_md where file not in (select source_file from read_clause_full where source_file is not null) group by file), c as (select file, unnest(string_split(t, '')) as ch from f), n as (select file, ch, count(*) as n from c where ch <> '' group by all), e as (select file, -sum(p * log2(p)) as e from (select file, n / sum(n) over (partition by file) as p from n) u group by file),
g as (select file, length(t) as size, case when octet_length(encode(t)) > 8192 then 1000 else length(t) end as step from f join e using (file) where e >= 4.5 and t <> ''), p as (select file, size, step, unnest(range(0, size, step)) as start from g) select file, start // step + 1 as part, start, least(step, size - start) as length from p""",
    "k4_suggestions_golden": r"with qs as (select query_id as qid, min(query) as text from golden_queries where query_id % 20 = 0 and query is not null group by 1), a as (select qid, lower(trim(text)) as typed, list_filter(regexp_split_to_array(lower(trim(text)), '[\s　]+'), lambda w: w <> '') as ws from qs), t as (select distinct regexp_replace(heading, '^[\d.]+\s+', '') as text from kb_search_index where heading is not null), h as (select qid, text, case when starts_with(lower(text), typed) then 0 else 1 end as tier from t, a where len(ws) > 0 and len(list_filter(ws, lambda w: contains(lower(text), w))) = len(ws)), r as (select *, row_number() over (partition by qid order by tier, length(text), text) as r from h) select qid, r, text, tier from r where r <= 8",
    "a13_hot_clauses": "select official_code, clause_ref, count(*) as n from (select distinct on (item_id) * from plan_writer_citation_summary_sample) u where official_code <> '' and clause_ref <> '' group by all order by n desc, official_code, clause_ref limit 20",
    "a13_rank_distribution": "with l as (select log_id, any_value(c) as c from search_log group by 1), u as (select unnest(range(1, len(c) + 1)) as rank, unnest(c) as code from l) select rank, count(*) as n from u where code in (select expected_standard_code from golden_queries where expected_standard_code <> '') group by 1",
    "a16_search_metrics": "with l as (select distinct on (log_id) log_id, coalesce(mode, 'unknown') as mode, results, duration_ms, c from search_log), s as (select distinct log_id from (select log_id, unnest(c) as code from l) u where code in (select standard_code from standard_status where status in ('superseded', 'abolished'))) select coalesce(mode, 'all') as mode, count(*) as n, round(avg(case when coalesce(results, 0) = 0 then 1 else 0 end), 4) as no_result_rate, round(avg(case when log_id in (select log_id from s) then 1 else 0 end), 4) as stale_rate, round(avg(duration_ms), 2) as mean_ms from l group by rollup(mode)",
    "a22_query_tags": "with l as (select distinct on (log_id) log_id, lower(q) as q from search_log where q is not null and trim(q) <> ''), k as (select * from l order by log_id desc limit 500), t as (select distinct log_id, term_group as tag from k join term_map on contains(q, term)), r as (select *, row_number() over (partition by log_id order by tag) as r from t) select log_id, tag from r where r <= 3",
    "x34_term_promotion": f"with m as ({AUDIT_SQL['x34_term_candidates']}) select word, 'log' as origin from m union all select distinct word, 'synonym' from (select unnest(syn) as word from term_map) u where word <> '' and word not in (select term from term_map)",
    "x36_integrity_layers": r"with l as (select file, imported_at, length(text) as size, sha256(text) as digest, length(text) - length(replace(text, chr(10), '')) + 1 as n from kb_md), f as (select file, arg_min(l, struct_pack(t := imported_at, d := digest)) as a, arg_max(l, struct_pack(t := imported_at, d := digest)) as b from l group by file) select file, array_to_string(list_filter([case when not regexp_matches(file, '^_seg\d+_.+_p\d+-\d+_\d+\.md$') then 'naming' end, case when abs(a.size - b.size) > 0.01 * a.size then 'size' end, case when a.digest <> b.digest then 'digest' end, case when abs(a.n - b.n) > 0.05 * a.n then 'lines' end, case when file not in (select file from kb_search_index where file is not null) then 'index' end], lambda x: x is not null), '|') as failed from f",
}
