"""Questions answered end to end: expansion, seeds, walk, routing, hydration, clause reading and support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.functions.codes import code_token, normalize_code
from clausemill.functions.codes import normalize_code
from clausemill.operators import answers as ops, graph, lexical, reading, search, seeds
from clausemill.plans import graph as graph_plans, search as search_plans
from clausemill.plans.lexical import GOLDEN as GOLDEN_SQL, all_questions, golden_questions
from clausemill.session import materialise, read, read_wide


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "term_map").select("term", "term_group", "syn")


def d2_expansion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words added to each golden query by its best groups of terms, fifteen at most."""
    return ops.expanded(golden_questions(spark, sf_dir), _terms(spark, sf_dir))


def _asked_with_synonyms(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    extra = ops.expanded(asked, _terms(spark, sf_dir)).groupBy("qid").agg(F.array_sort(F.collect_list("word")).alias("synonyms"))
    return asked.join(extra, "qid", "left").withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))


def _vocabulary(spark: SparkSession, sf_dir: str) -> seeds.Vocabulary:
    """The known terms with their files, followers and company."""
    headings = materialise(graph_plans._heading_hits(spark, sf_dir).select("section_id", "file", "term"))
    degree = headings.groupBy("term").agg(F.countDistinct("file").alias("files"))
    follows = graph_plans.followers(spark, sf_dir)
    return seeds.collected_vocabulary(_terms(spark, sf_dir).select("term").join(degree, "term", "left"), follows, lexical.cooccurrence(headings, "section_id", "term"))


def d8_lattice_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each golden query by what the lattice walk leaves on them."""
    asked = _asked_with_synonyms(spark, sf_dir, golden_questions(spark, sf_dir))
    return seeds.seeds_of(asked, _vocabulary(spark, sf_dir), "lattice").select("qid", F.col("node").alias("term"), F.round("e", 6).alias("weight"))


def d9_bridged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in the company of a golden query's strong terms that resemble its unknown pieces."""
    asked = _asked_with_synonyms(spark, sf_dir, golden_questions(spark, sf_dir))
    return seeds.seeds_of(asked, _vocabulary(spark, sf_dir), "bridged").select("qid", F.col("node").alias("term"), F.round("e", 6).alias("weight"))


def _start(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Teleport vectors of questions; body scores of the fifteen best files stand in for sentence vectors, which the data link to no question."""
    terms = materialise(seeds.seeds_of(_asked_with_synonyms(spark, sf_dir, asked), _vocabulary(spark, sf_dir)))
    bodies = search_plans._bodies_asked(spark, sf_dir, asked)
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "file"))
    best = materialise(bodies.withColumn("r", first).filter("r <= 15"))  # used several times, like the terms
    top = best.groupBy("qid").agg(F.max("score").alias("top"))
    sentences = best.join(top, "qid").select("qid", F.col("file").alias("node"), (F.col("score") / F.col("top")).alias("sim"))
    return seeds.teleport(terms, sentences=sentences)


def d10_teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each golden query's walk starts."""
    return _start(spark, sf_dir, golden_questions(spark, sf_dir)).select("qid", "node", F.round("e", 8).alias("e"))


def _discovered(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    edges = graph_plans._graph(spark, sf_dir)
    start = graph.inject_asked(materialise(_start(spark, sf_dir, asked)), edges)
    return graph.discover_asked(start, graph.matrix(edges))


def d13_discovered_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the walks of the golden queries reach."""
    return _discovered(spark, sf_dir, golden_questions(spark, sf_dir)).select("qid", "file", F.round(F.col("p") * graph.SHOWN, 1).alias("score"))


#: Settings of the graph that are tried: file ratio, heading boost, followers.
GRID = ((1.0, 2.0, 3.0, 5.0, 8.0), (20.0, 50.0, 100.0, 200.0), (3, 5, 10, 20))


def x39_graph_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph rebuilt and walked under eighty settings: edges, and golden queries whose standard is among the ten best files.

    Settings are part of the nodes' and questions' names, so all are walked at once.
    """
    asked = golden_questions(spark, sf_dir)
    ratios, boosts, most = GRID
    edges = graph_plans._edges(spark, sf_dir).filter("etype <> 'bigram'")
    built = materialise(graph.grid(edges, {k: graph_plans.followers(spark, sf_dir, k) for k in most}, F.col("dst").endswith(".md"), ratios, boosts))
    name = F.concat_ws("/", "setting.ratio", "setting.boost", "setting.most")
    named = built.select(name.alias("setting"), F.concat(name, F.lit("|"), "src").alias("src"), F.concat(name, F.lit("|"), "dst").alias("dst"), "to_file", "w_int")
    settings = named.select("setting").distinct()
    start = materialise(_start(spark, sf_dir, asked)).crossJoin(F.broadcast(settings)).select(F.concat("setting", F.lit("|"), "qid").alias("qid"), F.concat("setting", F.lit("|"), "node").alias("node"), "e")
    found = graph.discover_asked(graph.inject_asked(start, named), graph.matrix(named))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("p", 10)), "file")
    best = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ops.RESULTS)
    best = search_plans._coded(best.select(F.substring_index("qid", "|", 1).alias("setting"), F.substring_index("qid", "|", -1).cast("bigint").alias("query_id"), F.regexp_replace("file", r"^[^|]*\|", "").alias("file")))
    wanted = read(spark, sf_dir, "golden_queries").filter("expected_standard_code <> '' and query_id % 20 = 0").groupBy("query_id").agg(F.min(normalize_code(F.col("expected_standard_code"))).alias("code"))
    hits = best.join(wanted, ["query_id", "code"], "left_semi").select("setting", "query_id").distinct().groupBy("setting").agg(F.count("*").alias("hits"))
    sizes = named.groupBy("setting").agg(F.count("*").alias("edges"), F.round(F.count_if("to_file") / F.count_if(~F.col("to_file")), 4).alias("file_ratio"))
    return sizes.join(hits, "setting", "left").select("setting", "edges", "file_ratio", F.coalesce("hits", F.lit(0)).alias("hits"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_plans._sections(spark, sf_dir).join(search_plans._index_positions(spark, sf_dir), ["file", "sid"])


def x2_hydrated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by title with the section shown for each."""
    found = search_plans.d4_title_lookup(spark, sf_dir, golden_questions(spark, sf_dir)).withColumns({"heading": F.lit(None).cast("string"), "pos": F.lit(None).cast("int")})
    texts = _sections(spark, sf_dir)
    return ops.hydrated(found, materialise(texts.drop("segment")), texts).select("qid", "file", "heading", "pos", F.length("text").alias("chars"), "clause_number", "tier")


def x2_hydrated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause records with the section of their file: by heading, else by the position of the file's body."""
    rows = read(spark, sf_dir, "read_clause_full").filter("source_file <> ''").groupBy(F.col("rec_id").alias("qid")).agg(F.min("source_file").alias("file"), F.min("source_heading").alias("heading"))
    start = search_plans._index_positions(spark, sf_dir).groupBy("file").agg(F.max("pos").alias("pos"))
    found = rows.join(start, "file", "left")
    texts = _sections(spark, sf_dir)
    return ops.hydrated(found, materialise(texts.drop("segment")), texts).select("qid", "file", "heading", "pos", F.length("text").alias("chars"), "clause_number", "tier")


def _file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three groups whose terms a file's headings name most: file, tag."""
    index = read(spark, sf_dir, "kb_search_index").select("section_id", "file", "heading").distinct()
    return ops.common_tags(lexical.contained(index, "heading", _terms(spark, sf_dir), "term", "term_group"), "file")


def _query_tags(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    return ops.common_tags(lexical.contained(asked, "text", _terms(spark, sf_dir), "term", "term_group"), "qid")


def answered(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Every question's ten best files by the first branch that answers it: title, clause, keywords for codes and names, else the graph.

    qid, position, file, code, heading, pos, text, score, branch, confidence.
    """
    asked = materialise(asked.select("qid", "text"))
    kind = asked.select("qid", ops.has_code(F.col("text")).alias("coded"), ops.is_standard_name(F.col("text")).alias("named"))
    exact, free = kind.filter("coded or named").select("qid"), kind.filter("not (coded or named)").select("qid")
    texts = _sections(spark, sf_dir)
    sections = materialise(texts.drop("segment"))  # places alone; the texts are read twice, by keywords and for what is shown
    keyword = materialise(search.keyword_search(asked, texts.drop("pos")))
    references = search_plans._references(spark, sf_dir)
    title = search.title_lookup(asked, read_wide(spark, sf_dir, "kb_md").select("file", "title").distinct())
    direct = direct_tiers(spark, sf_dir, asked).join(kind.filter("not named").select("qid"), "qid", "left_semi")
    none = lambda df, *have: df.select("qid", "file", *(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("heading", "string"), ("pos", "int"))), F.col("score").cast("double").alias("score"))
    legacy = search.dedup_segments(keyword.join(exact, "qid", "left_semi"))
    natural = ops.natural_candidates(
        keyword.join(free, "qid", "left_semi"), _discovered(spark, sf_dir, asked.join(free, "qid", "left_semi").filter(F.length("text") >= 4)).select("qid", "file", F.round(F.col("p") * graph.SHOWN, 1).alias("score")),
        sections, _query_tags(spark, sf_dir, asked), _file_tags(spark, sf_dir),
    )
    branches = [("title", none(title)), ("direct", none(direct, "heading")), ("keyword", none(legacy, "heading")), ("graph", none(natural, "heading"))]
    return ops.finished(branches, references, sections, texts, search_plans._coded)


def direct_tiers(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Clauses and standards named by code: qid, file, heading, score, source, the best tier of each question."""
    files = search_plans._coded(read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"]))
    index = read(spark, sf_dir, "kb_search_index").select("file", "heading", "pos", "type").distinct()
    return ops.direct_tiers(asked, search_plans._lookup(spark, sf_dir), files, index)


def j10_direct_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries that name a code, by the tier that answers them."""
    return direct_tiers(spark, sf_dir, golden_questions(spark, sf_dir)).select("qid", "file", "heading", "score", "source")


def x9_routed_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every golden query answered by the first branch that finds something, the graph included."""
    return answered(spark, sf_dir, all_questions(spark, sf_dir)).select("qid", "position", "file", "heading", F.round("score", 2).alias("score"), "branch", "confidence")


def _public_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden queries asked, every held-out query, and one question for pictures of each group of terms."""
    golden = golden_questions(spark, sf_dir).select(F.concat(F.lit("golden "), "qid").alias("qid"), "text")
    held = read(spark, sf_dir, "held_out_queries").select(F.concat(F.lit("held "), "id").alias("qid"), F.col("query").alias("text"))
    groups = _terms(spark, sf_dir).groupBy("term_group").agg(F.concat_ws(" ", F.array_sort(F.collect_set("term"))).alias("words"))
    return golden.unionByName(held).unionByName(groups.select(F.concat(F.lit("image "), "term_group").alias("qid"), F.concat(F.lit("image:"), "words").alias("text")))


def x11_public_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the public door: pictures or files, with coverage, and with support where a held-out item asks the same."""
    asked = materialise(_public_questions(spark, sf_dir))
    pictures = ops.picture_search(asked.filter("startswith(text, 'image:')"), read_wide(spark, sf_dir, "read_clause_full").select("rec_id", "source_file", "clause_text").dropDuplicates(["rec_id"]))
    found = answered(spark, sf_dir, asked.filter("not startswith(text, 'image:')"))
    guarded = ops.guarded_answers(found, asked, read(spark, sf_dir, "held_out_queries"), read(spark, sf_dir, "standard_status"))
    return guarded.unionByName(pictures, allowMissingColumns=True).select("qid", "position", "file", "heading", F.round("score", 2).alias("score"), "branch", "confidence", F.round("coverage", 4).alias("coverage"), "judgment", "action", "missing")


def x11_zero_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records of the questions that the public door answers with nothing."""
    asked = _public_questions(spark, sf_dir)
    return asked.join(x11_public_search(spark, sf_dir).select("qid").distinct(), "qid", "left_anti").select("qid", F.lit("zero_result").alias("type"), F.col("text").alias("query"))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files with their code and text, and the index of their sections."""
    files = search_plans._coded(read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"]))
    return files, read(spark, sf_dir, "kb_search_index").select("file", "heading", "pos", "type").distinct()


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause that the clause records name."""
    return read(spark, sf_dir, "read_clause_full").select(F.col("standard_code").alias("code"), "clause_no").distinct()


def x13_read_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause that the clause records name, read from the files."""
    files, index = _corpus(spark, sf_dir)
    return reading.read_clauses(_requested(spark, sf_dir), files, index).select("code", "clause_no", "file", "method", "type", "heading", F.length("text").alias("chars"), F.md5("text").alias("fingerprint"))


def x15_followed_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with those that only point at another clause followed one step."""
    files, index = _corpus(spark, sf_dir)
    wanted = _requested(spark, sf_dir)
    read_ = materialise(reading.read_clauses(wanted, files, index))
    return reading.followed(wanted, read_, files, index).select("code", "clause_no", "file", "via", F.length("text").alias("chars"))


def x14_clause_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as full records: state, citation, content, and why nothing was found."""
    files, index = _corpus(spark, sf_dir)
    wanted = _requested(spark, sf_dir)
    records = reading.clause_records(wanted, reading.read_clauses(wanted, files, index), files, read(spark, sf_dir, "standard_status"))
    return records.select("code", "clause_no", "official_code", "clause_type", "source_file", "match_method", "version_status", "confidence", "failure_reason", "citation", "content_flags")


def x12_resolved_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries resolved to one clause: the standard of the best result, the clause named there, and its text."""
    asked = golden_questions(spark, sf_dir)
    files, index = _corpus(spark, sf_dir)
    locked = materialise(ops.locked_clauses(answered(spark, sf_dir, asked)))
    texts = reading.read_clauses(locked.select("code", F.col("clause").alias("clause_no")).distinct(), files, index)
    out = locked.join(texts, (locked["code"] == texts["code"]) & (locked["clause"] == texts["clause_no"]))
    return out.select("qid", locked["code"], "clause", "file", "method", F.length("text").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        d2_expansion_groups, d8_lattice_seeds, d9_bridged_terms, d10_teleport, d13_discovered_golden, x2_hydrated_titles, x2_hydrated_sections, j10_direct_tiers, x9_routed_golden, x11_public_search, x11_zero_results, x12_resolved_clauses,
        x13_read_clauses, x14_clause_records, x15_followed_clauses, x39_graph_grid,
    )
}

_SECTIONS = """fl as (select file, any_value(text) as body from kb_md group by file), ix as (select distinct file, sid, heading, pos from kb_search_index where heading is not null),
sx as (select ix.file, sid, heading, pos, coalesce(lead(pos) over (partition by ix.file order by pos, sid, heading), length(body)) - pos as length, body from ix join fl using (file))"""
_PLAIN = "regexp_replace(heading, '\\s+', '', 'g')"


def _hydrate(candidates: str) -> str:
    """CTEs of the hydration of candidates (qid, file, heading, pos)."""
    return rf"""{_SECTIONS}, cd as ({candidates}),
by_heading as (select file, heading, min(pos) as pos from sx group by file, heading), ranked as (select *, row_number() over (partition by file order by pos, sid, heading) as r from sx),
fallback as (select file, coalesce(min(r) filter (r <= 10 and length >= 100 and not regexp_matches(heading, '{search.CONTENTS_HEADING}') and not regexp_matches({_PLAIN}, '{search.GENERAL_HEADING}')), 1) as r from ranked group by file),
chosen as (select cd.qid, cd.file, case when h.pos is not null then 'heading' when p.pos is not null then 'position' else 'first' end as tier, coalesce(h.pos, p.pos, f.pos) as pos
  from cd left join by_heading h on h.file = cd.file and h.heading = cd.heading and not starts_with(cd.heading, '_seg') and length(cd.heading) <= 60 left join (select distinct file, pos from sx) p on p.file = cd.file and p.pos = cd.pos
  join (select ranked.* from ranked join fallback using (file, r)) f on f.file = cd.file),
shown as (select file, pos, min(heading) as heading, min_by(length, heading) as length, any_value(body) as body from sx group by file, pos)
select qid, file, substr(heading, 1, 80) as heading, pos, length(substr(body, pos + 1, least(length, 2000))) as chars, nullif(regexp_extract(heading, '^(\d+(?:\.\d+)*)\s', 1), '') as clause_number, tier from chosen join shown using (file, pos)"""


ORACLES = {
    "d2_expansion_groups": rf"""with {GOLDEN_SQL}, w as (select distinct qid, unnest(regexp_split_to_array(lower(trim(text)), '[\s　]+')) as word from qs),
m as (select distinct qid, term, term_group from w join term_map on word = lower(term) or length(word) <= 12 and contains(word, lower(term))),
k as (select qid, term_group, count(distinct term) as hits from qs join term_map on contains(lower(text), lower(term)) group by all),
s as (select m.qid, m.term_group, sum(coalesce(hits, 0) + 1) as score from m left join k using (qid, term_group) group by all),
b as (select *, row_number() over (partition by qid order by term_group) as r from (select *, max(score) over (partition by qid) as best from s) u where score = best),
c as (select distinct qid, word from (select qid, term as word from b join term_map using (term_group) where r <= 2 union all select qid, unnest(syn) from b join term_map using (term_group) where r <= 2) u where word is not null and word <> ''),
e as (select qid, word, row_number() over (partition by qid order by word) as r from c where not exists (select 1 from w where w.qid = c.qid and w.word = lower(c.word))) select qid, word from e where r <= 15""",
    "x2_hydrated_titles": f"with {GOLDEN_SQL}, " + _hydrate("select distinct qid, file, cast(null as varchar) as heading, cast(null as int) as pos from qs join (select distinct file, title from kb_md where title is not null) t on length(regexp_replace(text, '\\s+', '', 'g')) >= 4 and (contains(title, regexp_replace(text, '\\s+', '', 'g')) or contains(regexp_replace(text, '\\s+', '', 'g'), title))"),
    "x2_hydrated_sections": "with " + _hydrate("select rec_id as qid, file, r.heading, ps.pos from (select rec_id, min(source_file) as file, min(source_heading) as heading from read_clause_full where source_file <> '' group by rec_id) r left join (select file, max(pos) as pos from kb_search_index where heading is not null group by file) ps using (file)"),
}
