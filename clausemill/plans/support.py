"""Queries over the support of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clausemill.functions import support as fn
from clausemill.operators import lexical, support as ops
from clausemill.session import read

#: Clauses of each item that are ranked.
MOST_RANKED = 10
CONDITIONS = ("面积大于1000m²", "温度25℃", "流量 5 m 3", "厚度，间距；净距 或 高度/宽度", "体积 2 m^{3} 以上", "$5\\mathrm{m}$")


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "read_clause_full").select("rec_id", "standard_code", "clause_no", "clause_text", "clause_type", "version_status", "failure_reason").distinct()
    return rows.filter("clause_text is not null and clause_text <> ''")


def f11_content_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of clause texts."""
    return _clauses(spark, sf_dir).select("rec_id", fn.content_flags(F.col("clause_text")).alias("f")).select("rec_id", "f.*")


def f12_unit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and plain text of fixed spellings."""
    rows = spark.createDataFrame([(c,) for c in CONDITIONS], "raw string")
    return rows.select("raw", fn.unit_text(F.col("raw")).alias("units"), fn.plain_text(F.col("raw")).alias("plain"))


def f13_plain_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of clause texts in plain form."""
    return _clauses(spark, sf_dir).select("rec_id", F.substring(F.md5(fn.plain_text(F.col("clause_text"))), 1, 8).alias("fingerprint"))


def f15_condition_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the conditions of required facts."""
    facts = read(spark, sf_dir, "held_out_queries").select("id", F.inline("required_facts"))
    return facts.select("id", "fact", F.array_join(fn.condition_tokens(F.concat_ws("、", "fact", "condition")), "|").alias("tokens"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = read(spark, sf_dir, "plan_writer_citation_summary_sample").select("item_id", "plan_id", "official_code", "clause_ref", "claimed").distinct()
    return cited.filter("claimed is not null and claimed <> ''")


def f17_claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed values without comparison and in base units."""
    return _claims(spark, sf_dir).select("item_id", fn.without_comparison(F.col("claimed")).alias("bare"), F.round(fn.base_value(F.col("claimed")), 6).alias("base"))


def f19_claims_in_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims held against the clauses of that number in the standard cited."""
    claims = _claims(spark, sf_dir).withColumn("code", F.regexp_replace(F.regexp_replace("official_code", r"-\d{4}$", ""), "[/ ]", ""))
    clauses = _clauses(spark, sf_dir).select(F.col("standard_code").alias("code"), F.col("clause_no").alias("clause_ref"), "rec_id", "clause_text")
    pairs = claims.join(clauses, ["code", "clause_ref"])
    return pairs.select("item_id", "rec_id", fn.claim_in_text(F.col("claimed"), F.col("clause_text")).alias("held"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "held_out_queries").select("id", "query_type", "required_clauses", "required_facts", F.get("required_clauses", F.lit(0))["standard_code"].alias("code"))
    results = _clauses(spark, sf_dir).select(F.col("standard_code").alias("code"), "rec_id", F.col("standard_code").alias("result_code"), F.col("version_status").alias("result_status"), F.concat_ws("\n", "clause_no", "clause_text").alias("text"))
    return ops.judge(results.join(items, "code"))


def x19_support_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of the standard each item needs, judged against it."""
    return _judged(spark, sf_dir).select("id", "rec_id", "standard_hit", "clause_hit", "fact_hit", "version_ok", "judgment", "action", "missing")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MOST_RANKED clauses of each item's standard that share most tokens with its question, judged: adds score and rank.

    Numbers are ranked first; the texts are joined to the ranked ones only.
    """
    items = read(spark, sf_dir, "held_out_queries").select("id", "required_clauses", "required_facts", F.get("required_clauses", F.lit(0))["standard_code"].alias("code"), lexical.token_array(F.col("query")).alias("asked"))
    clauses = _clauses(spark, sf_dir).select(F.col("standard_code").alias("code"), "rec_id", "clause_no", "clause_text", "version_status")
    shared = F.size(F.array_intersect("asked", lexical.token_array(F.col("clause_text")))).cast("double")
    scores = clauses.select("code", "rec_id", "clause_text").join(items.select("id", "code", "asked"), "code").select("id", "rec_id", shared.alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "rec_id")
    first = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST_RANKED)
    texts = clauses.select("rec_id", F.col("code").alias("result_code"), F.col("version_status").alias("result_status"), F.concat_ws("\n", "clause_no", "clause_text").alias("text"))
    return ops.judge(first.join(texts, "rec_id").join(items.drop("code", "asked"), "id"))


def x20_support_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's best clauses reranked by their judgement."""
    return ops.guarded(_ranked(spark, sf_dir), "id", "rec_id").select("id", "rec_id", "original_rank", "new_rank", "adjusted")


def filter8_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged clauses by where they go."""
    return _judged(spark, sf_dir).groupBy(ops.shelf(F.col("action")).alias("shelf")).agg(F.count("*").alias("n"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.evaluated(_ranked(spark, sf_dir), read(spark, sf_dir, "held_out_queries"), MOST_RANKED)


def x21_evaluate_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items judged on their three best clauses together, with the reason of a failure."""
    best = _evaluated(spark, sf_dir).filter("k = 3")
    reason = ops.failure(F.col("standard_hit"), F.col("clause_hit"), F.col("fact_hit"), F.col("version_ok"), F.col("n"))
    return best.select("id", "standard_hit", "clause_hit", "fact_hit", "version_ok", "support_ok", reason.alias("failure"))


def x22_failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by why they failed."""
    return x21_evaluate_at_k(spark, sf_dir).groupBy(F.coalesce("failure", F.lit("none")).alias("failure")).agg(F.count("*").alias("n"))


def w12_first_supporting_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At how many of its best clauses each item is first supported by all of them together; null where never."""
    return _evaluated(spark, sf_dir).groupBy("id").agg(F.min(F.when(F.col("support_ok"), F.col("k"))).alias("first_rank"))


def a17_truth_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over all items and by kind of question: support at one and three, decisions, errors, and what the guard changes."""
    items = read(spark, sf_dir, "held_out_queries").select("id", "query_type", "expected_outcome")
    at = _evaluated(spark, sf_dir)
    one = at.filter("k = 1").select("id", F.col("support_ok").alias("support_1"))
    three = at.filter("k = 3").select("id", F.col("support_ok").alias("support_3"), "standard_hit", "clause_hit", "fact_hit", "stale", "deleted", "forbidden")
    guarded = ops.guarded(_ranked(spark, sf_dir), "id", "rec_id").withColumn("good", F.col("action") == "use_as_evidence")
    top = guarded.groupBy("id").agg(
        F.max_by("action", -F.col("original_rank")).alias("top_action"), F.max_by("action", -F.col("new_rank")).alias("guarded_action"), F.max_by("good", -F.col("new_rank")).alias("guarded_good"),
        (F.max_by("rec_id", -F.col("original_rank")) != F.max_by("rec_id", -F.col("new_rank"))).alias("top_changed"), F.bool_or((F.col("original_rank") <= 3) & (F.col("action") == "block_forbidden")).alias("blocked_3"),
    )
    rows = items.join(one, "id", "left").join(three, "id", "left").join(top, "id", "left").withColumn("found", F.col("top_action").isNotNull())
    yes = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    spoiled = yes("stale") | yes("deleted") | yes("forbidden")
    high = F.col("found") & ~yes("support_1")
    flags = {
        "support_1": yes("support_1"), "support_3": yes("support_3"), "decision_3": F.when(F.col("expected_outcome") == "support", yes("support_3")).otherwise(~yes("support_3")), "standard_3": yes("standard_hit"), "clause_3": yes("clause_hit"),
        "fact_3": yes("fact_hit"), "forbidden_rate": yes("forbidden"), "deleted_rate": yes("deleted"), "stale_rate": yes("stale"), "unsupported_high": high, "simulated_support_1": yes("guarded_good"), "simulated_high": F.col("found") & ~yes("guarded_good"),
        "top_changed": yes("top_changed"), "evidence_use": yes(F.col("top_action") == "use_as_evidence"), "manual_review": yes(F.col("top_action") == "manual_review"), "blocked_top": yes(F.col("guarded_action") == "block_forbidden"),
    }
    given = {
        "high_guarded": F.when(high, F.col("top_action") != "use_as_evidence"), "spoiled_blocked": F.when(spoiled, yes("blocked_3")), "clause_given_standard": F.when(yes("standard_hit"), yes("clause_hit")),
    }
    rate = lambda name, c: F.round(F.avg(c.cast("int")), 4).alias(name)
    out = rows.rollup("query_type").agg(F.count("*").alias("n"), *[rate(k, c) for k, c in (flags | given).items()])
    return out.withColumn("query_type", F.coalesce("query_type", F.lit("all")))


QUERIES = {
    f.__name__: f
    for f in (
        f11_content_flags, f12_unit_text, f13_plain_clauses, f15_condition_tokens, f17_claim_values, f19_claims_in_clauses, x19_support_judgement, x20_support_rerank, filter8_shelves, x21_evaluate_at_k, x22_failure_classes, w12_first_supporting_rank, a17_truth_metrics,
    )
}


def _unit(x: str) -> str:
    for old, new in fn.UNITS:
        x = f"replace({x}, '{old}', '{new}')"
    x = rf"regexp_replace({x}, '(?i)m\s*\^\s*\{{?2\}}?', 'm2', 'g')"
    x = rf"regexp_replace({x}, '(?i)m\s*\^\s*\{{?3\}}?', 'm3', 'g')"
    return rf"regexp_replace({x}, '(?i)(m)\s+([23])\b', '\1\2', 'g')"


def _plain(x: str) -> str:
    return rf"lower(regexp_replace({_unit(rf'''regexp_replace(replace(coalesce({x}, ''), '\mathrm', ''), '[{{}}$]', '', 'g')''')}, '\s+', '', 'g'))"



_CLS = "cls as (select distinct rec_id, standard_code, clause_no, clause_text, clause_type, version_status, failure_reason from read_clause_full where clause_text is not null and clause_text <> '')"
_UNIT_RE = "(mm|cm|km|kN|MPa|kPa|min|kg|m|h|d|%|N|t)"
_FACTOR = "case {u} " + " ".join(f"when '{u}' then {f}" for u, f in fn.FACTORS.items()) + " end"


def _base(x: str) -> str:
    return rf"try_cast(regexp_extract({x}, '(\d+(?:\.\d+)?)\s*{_UNIT_RE}', 1) as double) * " + _FACTOR.replace("{u}", rf"regexp_extract({x}, '(\d+(?:\.\d+)?)\s*{_UNIT_RE}', 2)")


_BARE = rf"trim(regexp_replace(trim({{}}), '^({'|'.join(fn.COMPARISONS)})', ''))"
_DEL = " or ".join(f"contains(text, '{m}')" for m in fn.DELETED)
_TOK = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[、，,；;或和/\s]+'), lambda t: length(t) >= 2)"


def _value(plain: str, v: str, u: str) -> str:
    raw = f"replace({_unit(f'''coalesce({v}, '')''')}, ' ', '')"
    short = rf"case when contains({raw}, '.') then regexp_replace(regexp_replace({raw}, '0+$', ''), '\.$', '') else {raw} end"
    return f"({raw} = '' or contains({plain}, {raw} || {_plain(u)}) or ({short}) <> '' and contains({plain}, ({short}) || {_plain(u)}))"


def _facts(plain: str) -> str:
    """A table of (id, key, hit) over the facts of pr: one row a fact."""
    any_of = lambda x: f"(len({_TOK.format(x)}) = 0 or len(list_filter({_TOK.format(x)}, lambda t: contains({plain}, {_plain('t')}))) > 0)"
    return f"case when {_plain('f.fact')} <> '' and contains({plain}, {_plain('f.fact')}) then {_value(plain, 'f.value', 'f.unit')} else {_value(plain, 'f.value', 'f.unit')} and {any_of('f.fact')} and {any_of('f.condition')} end"


_JUDGED = f"""{_CLS}, it as (select id, query_type, required_clauses as rc, required_facts as rf, required_clauses[1].standard_code as code from held_out_queries),
pr as (select it.*, rec_id, version_status, concat_ws(chr(10), clause_no, clause_text) as text, {_plain("concat_ws(chr(10), standard_code, clause_no, clause_text)")} as plain from it join cls on standard_code = code),
fu as (select id, rec_id, plain, unnest(rf) as f from pr), fh as (select id, rec_id, bool_and({_facts('plain')}) as fact_hit from fu group by all),
h as (select pr.*, len(list_filter(rc, lambda c: coalesce(c.standard_code, '') = '' or c.standard_code = code)) > 0 as standard_hit,
  len(list_filter(rc, lambda c: (coalesce(c.standard_code, '') = '' or c.standard_code = code) and ({_plain('c.clause_no')} = '' or contains(plain, {_plain('c.clause_no')})))) > 0 as clause_hit, coalesce(fact_hit, true) as fact_hit,
  coalesce(version_status in ('superseded', 'abolished'), false) as stale, ({_DEL}) and len(list_filter(rc, lambda c: lower(c.clause_type) = 'deleted')) = 0 as deleted from pr left join fh using (id, rec_id)),
j as (select *, not stale and not deleted as version_ok, case when standard_hit and clause_hit and fact_hit and not stale and not deleted then 'supported' when standard_hit or clause_hit or fact_hit then 'insufficient_support' else 'manual_review' end as judgment,
  case when stale or deleted then 'block_forbidden' when standard_hit and clause_hit and fact_hit then 'use_as_evidence' when standard_hit or clause_hit or fact_hit then 'warn_insufficient_support' else 'manual_review' end as action,
  array_to_string(list_filter([case when not standard_hit then 'standard' end, case when not clause_hit then 'clause' end, case when not fact_hit then 'fact' end, case when stale or deleted then 'version' end], lambda x: x is not null), '|') as missing from h)"""
_TOKENS = "list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}'), flatten(list_transform(regexp_extract_all(lower({0}), '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"
_RANKED = f"""{_JUDGED}, sx as (select it.id, cls.rec_id, cast(len(list_intersect({_TOKENS.format('h.query')}, {_TOKENS.format('cls.clause_text')})) as double) as score from it join held_out_queries h using (id) join cls on cls.standard_code = it.code),
sr as (select *, row_number() over (partition by id order by score desc, rec_id) as rank from sx), rk as (select j.*, score, rank from j join sr using (id, rec_id) where rank <= {MOST_RANKED})"""
_AT_K = f"""{_RANKED}, ek as (select id, k, bool_or(standard_hit) as standard_hit, bool_or(clause_hit) as clause_hit, bool_or(stale) as stale, bool_or(deleted) as deleted, count(*) as n, any_value(rf) as rf, string_agg(text, chr(10) order by rank) as evidence from rk, (select unnest(range(1, {MOST_RANKED + 1})) as k) ks where rank <= k group by id, k),
ep as (select *, {_plain('evidence')} as plain from ek), eu as (select id, k, plain, unnest(rf) as f from ep), ef as (select id, k, bool_and({_facts('plain')}) as fact_hit from eu group by id, k),
ev as (select id, k, standard_hit, clause_hit, coalesce(fact_hit, true) as fact_hit, stale, deleted, not stale and not deleted as version_ok, n, standard_hit and clause_hit and coalesce(fact_hit, true) and not stale and not deleted as support_ok from ep left join ef using (id, k)),
fail as (select id, standard_hit, clause_hit, fact_hit, version_ok, support_ok, case when not version_ok then 'version_or_forbidden_failure' when n = 0 or not standard_hit then 'recall_failure' when not clause_hit then 'clause_location_failure' when not fact_hit then 'fact_support_failure' end as failure from ev where k = 3)"""
_GUARDED = "ga as (select *, score as s, row_number() over (partition by id order by score desc, rec_id) as original_rank, round(score * case action when 'use_as_evidence' then 1.0 when 'warn_insufficient_support' then 0.75 when 'manual_review' then 0.55 when 'block_forbidden' then 0.1 else 0.5 end, 6)::double as adjusted from rk), gd as (select *, row_number() over (partition by id order by adjusted desc, original_rank) as new_rank from ga)"
_COND = ", ".join(f"('{c}')" for c in CONDITIONS)
ORACLES = {
    "f11_content_flags": rf"with {_CLS} select rec_id, contains(clause_text, '<table') or regexp_matches(clause_text, '表\s*\d') as has_table, contains(clause_text, '$') or contains(clause_text, '式中') as has_formula, contains(clause_text, '检查数量') as has_quantity, contains(clause_text, '检验方法') as has_method, regexp_matches(clause_text, '必须|严禁|不得') as is_strict, contains(clause_text, '附录') as has_appendix, {_DEL.replace('text', 'clause_text')} as is_deleted from cls",
    "f12_unit_text": f"select raw, {_unit('raw')} as units, {_plain('raw')} as plain from (values {_COND}) v(raw)",
    "f13_plain_clauses": f"with {_CLS} select rec_id, substr(md5({_plain('clause_text')}), 1, 8) as fingerprint from cls",
    "f15_condition_tokens": f"with f as (select id, unnest(required_facts) as f from held_out_queries) select id, f.fact as fact, array_to_string({_TOK.format('''concat_ws('、', f.fact, f.condition)''')}, '|') as tokens from f",
    "f17_claim_values": f"with c as (select distinct item_id, claimed from plan_writer_citation_summary_sample where claimed is not null and claimed <> '') select item_id, {_BARE.format('claimed')} as bare, round({_base('claimed')}, 6) as base from c",
    "f19_claims_in_clauses": rf"""with {_CLS}, c as (select distinct item_id, official_code, clause_ref, claimed from plan_writer_citation_summary_sample where claimed is not null and claimed <> ''),
p as (select item_id, rec_id, clause_text as t, {_BARE.format('claimed')} as bare from c join cls on standard_code = replace(replace(regexp_replace(official_code, '-\d{{4}}$', ''), '/', ''), ' ', '') and clause_no = clause_ref),
n as (select *, regexp_extract(bare, '(\d+(?:\.\d+)?)', 1) as num, trim(regexp_replace(bare, '^[\d.\s]+', '')) as unit from p)
select item_id, rec_id, contains(t, bare) or num <> '' and contains(t, num) and (unit = '' or contains(t, unit)) or coalesce(len(list_filter(regexp_extract_all(t, '\d+(?:\.\d+)?\s*(?:mm|cm|km|kN|MPa|kPa|min|kg|m|h|d|%|N|t)'), lambda v: abs({_base('v')} - {_base('bare')}) < 0.01)) > 0, false) as held from n""",
    "x19_support_judgement": f"with {_JUDGED} select id, rec_id, standard_hit, clause_hit, fact_hit, version_ok, judgment, action, missing from j",
    "x20_support_rerank": f"with {_RANKED}, {_GUARDED} select id, rec_id, original_rank, new_rank, adjusted from gd",
    "filter8_shelves": f"with {_JUDGED} select case action when 'block_forbidden' then 'blocked' when 'use_as_evidence' then 'usable' else 'review' end as shelf, count(*) as n from j group by 1",
    "x21_evaluate_at_k": f"with {_AT_K} select * from fail",
    "x22_failure_classes": f"with {_AT_K} select coalesce(failure, 'none') as failure, count(*) as n from fail group by 1",
    "w12_first_supporting_rank": f"with {_AT_K} select id, min(case when support_ok then k end) as first_rank from ev group by id",
    "a17_truth_metrics": f"""with {_AT_K}, {_GUARDED}, tp as (select id, max(case when original_rank = 1 then action end) as top_action, max(case when new_rank = 1 then action end) as guarded_action, max(case when original_rank = 1 then rec_id end) <> max(case when new_rank = 1 then rec_id end) as top_changed, bool_or(original_rank <= 3 and action = 'block_forbidden') as blocked_3 from gd group by id),
m as (select h.query_type, h.expected_outcome, coalesce(o.support_ok, false) as s1, coalesce(t.support_ok, false) as s3, coalesce(t.standard_hit, false) as st, coalesce(t.clause_hit, false) as cl, coalesce(t.fact_hit, false) as fa, coalesce(t.stale, false) as stale, coalesce(t.deleted, false) as deleted, top_action, guarded_action, top_changed, blocked_3, top_action is not null as found
 from held_out_queries h left join (select * from ev where k = 1) o on o.id = h.id left join (select * from ev where k = 3) t on t.id = h.id left join tp on tp.id = h.id)
select coalesce(query_type, 'all') as query_type, count(*) as n, round(avg(s1::int), 4) as support_1, round(avg(s3::int), 4) as support_3, round(avg((case when expected_outcome = 'support' then s3 else not s3 end)::int), 4) as decision_3, round(avg(st::int), 4) as standard_3, round(avg(cl::int), 4) as clause_3, round(avg(fa::int), 4) as fact_3, cast(0.0 as double) as forbidden_rate,
 round(avg(deleted::int), 4) as deleted_rate, round(avg(stale::int), 4) as stale_rate, round(avg((found and not s1)::int), 4) as unsupported_high, round(avg(coalesce(guarded_action = 'use_as_evidence', false)::int), 4) as simulated_support_1, round(avg((found and not coalesce(guarded_action = 'use_as_evidence', false))::int), 4) as simulated_high, round(avg(coalesce(top_changed, false)::int), 4) as top_changed,
 round(avg(coalesce(top_action = 'use_as_evidence', false)::int), 4) as evidence_use, round(avg(coalesce(top_action = 'manual_review', false)::int), 4) as manual_review, round(avg(coalesce(guarded_action = 'block_forbidden', false)::int), 4) as blocked_top, round(avg(case when found and not s1 then (top_action <> 'use_as_evidence')::int end), 4) as high_guarded, round(avg(case when stale or deleted then coalesce(blocked_3, false)::int end), 4) as spoiled_blocked, round(avg(case when st then cl::int end), 4) as clause_given_standard
from m group by rollup(query_type)""",
}
