"""Queries over logs, feedback, golden queries and streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.operators import lexical, metrics as ops
from clausemill.session import read
from clausemill.sources import files
from clausemill.streaming import logs as streams


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "search_log").dropDuplicates(["log_id"])


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries with the rank at which the log's searches for the standard found it."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "query_type", "expected_standard_code").distinct()
    found = _logs(spark, sf_dir).select(F.posexplode("c").alias("i", "code")).groupBy("code").agg((F.min("i") + 1).alias("rank"))
    return asked.join(found, asked["expected_standard_code"] == found["code"], "left").select("query_id", "query_type", "expected_standard_code", "rank")


def a12_status_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards by state, and the share of all."""
    rows = read(spark, sf_dir, "standard_status").groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    return rows.select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


def a13_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, distinct queries and searches without results."""
    return _logs(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("q"))).alias("queries"), F.count_if(F.col("results") == 0).alias("empty"), F.count_if(F.col("q").isNull()).alias("without_query"))


def k7_hot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten codes found most often."""
    codes = _logs(spark, sf_dir).select(F.explode("c").alias("code")).filter("code is not null and trim(code) <> ''")
    return codes.groupBy(F.upper(F.trim("code")).alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(10)


def a14_feedback_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by mode, by day, and by number of results."""
    logs = _logs(spark, sf_dir).select("mode", F.to_date("ts").cast("string").alias("day"), "results")
    return spark.sql("select mode, day, results, cast(grouping_id(mode, day, results) as int) as gid, count(*) as n from {logs} group by grouping sets ((mode), (day), (results))", logs=logs)


def a15_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations at the middle and at 95 per cent, and the longest."""
    return ops.picked_percentile(_logs(spark, sf_dir), "duration_ms", {"p50": 0.5, "p95": 0.95})


def a16_ir_metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics over all golden queries and by kind."""
    return ops.ranking_metrics(_golden(spark, sf_dir), "query_type", "rank")


def a18_relaxed_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rate with half credit for the other family of the same number."""
    rows = _golden(spark, sf_dir)
    numbers = rows.filter("rank is not null").select(F.regexp_extract("expected_standard_code", r"(\d+)$", 1).alias("number"), F.lit(1).alias("relaxed")).distinct()
    rows = rows.withColumn("number", F.regexp_extract("expected_standard_code", r"(\d{4,})", 1)).join(numbers, "number", "left")
    return rows.groupBy("query_type").agg(F.count("*").alias("n"), F.round(F.avg(ops.relaxed_credit(F.col("rank"), F.col("relaxed"))), 4).alias("match_rate"))


def a19_clause_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause records by type: read, failed, of some length."""
    rows = read(spark, sf_dir, "read_clause_full").dropDuplicates(["rec_id"])
    ok = F.coalesce(F.length("clause_text"), F.lit(0))
    return rows.groupBy("clause_type").agg(F.count("*").alias("n"), F.count_if(ok > 0).alias("read"), F.count_if(F.coalesce("failure_reason", F.lit("")) != "").alias("failed"), F.count_if(ok >= 20).alias("long"))


def a20_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every plan by verdict, with those that need review."""
    rows = read(spark, sf_dir, "plan_writer_citation_summary_sample").dropDuplicates(["item_id"])
    verdict = lambda v: F.count_if(F.col("audit_status") == v).alias(v)
    return rows.groupBy("plan_id").agg(F.count("*").alias("n"), verdict("pass"), verdict("warn"), verdict("fail"), F.count_if(F.size("review_reasons") > 0).alias("needs_review"), F.count_if("in_clause").alias("in_clause"))


def a31_frequent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent queries of four ideographs or more without a code, at most 120."""
    rows = _logs(spark, sf_dir).select(F.lower(F.trim("q")).alias("query")).filter("query is not null")
    counts = rows.groupBy("query").agg(F.count("*").alias("n")).filter("n >= 5").filter(F.col("query").rlike("[一-鿿]{4,}") & ~F.upper("query").rlike(r"(GB|JGJ|CJJ|CECS|DB\d{2})"))
    return counts.orderBy(F.desc("n"), "query").limit(120)


def a21_tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of codes from the last 500 searches that name a term of the tag's group."""
    logs = _logs(spark, sf_dir).orderBy(F.desc("log_id")).limit(500).filter("q is not null").select("log_id", F.lower("q").alias("q"), "c")
    tagged = lexical.contained(logs.select("log_id", "q"), "q", read(spark, sf_dir, "term_map"), "term", "term_group").select("log_id", F.col("term_group").alias("tag")).distinct()
    pairs = logs.select(F.col("log_id").alias("q"), F.explode(F.array_distinct("c")).alias("code")).filter("code is not null and trim(code) <> ''")
    return ops.tag_scores(pairs, tagged.withColumnRenamed("log_id", "q"))


def a23_tag_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three groups whose terms a golden query names most."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "query").distinct().filter("query is not null")
    hits = lexical.contained(asked, "query", read(spark, sf_dir, "term_map"), "term", "term_group")
    counts = hits.groupBy("query_id", F.col("term_group").alias("tag")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("query_id").orderBy(F.desc("n"), "tag")
    return counts.withColumn("r", F.row_number().over(best)).filter("r <= 3").select("query_id", "tag", "n")


def a24_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a golden query's required words that stand in the name expected."""
    asked = read(spark, sf_dir, "golden_queries").select("query_id", "must_include", "query").dropDuplicates(["query_id"]).filter("must_include is not null and size(must_include) > 0 and query is not null")
    return asked.select("query_id", F.round(F.size(F.filter("must_include", lambda w: F.col("query").contains(w))) / F.size("must_include"), 4).alias("share"))


def w14_change_only_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the user's one before."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return ops.changes(rows, "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type")


def j12_fullouter_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of customers' largest order between two halves of time."""
    orders = read(spark, sf_dir, "orders")
    half = lambda late: orders.filter((F.col("o_orderdate") >= "1995-07-01") == late).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("p"))
    return ops.full_diff(half(False), half(True), "o_custkey", "p")


def x38_degradation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden metrics held against a baseline."""
    row = a16_ir_metrics_rollup(spark, sf_dir).filter("query_type = 'all'")
    current = row.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("recall_1", "recall_3", "mrr", "not_found")])))
    baseline = spark.createDataFrame([("recall_1", 0.5), ("recall_3", 0.6), ("mrr", 0.9), ("not_found", 0.0)], "metric string, value double")
    return ops.degradation(current, baseline, {"recall_1": 0.02, "recall_3": 0.03, "mrr": 0.05, "not_found": 0.02})


def x32_status_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the list filled in from citations where missing, and states that differ, always reported."""
    cited = read(spark, sf_dir, "plan_writer_citation_summary_sample").filter("official_code is not null").groupBy(F.col("official_code").alias("official")).agg(F.max("version_status").alias("seen"))
    listed = read(spark, sf_dir, "standard_status").select("standard_code", F.col("official_code").alias("official"), "status", "effective_date")
    both = listed.join(cited, "official", "left")
    action = F.when(F.col("seen").isNull(), "not seen").when(F.col("status").isNull(), "fill").when(F.col("status") != F.col("seen"), "differs").otherwise("same")
    return both.select("standard_code", action.alias("action"))


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, through a stream with a watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet" if os.path.isfile(path) else "*.parquet").parquet(sf_dir if os.path.isfile(path) else path)
    return streams.run_once(streams.window_counts(source, "ts", "event_type", "1 day", "1 hour"), "windows")


def event_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from the table."""
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


def s16_zero_result_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records of searches without results, written as JSON lines and read again."""
    path = streams.folder(spark, "feedback")
    found = streams.zero_result_feedback(_logs(spark, sf_dir)).select("log_id", "type", "query")
    streams.append(found, path)
    return files.json_lines(spark, path, found.schema)


def s11_versioned_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of lengths written under a version and read again."""
    index = read(spark, sf_dir, "kb_search_index").select("section_id", F.length("heading").alias("n")).distinct()
    return spark.read.parquet(files.write_version(index, streams.folder(spark, "index"), "v1"))


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest import of each file, after a batch of later imports is put into the earlier ones."""
    rows = read(spark, sf_dir, "kb_md").select("file", "imported_at", F.length("text").alias("chars"))
    early, late = rows.filter("imported_at < timestamp_ntz '2025-03-01'"), rows.filter("imported_at >= timestamp_ntz '2025-03-01'")
    return streams.upsert(early, late, "file", "imported_at")


QUERIES = {
    f.__name__: f
    for f in (
        a12_status_coverage, a13_log_summary, k7_hot_codes, a14_feedback_grouping_sets, a15_latency_percentiles, a16_ir_metrics_rollup, a18_relaxed_match_rate, a19_clause_eval, a20_audit_summary, a31_frequent_queries, a21_tag_scores, a23_tag_inference,
        a24_term_coverage, w14_change_only_log, j12_fullouter_diff, x38_degradation_gate, x32_status_reconcile, stream_window_counts, event_window_counts, s16_zero_result_feedback, s11_versioned_index, stream_upsert,
    )
}

_L = "lg as (select log_id, any_value(ts) as ts, any_value(q) as q, any_value(c) as c, any_value(mode) as mode, any_value(results) as results, any_value(duration_ms) as duration_ms from search_log group by log_id)"
_G = f"{_L}, fnd as (select code, min(i) as rank from (select unnest(range(1, len(c) + 1)) as i, unnest(c) as code from lg) u group by code), gq as (select query_id, query_type, expected_standard_code, rank from (select distinct query_id, query_type, expected_standard_code from golden_queries) g left join fnd on expected_standard_code = code)"
_IR = f"with {_G}, m as (select coalesce(query_type, 'all') as query_type, count(*) as n, round(avg(case when rank <= 1 then 1 else 0 end), 4) as recall_1, round(avg(case when rank <= 3 then 1 else 0 end), 4) as recall_3, round(avg(case when rank <= 10 then 1 else 0 end), 4) as recall_10, round(avg(coalesce(1 / rank, 0)), 4) as mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 4) as ndcg, round(avg(case when rank is null then 1 else 0 end), 4) as not_found from gq group by rollup(query_type))"
ORACLES = {
    "a12_status_coverage": "select coalesce(status, 'unknown') as status, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from standard_status group by 1",
    "a13_log_summary": f"with {_L} select count(*) as n, count(distinct lower(trim(q))) as queries, count(*) filter (results = 0) as empty, count(*) filter (q is null) as without_query from lg",
    "k7_hot_codes": f"with {_L} select upper(trim(code)) as code, count(*) as n from (select unnest(c) as code from lg) u where code is not null and trim(code) <> '' group by 1 order by n desc, code limit 10",
    "a14_feedback_grouping_sets": f"with {_L} select mode, day, results, cast(grouping_id(mode, day, results) as int) as gid, count(*) as n from (select mode, strftime(ts, '%Y-%m-%d') as day, results from lg) u group by grouping sets ((mode), (day), (results))",
    "a15_latency_percentiles": f"with {_L}, s as (select list_sort(list(duration_ms)) as d from lg where duration_ms is not null) select cast(len(d) as bigint) as count, d[cast(floor(len(d) * 0.5) as int) + 1] as p50, d[cast(floor(len(d) * 0.95) as int) + 1] as p95, d[len(d)] as max from s",
    "a16_ir_metrics_rollup": f"{_IR} select * from m",
    "a18_relaxed_match_rate": rf"with {_G}, nm as (select distinct regexp_extract(expected_standard_code, '(\d+)$', 1) as number from gq where rank is not null) select query_type, count(*) as n, round(avg(case when rank is not null then 1 when regexp_extract(expected_standard_code, '(\d{{4,}})', 1) in (select number from nm) then 0.5 else 0 end), 4) as match_rate from gq group by 1",
    "a19_clause_eval": "with r as (select distinct on (rec_id) * from read_clause_full) select clause_type, count(*) as n, count(*) filter (coalesce(length(clause_text), 0) > 0) as read, count(*) filter (coalesce(failure_reason, '') <> '') as failed, count(*) filter (coalesce(length(clause_text), 0) >= 20) as long from r group by 1",
    "a20_audit_summary": "with r as (select distinct on (item_id) * from plan_writer_citation_summary_sample) select plan_id, count(*) as n, count(*) filter (audit_status = 'pass') as pass, count(*) filter (audit_status = 'warn') as warn, count(*) filter (audit_status = 'fail') as fail, count(*) filter (len(review_reasons) > 0) as needs_review, count(*) filter (in_clause) as in_clause from r group by 1",
    "a31_frequent_queries": rf"with {_L} select lower(trim(q)) as query, count(*) as n from lg where q is not null group by 1 having count(*) >= 5 and regexp_matches(lower(trim(q)), '[一-鿿]{{4,}}') and not regexp_matches(upper(lower(trim(q))), '(GB|JGJ|CJJ|CECS|DB\d{{2}})') order by n desc, query limit 120",
    "a21_tag_scores": f"with {_L}, lt as (select * from lg order by log_id desc limit 500), tg as (select distinct log_id, term_group as tag from lt join term_map on contains(lower(q), term)), kt as (select * from (select *, row_number() over (partition by log_id order by tag) as r from tg) u where r <= 3), dfs as (select tag, count(distinct log_id) as df from kt group by tag), nq as (select count(distinct log_id) as qs from kt), pc as (select distinct log_id, unnest(c) as code from lt where q is not null), cn as (select code, tag, count(*) as n from pc join kt using (log_id) where code is not null and trim(code) <> '' group by all), sc as (select code, tag, n, round(ln(1 + n) * ln((qs + 1) / (df + 1)), 4) as score from cn join dfs using (tag), nq), rk as (select *, row_number() over (partition by code order by score desc, tag) as r from sc) select code, tag, n, score from rk where r <= 5",
    "a23_tag_inference": "with q as (select distinct query_id, query from golden_queries where query is not null), c as (select query_id, term_group as tag, count(*) as n from q join term_map on contains(query, term) group by all), r as (select *, row_number() over (partition by query_id order by n desc, tag) as r from c) select query_id, tag, n from r where r <= 3",
    "a24_term_coverage": "with q as (select distinct query_id, query, must_include as m from golden_queries where len(must_include) > 0 and query is not null) select query_id, round(len(list_filter(m, lambda w: contains(query, w))) / len(m), 4) as share from q",
    "w14_change_only_log": "with r as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b, row_number() over (partition by user_id order by ts, event_id) as r from events) select event_id, event_type from r where r = 1 or event_type is distinct from b",
    "j12_fullouter_diff": "with a as (select o_custkey, max(o_orderpriority) as p from orders where o_orderdate < '1995-07-01' group by 1), b as (select o_custkey, max(o_orderpriority) as p from orders where o_orderdate >= '1995-07-01' group by 1), d as (select coalesce(a.o_custkey, b.o_custkey) as o_custkey, case when a.o_custkey is null then 'added' when b.o_custkey is null then 'removed' when a.p is distinct from b.p then 'changed' end as change from a full join b on a.o_custkey = b.o_custkey) select * from d where change is not null",
    "x38_degradation_gate": f"{_IR}, c as (select unnest(['recall_1', 'recall_3', 'mrr', 'not_found']) as metric, unnest([recall_1, recall_3, mrr, not_found]) as value from m where query_type = 'all'), b as (select * from (values ('recall_1', 0.5, 0.02), ('recall_3', 0.6, 0.03), ('mrr', 0.9, 0.05), ('not_found', 0.0, 0.02)) v(metric, base, lim)) select metric, value, cast(base as double) as base, base - value > lim as degraded from c join b using (metric)",
    "x32_status_reconcile": "with c as (select official_code, max(version_status) as seen from plan_writer_citation_summary_sample where official_code is not null group by 1) select standard_code, case when seen is null then 'not seen' when status is null then 'fill' when status <> seen then 'differs' else 'same' end as action from standard_status s left join c on s.official_code = c.official_code",
    "stream_window_counts": "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2",
    "event_window_counts": "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2",
    "s16_zero_result_feedback": f"with {_L} select log_id, 'zero_result' as type, trim(q) as query from lg where results = 0 and q is not null",
    "s11_versioned_index": "select distinct section_id, length(heading) as n from kb_search_index",
    "stream_upsert": "select file, max(imported_at) as imported_at, any_value(length(text)) as chars from kb_md group by file",
}
