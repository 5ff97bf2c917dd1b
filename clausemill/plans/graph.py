"""Queries over the term-file graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.operators import graph as ops, lexical
from clausemill.session import materialise, read, read_wide

SEEDS = {"剪力墙": 0.5, "模板支架": 0.3, "脚手架": 0.1, "土钉墙": 0.1}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wide(spark, sf_dir, "kb_md").select("file", "text").dropDuplicates(["file"])


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "term_map").select("term")


def _heading_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "kb_search_index").select("section_id", "file", "heading").distinct().filter("heading is not null")
    return lexical.contained(rows, "heading", _terms(spark, sf_dir), "term")


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical.contained(_files(spark, sf_dir), "text", _terms(spark, sf_dir), "term")
    tf = (F.length("text") - F.length(F.replace("text", F.col("term"), F.lit("")))) / F.length("term")
    return hits.select("file", "term", tf.cast("bigint").alias("tf"))


def d6d_heading_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in headings."""
    counts = _heading_hits(spark, sf_dir).groupBy("term", "file").agg(F.count("*").alias("n"))
    return ops.heading_edges(counts)


def d6e_term_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in files."""
    n = _files(spark, sf_dir).agg(F.count("*").alias("n_files"))
    counts = materialise(_frequencies(spark, sf_dir)).crossJoin(F.broadcast(n))
    return ops.term_edges(counts, F.col("n_files")).withColumn("w", F.round("w", 6))


def _scores(headings: DataFrame, frequencies: DataFrame, n: DataFrame) -> DataFrame:
    sections = headings.groupBy("file", "term").agg(F.count("*").alias("held"))
    df = frequencies.groupBy("term").agg(F.count("*").alias("df"))
    rows = frequencies.join(sections, ["file", "term"], "left").join(df, "term").crossJoin(F.broadcast(n))
    return rows.select("term", "file", F.round(F.col("tf") / F.coalesce("held", F.lit(1)) * F.log(F.col("n_files") / F.col("df")), 6).alias("score"))


def a10_file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean frequency of a term in the sections of a file that hold it, times its idf."""
    return _scores(_heading_hits(spark, sf_dir), materialise(_frequencies(spark, sf_dir)), _files(spark, sf_dir).agg(F.count("*").alias("n_files")))


def d6f_bm25_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as edges."""
    return ops.bm25_edges(a10_file_scores(spark, sf_dir), d6e_term_edges(spark, sf_dir), d6d_heading_edges(spark, sf_dir)).withColumn("w", F.round("w", 6))


def d6a_cooc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in the same heading."""
    return ops.cooccurrence_edges(lexical.cooccurrence(_heading_hits(spark, sf_dir), "section_id", "term"))


def followers(spark: SparkSession, sf_dir: str, most: int = lexical.BIGRAMS) -> DataFrame:
    """Terms that follow each other in queries: w1, w2, prob of the most frequent followers."""
    logs = read(spark, sf_dir, "search_log").select("log_id", "q").distinct().filter("q is not null")
    words = F.filter(F.split(F.lower("q"), r"[\s　]+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(0), F.size("ws") - 2), lambda i: F.struct(F.get("ws", i).alias("w1"), F.get("ws", i + 1).alias("w2")))
    counts = logs.select(words.alias("ws")).filter(F.size("ws") >= 2).select(F.inline(pairs)).groupBy("w1", "w2").agg(F.count("*").alias("freq"))
    terms = _terms(spark, sf_dir)
    counts = counts.join(terms.withColumnRenamed("term", "w1"), "w1", "left_semi").join(terms.withColumnRenamed("term", "w2"), "w2", "left_semi")
    return lexical.top_followers(counts, most)


def d6b_bigram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that follow each other in queries."""
    return ops.bigram_edges(followers(spark, sf_dir)).withColumn("w", F.round("w", 8))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families, from term counts that are made once: they are small, the texts aren't."""
    headings, frequencies = materialise(_heading_hits(spark, sf_dir).drop("heading")), materialise(_frequencies(spark, sf_dir))
    n = _files(spark, sf_dir).agg(F.count("*").alias("n_files"))
    heading = ops.heading_edges(headings.groupBy("term", "file").agg(F.count("*").alias("n")))
    term = ops.term_edges(frequencies.crossJoin(F.broadcast(n)), F.col("n_files")).withColumn("w", F.round("w", 6))
    body = ops.bm25_edges(_scores(headings, frequencies, n), term, heading).withColumn("w", F.round("w", 6))
    cooc = ops.cooccurrence_edges(lexical.cooccurrence(headings, "section_id", "term"))
    return cooc.unionByName(d6b_bigram_edges(spark, sf_dir)).unionByName(heading).unionByName(term).unionByName(body)


def d6_edge_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by family."""
    return _edges(spark, sf_dir).groupBy("etype").agg(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("weight"))


def w10_edges_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged graph with whole-number weights."""
    return ops.normalised(_edges(spark, sf_dir), F.col("dst").endswith(".md"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(w10_edges_normalized(spark, sf_dir))


def a27_graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and ratios of the graph."""
    return ops.health(w10_edges_normalized(spark, sf_dir), _terms(spark, sf_dir).withColumnRenamed("term", "node"))


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEEDS.items()), "node string, e double")


def d11_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds from fixed seeds."""
    edges = _graph(spark, sf_dir)
    p = ops.propagate(ops.inject(_seeds(spark), edges), ops.matrix(edges))
    return p.select("node", F.round("p", 6).alias("p"))


def d12_ppr_reinforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propagation with one round of feedback from the best files."""
    edges = _graph(spark, sf_dir)
    titles = read(spark, sf_dir, "kb_md").select("file").distinct()
    named = lexical.contained(titles, "file", _terms(spark, sf_dir), "term").select("file", "term")
    p = ops.reinforced(ops.inject(_seeds(spark), edges), ops.matrix(edges), named)
    return p.select("node", F.round("p", 6).alias("p"))


def d13_discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files the walk reached."""
    edges = _graph(spark, sf_dir)
    p = ops.propagate(ops.inject(_seeds(spark), edges), ops.matrix(edges))
    files = edges.filter("to_file").select(F.col("dst").alias("node")).distinct()
    return ops.discovered(p.withColumn("p", F.round("p", 10)), files).select("file", F.round("score", 0).alias("score"))


def graph_supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same normalisation over suppliers and parts of order lines, both ways, by supplier."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.col("l_quantity").alias("w"))
    pairs = lines.groupBy("s", "p").agg(F.sum("w").alias("w"))
    edges = pairs.select(F.col("s").alias("src"), F.col("p").alias("dst"), "w").unionByName(pairs.select(F.col("p").alias("src"), F.col("s").alias("dst"), "w"))
    return ops.normalised(edges, F.col("dst").startswith("p")).groupBy("src").agg(F.count("*").alias("n"), F.sum("w_int").alias("w"))


QUERIES = {
    f.__name__: f
    for f in (
        d6a_cooc_edges, d6b_bigram_edges, d6d_heading_edges, d6e_term_edges, d6f_bm25_edges, a10_file_scores, d6_edge_families, w10_edges_normalized, a27_graph_health, d11_ppr, d12_ppr_reinforced, d13_discovered_files, graph_supplier_part,
    )
}

_BASE = """files as (select file, any_value(text) as body from kb_md group by file), nf as (select count(*) as n_files from files), terms as (select distinct term from term_map),
hh as (select i.section_id, i.file, m.term from (select distinct section_id, file, heading from kb_search_index where heading is not null) i join terms m on contains(i.heading, m.term)),
tf as (select f.file, m.term, cast((length(body) - length(replace(body, m.term, ''))) // length(m.term) as bigint) as tf from files f join terms m on contains(f.body, m.term)),
heading as (select term as src, file as dst, least(count(*), 10) * 50.0 as w, 'heading' as etype from hh group by 1, 2),
term as (select term as src, file as dst, round(case when tf > 0 then tf * ln(n_files / count(*) over (partition by term)) * 3.0 else ln(n_files / count(*) over (partition by term)) * 0.3 end, 6) as w, 'term' as etype from tf, nf),
fs as (select tf.term, tf.file, round(tf / coalesce(held, 1) * ln(n_files / count(*) over (partition by tf.term)), 6) as score from tf left join (select file, term, count(*) as held from hh group by all) h on tf.file = h.file and tf.term = h.term, nf),
bm25 as (select term as src, file as dst, round(greatest(score * case when term in (select src from term) then 0.3 else 1 end * case when term in (select src from heading) then 0.5 else 1 end, 0.001), 6) as w, 'bm25' as etype from fs),
cc as (select a.term, b.term as partner, count(*) as n from hh a join hh b on a.section_id = b.section_id and a.term <> b.term group by 1, 2),
cp as (select term, partner, round(n / sum(n) over (partition by term), 4) as prob, row_number() over (partition by term order by n desc, partner) as r from cc),
c1 as (select term as src, partner as dst, prob as w from cp where r <= 15 and prob > 0), cooc as (select *, 'cooc' as etype from c1 union all select dst, src, w, 'cooc' from c1),
qw as (select list_filter(regexp_split_to_array(lower(q), '[\\s　]+'), lambda w: w <> '') as ws from (select distinct log_id, q from search_log where q is not null) u),
qp as (select ws[i] as w1, ws[i + 1] as w2 from (select ws, unnest(range(1, len(ws))) as i from qw) u),
qb as (select w1, w2, count(*) as freq from qp where w1 in (select term from terms) and w2 in (select term from terms) group by 1, 2), qr as (select *, row_number() over (partition by w1 order by freq desc, w2) as r from qb),
bigram as (select w1 as src, w2 as dst, round(round(freq / sum(freq) over (partition by w1), 6) * 0.02, 8) as w, 'bigram' as etype from qr where r <= 10),
edges as (select * from cooc union all by name select * from bigram union all by name select * from heading union all by name select * from term union all by name select * from bm25),
merged as (select src, dst, dst like '%.md' as to_file, sum(w) as w from edges group by src, dst), shared as (select *, sum(w) over (partition by src, to_file) as total from merged),
scaled as (select src, dst, to_file, w / total * case when to_file then 2.0 / 3 else 1.0 / 3 end as w from shared where total > 0),
g as (select src, dst, to_file, greatest(1, cast(floor(round(w / sum(w) over (partition by src) * 10000, 6)) as int)) as w_int from scaled)""".replace("\\\\s", "\\s")


def _walk(e: str, name: str, rounds: int = 5) -> str:
    """CTEs of the propagation from e: the last is name."""
    steps = [f"{name}0 as (select node, e as p from {e})"]
    for k in range(rounds):
        steps.append(f"{name}{k + 1} as (select node, sum(p) as p from (select dst as node, p * m * 0.15 as p from mx join {name}{k} on src = node union all select node, e * 0.85 from {e}) u group by node)")
    return ", ".join(steps)


_SEED = ", ".join(f"('{t}', {w})" for t, w in SEEDS.items())
_PPR = f"""{_BASE}, mx as (select src, dst, to_file, w_int / 10000 * case when to_file then 2.0 else 1.0 end as m from g), seeds as (select * from (values {_SEED}) v(node, e)),
near as (select dst as node, sum(e * 0.001) as e from g join seeds on src = node where to_file group by dst), every as (select node, cast(e as double) as e from seeds union all select node, e from near where node not in (select node from seeds)),
e0 as (select node, e / sum(e) over () as e from every), {_walk('e0', 'p')}"""
ORACLES = {
    "d6a_cooc_edges": f"with {_BASE} select src, dst, w, etype from cooc",
    "d6b_bigram_edges": f"with {_BASE} select src, dst, w, etype from bigram",
    "d6d_heading_edges": f"with {_BASE} select src, dst, w, etype from heading",
    "d6e_term_edges": f"with {_BASE} select src, dst, w, etype from term",
    "d6f_bm25_edges": f"with {_BASE} select src, dst, w, etype from bm25",
    "a10_file_scores": f"with {_BASE} select term, file, score from fs",
    "d6_edge_families": f"with {_BASE} select etype, count(*) as n, round(sum(w), 2) as weight from edges group by etype",
    "w10_edges_normalized": f"with {_BASE} select * from g",
    "a27_graph_health": f"with {_BASE}, d as (select term, coalesce(d, 0) as d, coalesce(f, 0) as f from (select term from term_map) t left join (select src, count(*) as d, count(*) filter (to_file) as f from g group by src) x on src = term) select count(*) as nodes, round(avg(case when d = 0 then 1 else 0 end), 6) as isolated, round(sum(f) / nullif(sum(d - f), 0), 6) as file_ratio, round(avg(d), 4) as avg_degree, quantile_cont(d, 0.5) as median_degree, max(d) as max_degree from d",
    "d11_ppr": f"with {_PPR} select node, round(p, 6) as p from p5",
    "d12_ppr_reinforced": f"""with {_PPR}, best as (select node from p5 where node like '%.md' order by round(p, 12) desc, node limit 5), gain as (select term, count(*) as times from best join terms on contains(node, term) group by term),
b0 as (select node, least(e * power(1.5, coalesce(times, 0)), 3.0) as e from e0 left join gain on node = term), e1 as (select node, e / sum(e) over () as e from b0), {_walk('e1', 'q')} select node, round(p, 6) as p from q5""",
    "d13_discovered_files": f"with {_PPR} select node as file, round(round(round(p, 10) * 1e5, 1), 0) as score from p5 where node like '%.md' and round(p, 10) > 1e-5",
    "graph_supplier_part": """with pairs as (select 's' || l_suppkey as s, 'p' || l_partkey as p, sum(l_quantity) as w from lineitem group by all), merged as (select s as src, p as dst, w from pairs union all select p, s, w from pairs),
scaled as (select src, dst, w / sum(w) over (partition by src, dst like 'p%') * case when dst like 'p%' then 2.0 / 3 else 1.0 / 3 end as w from merged), g as (select src, greatest(1, cast(floor(round(w / sum(w) over (partition by src) * 10000, 6)) as int)) as w_int from scaled)
select src, count(*) as n, cast(sum(w_int) as bigint) as w from g group by src""",
}
