"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clausemill.operators import graph, vectors as ops
from clausemill.session import read


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).filter("vec_id = 1")


def v1_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to one."""
    return ops.top_similar(_rows(spark, sf_dir), _query(spark, sf_dir), 10)


def v4_best_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of every group."""
    one = _query(spark, sf_dir).select(F.col("embedding").alias("q"))
    sims = _rows(spark, sf_dir).crossJoin(F.broadcast(one)).select("label", "vec_id", F.round(ops.dot(F.col("embedding"), F.col("q")), 4).alias("sim"))
    return sims.groupBy("label").agg(F.min_by(F.struct("vec_id", "sim"), F.struct(-F.col("sim"), "vec_id")).alias("b")).select("label", "b.vec_id", "b.sim")


def v2_group_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best similarity of each group, where it is close."""
    return v4_best_in_group(spark, sf_dir).filter("sim >= 0.1").select("label", F.col("sim").alias("best_sim"))


def v3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, against all."""
    rows = _rows(spark, sf_dir)
    return ops.nearest(rows.filter("vec_id % 20 = 0"), rows, 5, 0.1)


def d6c_semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest pairs of the same queries only, twenty of each; d6c_semantic_edges has them all."""
    rows = _rows(spark, sf_dir)
    near = ops.nearest(rows.filter("vec_id % 20 = 0"), rows, 20, 0.2)
    return near.select(F.col("vec_id").alias("src"), F.col("neighbour").alias("dst"), F.round(F.col("sim") * 0.06, 6).alias("w"))


def d6c_semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs close enough to be edges, both ways: every vector against every other."""
    return graph.semantic_edges(ops.close_pairs(_rows(spark, sf_dir), 0.2), 0.2).withColumn("w", F.round("w", 6))


def a29_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of the groups."""
    return ops.centroids(_rows(spark, sf_dir), "label").select("label", "dim", F.round("mean", 5).alias("mean"))


def a29_unit_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors scaled to length one."""
    mean = ops.centroids(_rows(spark, sf_dir), "label")
    norm = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(Window.partitionBy("label")))
    return mean.select("label", "dim", F.round(F.when(norm > 0, F.col("mean") / norm).otherwise(0.0), 5).alias("x"))


def x6_clause_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each group ranked by a score, their heads reranked by similarity."""
    one = _query(spark, sf_dir).select(F.col("embedding").alias("q"))
    sims = _rows(spark, sf_dir).crossJoin(F.broadcast(one)).select("label", F.col("vec_id").alias("id"), (F.col("vec_id") % 97).cast("double").alias("score"), F.round(ops.dot(F.col("embedding"), F.col("q")), 4).alias("sim"))
    return ops.rewritten(sims, "label", 15).withColumn("new_score", F.round("new_score", 4))


def x5_clause_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vector of each group above a floor, even ids before odd ones."""
    one = _query(spark, sf_dir).select(F.col("embedding").alias("q"))
    sims = _rows(spark, sf_dir).crossJoin(F.broadcast(one)).select("label", "vec_id", F.round(ops.dot(F.col("embedding"), F.col("q")), 4).alias("sim")).filter("sim >= 0.05")
    best = Window.partitionBy("label").orderBy(F.col("vec_id") % 2, F.desc("sim"), "vec_id")
    return sims.withColumn("r", F.row_number().over(best)).filter("r = 1").select("label", "vec_id", "sim")


QUERIES = {f.__name__: f for f in (v1_cosine_topk, v4_best_in_group, v2_group_boosts, v3_nearest_neighbours, d6c_semantic_pairs, d6c_semantic_edges, a29_centroids, a29_unit_centroids, x6_clause_rerank, x5_clause_refine)}

_E = "e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), q as (select v as q from e where vec_id = 1), s as (select vec_id, label, round(list_dot_product(v, q), 4) as sim from e, q)"
_NEAR = "e as (select vec_id, cast(embedding as double[]) as v from embeddings), p as (select a.vec_id, b.vec_id as neighbour, round(list_dot_product(a.v, b.v), 4) as sim from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by vec_id order by sim desc, neighbour) as r from p)"
ORACLES = {
    "v1_cosine_topk": f"with {_E} select vec_id, sim from s order by sim desc, vec_id limit 10",
    "v4_best_in_group": f"with {_E}, r as (select *, row_number() over (partition by label order by sim desc, vec_id) as r from s) select label, vec_id, sim from r where r = 1",
    "v2_group_boosts": f"with {_E} select label, max(sim) as best_sim from s group by label having max(sim) >= 0.1",
    "v3_nearest_neighbours": f"with {_NEAR} select vec_id, neighbour, sim from r where r <= 5 and sim >= 0.1",
    "d6c_semantic_pairs": f"with {_NEAR} select vec_id as src, neighbour as dst, round(sim * 0.06, 6) as w from r where r <= 20 and sim >= 0.2",
    "d6c_semantic_edges": "with e as (select vec_id, cast(any_value(embedding) as double[]) as v from embeddings where vec_id is not null and embedding is not null group by vec_id), p as (select a.vec_id as src, b.vec_id as dst, round(list_dot_product(a.v, b.v), 4) as cos from e a join e b on a.vec_id <> b.vec_id) select src, dst, round(cos * 0.06, 6) as w, 'semantic' as etype from p where cos >= 0.2",
    "a29_centroids": "with e as (select label, unnest(range(0, len(embedding))) as dim, unnest(cast(embedding as double[])) as x from embeddings) select label, dim, round(avg(x), 5) as mean from e group by label, dim",
    "a29_unit_centroids": "with e as (select label, unnest(range(0, len(embedding))) as dim, unnest(cast(embedding as double[])) as x from embeddings), m as (select label, dim, avg(x) as m from e group by label, dim) select label, dim, round(m / sqrt(sum(m * m) over (partition by label)), 5) as x from m",
    "x6_clause_rerank": f"with {_E}, r as (select label, vec_id as id, cast(vec_id % 97 as double) as score, sim from s), k as (select *, row_number() over (partition by label order by score desc, id) as rank from r), h as (select *, rank <= 15 as hd from k), b as (select *, max(sim) over (partition by label, hd) as best from h) select label, id, rank, row_number() over (partition by label order by hd desc, case when hd then sim end desc nulls last, rank) as new_rank, round(case when hd and best > 0 then score * sim / best else score end, 4) as new_score from b",
    "x5_clause_refine": f"with {_E}, r as (select *, row_number() over (partition by label order by vec_id % 2, sim desc, vec_id) as r from s where sim >= 0.05) select label, vec_id, sim from r where r = 1",
}
