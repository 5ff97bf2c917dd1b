"""Vectors: similarity, exact top-k search in blocks, boosts and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block: a pair of blocks is multiplied in one task, in about 64 MB for 1024 dimensions.
BLOCK = 2048
#: Rows of a block whose pairs leave a task at once.
STRIP = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_similar(rows: DataFrame, query: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """The k rows nearest to one query vector, a frame of one row: vec_id and sim."""
    one = query.select(F.col("embedding").alias("_q")).limit(1)
    scored = rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot(F.col("embedding"), F.col("_q")), 4).alias("sim"))
    return scored.filter(F.col("sim") >= least).orderBy(F.desc("sim"), "vec_id").limit(k)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    packed = F.collect_list(F.struct("vec_id", "embedding")).alias(name)
    return rows.filter("vec_id is not null and embedding is not null").groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias(f"{name}_block")).agg(packed)


def nearest(queries: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """The k nearest rows of every query vector, exact: vec_id, neighbour, sim.

    A stated set of queries meets all rows in blocks: each pair of blocks is one matrix product, and only its best k of
    each query are shuffled. Rows without vector are left out, a row isn't its own neighbour.
    """

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, r in zip(batch["q"], batch["r"]):
                qi, ri = np.array([x["vec_id"] for x in q]), np.array([x["vec_id"] for x in r])
                sims = np.stack([x["embedding"] for x in q]).astype(float) @ np.stack([x["embedding"] for x in r]).astype(float).T
                sims[qi[:, None] == ri[None, :]] = -np.inf
                sims = np.round(sims, 4)
                last = np.partition(sims, max(0, len(ri) - k), axis=1)[:, [max(0, len(ri) - k)]]  # the k-th best; ties go along
                i, j = np.nonzero((sims >= last) & (sims >= least))
                yield pd.DataFrame({"vec_id": qi[i], "neighbour": ri[j], "sim": sims[i, j]})

    pairs = _blocks(queries, "q").select("q").crossJoin(_blocks(rows, "r").select("r"))
    found = pairs.mapInPandas(multiply, "vec_id bigint, neighbour bigint, sim double")
    best = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "neighbour")
    return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")


def close_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Every pair of rows as close as `least`, exact, once: src < dst, and cos.

    All rows meet all in blocks, each two blocks once; only the pairs that are close leave a task. A repeated vec_id
    counts once, rows without vector are left out.
    """

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, q, r in zip(batch["same"], batch["q"], batch["r"]):
                ri, rv = np.array([x["vec_id"] for x in r]), np.stack([x["embedding"] for x in r]).astype(float)
                for at in range(0, len(q), STRIP):
                    strip = q[at : at + STRIP]
                    qi = np.array([x["vec_id"] for x in strip])
                    sims = np.round(np.stack([x["embedding"] for x in strip]).astype(float) @ rv.T, 4)
                    i, j = np.nonzero((sims >= least) & ((qi[:, None] < ri[None, :]) if same else True))
                    yield pd.DataFrame({"src": np.minimum(qi[i], ri[j]), "dst": np.maximum(qi[i], ri[j]), "cos": sims[i, j]})

    once = rows.dropDuplicates(["vec_id"])
    pairs = _blocks(once, "q").crossJoin(_blocks(once, "r")).filter("q_block <= r_block")
    return pairs.select((F.col("q_block") == F.col("r_block")).alias("same"), "q", "r").mapInPandas(multiply, "src bigint, dst bigint, cos double")


def centroids(rows: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group, by dimension."""
    return rows.select(group, F.posexplode("embedding").alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def rewritten(rows: DataFrame, group: str, head: int) -> DataFrame:
    """The head of each ranked list in order of similarity, with scores scaled by it; the tail as it is.

    rows: group, id, score, sim. The best similarity of the head keeps its score.
    """
    by_score = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    ranked = rows.withColumn("rank", F.row_number().over(by_score)).withColumn("in_head", F.col("rank") <= head)
    best = F.max("sim").over(Window.partitionBy(group, "in_head"))
    score = F.when(F.col("in_head") & (best > 0), F.col("score") * F.col("sim") / best).otherwise(F.col("score"))
    order = Window.partitionBy(group).orderBy(F.desc("in_head"), F.desc(F.when(F.col("in_head"), F.col("sim"))), "rank")
    return ranked.withColumn("new_score", score).withColumn("new_rank", F.row_number().over(order)).select(group, "id", "rank", "new_rank", "new_score")
