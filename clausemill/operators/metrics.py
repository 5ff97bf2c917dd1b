"""Retrieval quality, logs and feedback as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clausemill.session import materialise


def picked_percentile(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Values at fixed places of the sorted column, n times the share rounded down, without interpolation.

    Counts of equal values are range-partitioned; every partition is sorted by itself and shifted by the sum of those
    before it, one row a partition.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ranged = materialise(counts.repartitionByRange(value).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(Window.orderBy("part")) - F.col("held")  # one row a partition
    shifts = parts.select("part", before.alias("shift"))
    upto = F.col("shift") + F.sum("n").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = parts.agg(F.sum("held").alias("total"))
    placed = ranged.join(F.broadcast(shifts), "part").withColumn("upto", upto).crossJoin(F.broadcast(total))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col(value))).alias(name) for name, share in shares.items()]
    return placed.agg(F.max("total").alias("count"), *picks, F.max(value).alias("max"))


def ranking_metrics(rows: DataFrame, by: str, rank: str) -> DataFrame:
    """Recall at 1, 3 and 10, MRR and nDCG of the rank of the expected result, over all and by kind; null is not found."""
    r = F.col(rank)
    at = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}")
    out = rows.rollup(by).agg(
        F.count("*").alias("n"), at(1), at(3), at(10), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 4).alias("mrr"),
        F.round(F.avg(F.coalesce(1 / F.log2(r + 1), F.lit(0.0))), 4).alias("ndcg"), F.round(F.avg(r.isNull().cast("int")), 4).alias("not_found"),
    )
    return out.withColumn(by, F.coalesce(by, F.lit("all")))


def relaxed_credit(rank: Column, relaxed_rank: Column) -> Column:
    """One for a hit, a half for a relaxed one."""
    return F.when(rank.isNotNull(), 1.0).when(relaxed_rank.isNotNull(), 0.5).otherwise(0.0)


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before them under the same key; the first of each key is a change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumn("_c", first | ~F.col(value).eqNullSafe(before)).filter("_c").drop("_c")


def degradation(current: DataFrame, baseline: DataFrame, allowed: dict[str, float]) -> DataFrame:
    """Metrics (metric, value) that fell below a baseline by more than what is allowed."""
    limit = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.lit(v))])
    both = current.join(baseline.withColumnRenamed("value", "base"), "metric", "left")
    drop = F.coalesce(F.col("base") - F.col("value"), F.lit(0.0))
    return both.select("metric", "value", "base", (drop > F.coalesce(F.try_element_at(limit, F.col("metric")), F.lit(0.0))).alias("degraded"))


def full_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with what became of them: added, removed, changed; equal ones are left out."""
    both = old.select(key, F.col(value).alias("a"), F.lit(True).alias("o")).join(new.select(key, F.col(value).alias("b"), F.lit(True).alias("n")), key, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def tag_scores(pairs: DataFrame, tags_of: DataFrame, per_query: int = 3, per_code: int = 5) -> DataFrame:
    """Tags of codes by how often they are found with queries that carry the tag.

    pairs: (q, code), tags_of: (q, tag). The score is the count's logarithm times the tag's rarity; each query counts with
    its first per_query tags, each code keeps its best per_code.
    """
    order = Window.partitionBy("q").orderBy("tag")
    known = tags_of.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_query).select("q", "tag")
    n = known.agg(F.countDistinct("q").alias("queries"))
    df = known.groupBy("tag").agg(F.countDistinct("q").alias("df"))
    counts = pairs.join(known, "q").groupBy("code", "tag").agg(F.count("*").alias("n"))
    scored = counts.join(F.broadcast(df), "tag").crossJoin(F.broadcast(n))
    score = F.round(F.log1p("n") * F.log((F.col("queries") + 1) / (F.col("df") + 1)), 4)
    best = Window.partitionBy("code").orderBy(F.desc("score"), "tag")
    return scored.withColumn("score", score).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_code).select("code", "tag", "n", "score")
