"""Term-file graph: edge families, normalisation, and personalised PageRank by joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clausemill.session import materialise

# Fixed values of the edge families and the propagation.
COOC, BIGRAM, SEMANTIC, SEMANTIC_FLOOR, HEADING, TERM, TERM_FLOOR, BM25, BM25_LEAST = 1.0, 0.02, 0.06, 0.70, 50.0, 3.0, 0.1, 1.0, 0.001
FILE_RATIO, UNITS, FILE_GAIN, RESTART, ROUNDS, INJECTED = 2.0, 10_000, 2.0, 0.85, 5, 0.001
FEEDBACK_FILES, FEEDBACK_GAIN, FEEDBACK_MOST, VISIBLE, SHOWN = 5, 1.5, 3.0, 1e-5, 1e5


def both_ways(pairs: DataFrame, etype: str) -> DataFrame:
    """(src, dst, w) as edges in both directions."""
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return pairs.select("src", "dst", "w").unionByName(back).withColumn("etype", F.lit(etype))


def cooccurrence_edges(cooc: DataFrame) -> DataFrame:
    """(term, partner, prob) -> edges weighted by probability."""
    return both_ways(cooc.filter("prob > 0").select(F.col("term").alias("src"), F.col("partner").alias("dst"), (F.col("prob") * COOC).alias("w")), "cooc")


def bigram_edges(top: DataFrame) -> DataFrame:
    """(w1, w2, prob), the top followers -> weak edges."""
    return top.select(F.col("w1").alias("src"), F.col("w2").alias("dst"), (F.col("prob") * BIGRAM).alias("w"), F.lit("bigram").alias("etype"))


def semantic_edges(similar: DataFrame, floor: float = SEMANTIC_FLOOR) -> DataFrame:
    """(src, dst, cos), each pair once -> weak edges where the vectors are close."""
    return both_ways(similar.filter(F.col("cos") >= floor).select("src", "dst", (F.col("cos") * SEMANTIC).alias("w")), "semantic")


def heading_edges(counts: DataFrame) -> DataFrame:
    """(term, file, n) in headings -> the strongest edges."""
    return counts.select(F.col("term").alias("src"), F.col("file").alias("dst"), (F.least("n", F.lit(10)) * HEADING).alias("w"), F.lit("heading").alias("etype"))


def term_edges(counts: DataFrame, n_files: Column) -> DataFrame:
    """(term, file, tf), with the number of files -> edges by frequency and idf; a term's files are counted before they meet."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(n_files / F.col("df"))
    w = F.when(F.col("tf") > 0, F.col("tf") * idf * TERM).otherwise(idf * TERM * TERM_FLOOR)
    return counts.join(df, "term").select(F.col("term").alias("src"), F.col("file").alias("dst"), w.alias("w"), F.lit("term").alias("etype"))


def bm25_edges(scores: DataFrame, has_term: DataFrame, has_heading: DataFrame) -> DataFrame:
    """(term, file, score) -> edges, weaker for terms that have term or heading edges already."""
    flags = scores.join(has_term.select(F.col("src").alias("term"), F.lit(True).alias("t")).distinct(), "term", "left").join(has_heading.select(F.col("src").alias("term"), F.lit(True).alias("h")).distinct(), "term", "left")
    w = F.col("score") * BM25 * F.when(F.col("t"), 0.3).otherwise(1.0) * F.when(F.col("h"), 0.5).otherwise(1.0)
    return flags.select(F.col("term").alias("src"), F.col("file").alias("dst"), F.greatest(w, F.lit(BM25_LEAST)).alias("w"), F.lit("bm25").alias("etype"))


def normalised(edges: DataFrame, is_file: Column) -> DataFrame:
    """Merged edges with whole-number weights: two thirds of a source's weight go to files and one to terms."""
    merged = edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).withColumn("to_file", is_file)
    share = F.when(F.col("to_file"), FILE_RATIO / (FILE_RATIO + 1)).otherwise(1 / (FILE_RATIO + 1))
    # at most two rows a source: what it has for files and for terms; a hub's edges are never brought together
    parts = merged.groupBy("src", "to_file").agg(F.sum("w").alias("total")).filter("total > 0").withColumn("share", share)
    parts = parts.join(parts.groupBy("src").agg(F.sum("share").alias("shares")), "src")
    merged = merged.join(parts, ["src", "to_file"])
    whole = F.col("w") / F.col("total") * F.col("share") / F.col("shares")
    # rounding before the floor keeps the result independent of the order of summation
    return merged.select("src", "dst", "to_file", F.greatest(F.lit(1), F.floor(F.round(whole * UNITS, 6))).cast("int").alias("w_int"))


def matrix(edges: DataFrame) -> DataFrame:
    """(src, dst, to_file, w_int) -> transition weights; those to files count double and rows aren't made stochastic again."""
    return edges.select("src", "dst", "to_file", (F.col("w_int") / UNITS * F.when(F.col("to_file"), FILE_GAIN).otherwise(1.0)).alias("m"))


def inject(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds with a trace of each one's weight put on the files next to it, made to sum to one."""
    near = edges.filter("to_file").join(seeds.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("e") * INJECTED).alias("e"))
    every = seeds.unionByName(near.join(seeds, "node", "left_anti"))
    total = every.agg(F.sum("e").alias("total"))
    return every.crossJoin(F.broadcast(total)).filter("total > 0").select("node", (F.col("e") / F.col("total")).alias("e"))


def propagate(seeds: DataFrame, transitions: DataFrame, rounds: int = ROUNDS, restart: float = RESTART) -> DataFrame:
    """Personalised PageRank: p = restart e + (1 - restart) p M, a fixed number of rounds.

    The restart share is the large one. Each round is one equi-join and one aggregation with partial sums; a hot node's
    edges are split by AQE's skew join. Lineage is cut every second round by a reliable checkpoint.
    """
    start = seeds.select("node", "e")
    p = start.withColumnRenamed("e", "p")
    for k in range(rounds):
        moved = transitions.join(p.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("p") * F.col("m") * (1 - restart)).alias("p"))
        p = moved.unionByName(start.select("node", (F.col("e") * restart).alias("p"))).groupBy("node").agg(F.sum("p").alias("p"))
        if k % 2 and k < rounds - 1:
            p = materialise(p)
    return p


def reinforced(seeds: DataFrame, transitions: DataFrame, name_terms: DataFrame) -> DataFrame:
    """One round of feedback: seeds that name the best files weigh half as much again, then everything is propagated anew.

    name_terms: (file, term), the terms in each file's name; a seed named by several of the files gains for each.
    """
    p = propagate(seeds, transitions)
    files = transitions.filter("to_file").select(F.col("dst").alias("node")).distinct()
    best = p.join(files, "node", "left_semi").orderBy(F.desc(F.round("p", 12)), "node").limit(FEEDBACK_FILES)
    gains = name_terms.join(F.broadcast(best.select(F.col("node").alias("file"))), "file", "left_semi").groupBy(F.col("term").alias("node")).agg(F.count("*").alias("times"))
    weight = F.least(F.col("e") * F.pow(F.lit(FEEDBACK_GAIN), F.coalesce("times", F.lit(0))), F.lit(FEEDBACK_MOST))
    boosted = seeds.join(gains, "node", "left").select("node", weight.alias("e"))
    total = boosted.agg(F.sum("e").alias("total"))
    return propagate(boosted.crossJoin(F.broadcast(total)).select("node", (F.col("e") / F.col("total")).alias("e")), transitions)


def discovered(p: DataFrame, files: DataFrame) -> DataFrame:
    """Files the walk reached, with scores for display, best first."""
    seen = p.join(files, "node", "left_semi").filter(F.col("p") > VISIBLE)
    return seen.select(F.col("node").alias("file"), F.round(F.col("p") * SHOWN, 1).alias("score"))


#: Masses of questions on terms that go to every task at once (32 MB).
BLOCK_CELLS = 2_000_000


def inject_asked(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """inject for every question: (qid, node, e), each question's seeds summing to one."""
    near = edges.filter("to_file").join(seeds.withColumnRenamed("node", "src"), "src").groupBy("qid", F.col("dst").alias("node")).agg(F.sum(F.col("e") * INJECTED).alias("e"))
    every = seeds.unionByName(near.join(seeds, ["qid", "node"], "left_anti"))
    total = every.groupBy("qid").agg(F.sum("e").alias("total")).filter("total > 0")
    return every.join(total, "qid").select("qid", "node", (F.col("e") / F.col("total")).alias("e"))


def discover_asked(seeds: DataFrame, transitions: DataFrame, rounds: int = ROUNDS, restart: float = RESTART) -> DataFrame:
    """Files that each question's walk reaches: qid, file, p, those of p over VISIBLE.

    seeds: (qid, node, e). No edge leaves a file, so the rounds run between terms alone, one join and one aggregation of
    qid and term each; the last step to the files is a product of the terms' masses, in blocks of questions that go to
    every task, with the edges into each file, so that questions times edges are never rows.
    """
    start = materialise(seeds.select("qid", "node", "e"))
    between, into = transitions.filter("not to_file"), transitions.filter("to_file")
    p = start.withColumnRenamed("e", "p")
    for _ in range(rounds - 1):
        moved = between.join(p.withColumnRenamed("node", "src"), "src").select("qid", F.col("dst").alias("node"), (F.col("p") * F.col("m") * (1 - restart)).alias("p"))
        p = moved.unionByName(start.select("qid", "node", (F.col("e") * restart).alias("p"))).groupBy("qid", "node").agg(F.sum("p").alias("p"))
    p = materialise(p.join(into.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
    per_file = materialise(into.groupBy(F.col("dst").alias("file")).agg(F.collect_list(F.struct("src", "m")).alias("ins")))
    sizes = p.groupBy("qid").agg(F.count("*").alias("n")).orderBy("qid").collect()  # a row a question asked
    kind = seeds.schema["qid"].dataType.simpleString()
    own = start.select("qid", F.col("node").alias("file"), (F.col("e") * restart).alias("p")).join(per_file.select("file"), "file", "left_semi").select("qid", "file", "p")
    blocks, cells = [], BLOCK_CELLS
    for r in sizes:
        if cells + r.n > BLOCK_CELLS:
            blocks.append([])
            cells = 0
        blocks[-1].append(r.qid)
        cells += r.n
    parts = [own] + [_into_files(p, per_file, qids, 1 - restart, kind) for qids in blocks]
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "file").agg(F.sum("p").alias("p")).filter(F.col("p") > VISIBLE)


def _into_files(p: DataFrame, per_file: DataFrame, qids: list, share: float, kind: str) -> DataFrame:
    block = p.filter((F.col("qid") >= qids[0]) & (F.col("qid") <= qids[-1])).toPandas()
    block["row"] = block["qid"].map({q: k for k, q in enumerate(qids)})
    held = {node: (part["row"].to_numpy(), part["p"].to_numpy() * share) for node, part in block.groupby("node")}
    shared = p.sparkSession.sparkContext.broadcast((np.array(qids), held))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, masses = shared.value
        for batch in batches:
            for file, ins in zip(batch["file"], batch["ins"]):
                got = np.zeros(len(asked))
                for x in ins:
                    if x["src"] in masses:
                        rows, mass = masses[x["src"]]
                        got[rows] += mass * x["m"]
                some = np.flatnonzero(got)
                if len(some):
                    yield pd.DataFrame({"qid": asked[some], "file": file, "p": got[some]})

    return per_file.mapInPandas(multiply, f"qid {kind}, file string, p double")


def grid(edges: DataFrame, followers: dict[int, DataFrame], is_file: Column, ratios: list[float], boosts: list[float]) -> DataFrame:
    """The graph under every setting of file ratio, heading boost and followers: setting, src, dst, to_file, w_int.

    edges: (src, dst, w, etype) without those of followers, which are given by their number; setting is a struct of the
    three. Families are merged once a boost and number, ratios only divide them differently.
    """
    spark = edges.sparkSession
    steps = spark.createDataFrame([(float(b), k) for b in boosts for k in followers], "boost double, most int")
    scaled = F.when(F.col("etype") == "heading", F.col("w") / HEADING * F.col("boost")).otherwise(F.col("w"))
    every = edges.crossJoin(F.broadcast(steps)).select("boost", "most", "src", "dst", scaled.alias("w"))
    for most, top in followers.items():
        own = bigram_edges(top).crossJoin(F.broadcast(steps.filter(F.col("most") == most)))
        every = every.unionByName(own.select("boost", "most", "src", "dst", "w"))
    keys = ["boost", "most"]
    merged = every.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w")).withColumn("to_file", is_file)
    parts = merged.groupBy(*keys, "src", "to_file").agg(F.sum("w").alias("total")).filter("total > 0")
    parts = parts.crossJoin(F.broadcast(spark.createDataFrame([(float(r),) for r in ratios], "ratio double")))
    parts = parts.withColumn("share", F.when(F.col("to_file"), F.col("ratio") / (F.col("ratio") + 1)).otherwise(1 / (F.col("ratio") + 1)))
    parts = parts.join(parts.groupBy(*keys, "ratio", "src").agg(F.sum("share").alias("shares")), [*keys, "ratio", "src"])
    whole = F.col("w") / F.col("total") * F.col("share") / F.col("shares")
    out = merged.join(parts, [*keys, "src", "to_file"])
    return out.select(F.struct("ratio", *keys).alias("setting"), "src", "dst", "to_file", F.greatest(F.lit(1), F.floor(F.round(whole * UNITS, 6))).cast("int").alias("w_int"))


def health(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Isolated share of the nodes, ratio of the edge kinds, and out-degrees."""
    degree = nodes.join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"), F.count_if("to_file").alias("f")), "node", "left").fillna(0)
    return degree.agg(
        F.count("*").alias("nodes"), F.round(F.avg((F.col("d") == 0).cast("int")), 6).alias("isolated"),
        F.round(F.try_divide(F.sum("f"), F.sum(F.col("d") - F.col("f"))), 6).alias("file_ratio"),
        F.round(F.avg("d"), 4).alias("avg_degree"), F.percentile("d", 0.5).alias("median_degree"), F.max("d").alias("max_degree"),
    )
