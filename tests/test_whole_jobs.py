"""Queries that must do the whole job: every pair, every question, every token."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from clausemill.operators import graph, lexical, search, vectors
from clausemill.plans import registry, search as plans
from clausemill.plans.lexical import golden_questions


def test_every_close_pair_is_an_edge_both_ways(spark, monkeypatch):
    """No row is left out by its id, and no row keeps only some of its partners."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    v = np.random.default_rng(1).normal(size=(60, 4))
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 3)
    rows = [(k + 1, [float(x) for x in v[k]]) for k in range(60)]
    frame = spark.createDataFrame([*rows, rows[0], (99, None), (None, rows[0][1])], "vec_id bigint, embedding array<double>")
    got = Counter((r.src, r.dst) for r in graph.semantic_edges(vectors.close_pairs(frame, 0.2), 0.2).collect())
    sims = np.round(v @ v.T, 4)
    want = Counter((i + 1, j + 1) for i in range(60) for j in range(60) if i != j and sims[i, j] >= 0.2)
    assert got == want and max(Counter(s for s, _ in want).values()) > 20


def test_searches_are_asked_the_golden_queries(spark, tmp_path):
    """Every golden query whose id is divisible by 20, once, and none other."""
    rows = [(20, "混凝土 养护"), (20, "混凝土 养护"), (40, "C40"), (41, "C40"), (60, None), (None, "C40")]
    spark.createDataFrame(rows, "query_id bigint, query string").write.parquet(f"{tmp_path}/golden_queries.parquet")
    assert sorted(tuple(r) for r in golden_questions(spark, str(tmp_path)).collect()) == [(20, "混凝土 养护"), (40, "C40")]
    golden = {"d1_keyword_golden", "w7_best_golden", "d4_title_golden", "d5_direct_golden", "x9_hybrid_golden", "x8_version_golden", "x3_authority_golden", "d3_bm25_golden"}
    assert golden <= set(registry.queries())


def test_keywords_are_found_as_by_scanning(spark):
    """Any set of queries, with odd keywords: a single sign, one in another, one shared, more words than six."""
    words = ["用", "适用", "适用吗", "c40", "c", "gb/t", "±0.5", "𠮷", "𠮷野", "标准 规范 规程 要求 限值 偏差 强度 c40"]
    texts = ["本标准适用于c40", "", None, "gb/t 100 偏差±0.5", "𠮷野", "强度", "用"]
    asked = [(k, w.split()) for k, w in enumerate(words)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.finder(asked)(F.col("t")).alias("m")).select("t", "m.*").collect()
    for r in found:
        assert set(r.found) == {w for _, ws in asked for w in ws if w in (r.t or "")} and len(set(r.found)) == len(r.found)
        assert sorted(r.qids) == [k for k, ws in asked if any(w in (r.t or "") for w in ws)]


def test_bm25_of_every_query(spark):
    """Each query's scores are those it has alone, by all its tokens."""
    rows = spark.createDataFrame([(1, "模板支架沉降量的限值"), (2, "剪力墙垂直度偏差限值"), (3, "concrete 剪力墙 模板"), (4, "短")], "id int, t string")
    asked = {1: "剪力墙 垂直度", 5: "模板支架 沉降量 限值", 6: "concrete", 7: "无", 8: ""}
    got = {(r.qid, r.id): round(r.score, 9) for r in lexical.bm25_asked(rows, "id", "t", spark.createDataFrame(list(asked.items()), "qid int, text string")).collect()}
    terms = {1: ["剪力", "力墙", "垂直", "直度"], 5: ["模板", "板支", "支架", "沉降", "降量", "限值"], 6: ["concrete"]}
    assert got == {(q, r.id): round(r.score, 9) for q, ts in terms.items() for r in lexical.bm25(rows, "id", "t", ts).collect()}


def test_bodies_of_all_golden_queries_are_merged(spark):
    """Both merges hold more than two queries, and every file that shares any token with one."""
    data = "/root/testdata/sf0.001"
    asked = golden_questions(spark, data)
    shared = {tuple(r) for r in plans._bodies_asked(spark, data, asked).select("qid", "file").collect()}
    files = {r.file: set(r.toks) for r in spark.read.parquet(f"{data}/kb_md.parquet").select("file", lexical.token_array(F.col("text")).alias("toks")).collect()}
    asked = {r.qid: set(r.toks) for r in asked.select("qid", lexical.token_array(F.col("text")).alias("toks")).collect()}
    assert shared == {(q, f) for q, ts in asked.items() for f, toks in files.items() if ts & toks} and shared
    aligned = {(r.qid, r.file) for r in registry.queries()["x1_aligned_golden"](spark, data).collect()}
    assert shared <= aligned
