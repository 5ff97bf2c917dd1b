"""Small fixtures: nulls, empty frames, ties, repeated rows, and invariants."""

import pytest
from pyspark.sql import functions as F, types as T

from clausemill.functions import support
from clausemill.operators import graph, lexical, metrics, search, sections, vectors

MINI = "# 目次\n# 5 消防 …… 12\n# 1 总则\n1.0.1 本标准适用于现场。\n## 5.3 临时给水\n5.3.4 面积大于1000m2时应设置。\n# 附录 A 资料\n# 本标准用词说明\n5.3.4 说明文字。"


def test_sections_of_a_small_file(spark):
    files = spark.createDataFrame([("a", MINI), ("b", ""), ("c", None)], "file string, text string")
    rows = {r.heading: r for r in sections.sections(files, "file", "text").collect()}
    assert rows["1.0.1 本标准适用于现场。"].leaf and rows["5.3 临时给水"].type == "normative"
    assert rows["附录 A 资料"].type == "appendix" and rows["5.3.4 说明文字。"].type == "commentary"
    assert all(MINI[r.pos :].lstrip("# ").startswith(r.heading) for r in rows.values())
    assert max(r.pos + r.length for r in rows.values()) == len(MINI)


def test_postings_sum_to_tokens(spark):
    rows = spark.createDataFrame([(1, "混凝土混凝土 concrete concrete"), (2, None), (3, "")], "id int, t string")
    got = {r.term: r.tf for r in lexical.postings(rows, "id", "t").collect()}
    assert got == {"concrete": 2, "混凝": 2, "凝土": 2, "土混": 1}
    assert rows.filter("id = 1").select(lexical.token_count(F.col("t"))).first()[0] == sum(got.values())
    assert rows.filter("id = 1").select(lexical.term_count(F.col("t"), "混凝")).first()[0] == 2


def test_bm25_of_an_empty_corpus(spark):
    assert lexical.bm25(spark.createDataFrame([], "id int, t string"), "id", "t", ["ab"]).count() == 0


def test_edges_sum_to_one_before_rounding(spark):
    edges = spark.createDataFrame([("a", "x.md", 1.0), ("a", "y.md", 3.0), ("a", "b", 5.0), ("b", "x.md", 2.0)], "src string, dst string, w double")
    got = {(r.src, r.dst): r.w_int for r in graph.normalised(edges, F.col("dst").endswith(".md")).collect()}
    assert got == {("a", "x.md"): 1666, ("a", "y.md"): 5000, ("a", "b"): 3333, ("b", "x.md"): 10000}


def test_pagerank_mass_is_bounded(spark):
    edges = spark.createDataFrame([("a", "b", False, 10000), ("b", "a", False, 10000)], "src string, dst string, to_file boolean, w_int int")
    p = graph.propagate(spark.createDataFrame([("a", 1.0)], "node string, e double"), graph.matrix(edges))
    assert abs(sum(r.p for r in p.collect()) - 1) < 1e-9


def test_nearest_in_blocks(spark):
    rows = spark.createDataFrame([(k, [float(k == j) for j in range(3)] if k < 3 else [0.6, 0.8, 0.0]) for k in range(4)] + [(9, None)], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in vectors.nearest(rows.filter("vec_id = 3"), rows, 2, 0.1).collect())
    assert got == [(3, 0, 0.6), (3, 1, 0.8)]


def test_union_keeps_first_on_ties(spark):
    schema = "qid int, file string, score double, source string"
    out = search.union_best(spark.createDataFrame([(1, "f", 2.0, "a")], schema), spark.createDataFrame([(1, "f", 2.0, "b"), (1, "g", None, "b")], schema), ["qid", "file"])
    assert {(r.file, r.source) for r in out.collect()} == {("f", "a"), ("g", "b")}


def test_confidence_bands(spark):
    got = [r[0] for r in spark.createDataFrame([(60.0,), (59.99,), (20.0,), (19.99,), (0.0,)], "s double").select(search.confidence(F.col("s"))).collect()]
    assert got == ["high", "mid", "mid", "low", "low"]


def test_percentiles_by_place(spark):
    rows = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 3)] + [(None,)], "v double")
    assert tuple(metrics.picked_percentile(rows, "v", {"p50": 0.5, "p95": 0.95}).first()) == (4, 3.0, 5.0, 5.0)


def test_claims(spark):
    rows = spark.createDataFrame([("不大于5m", "间距为5000mm", True), ("3 kN", "承载3kN", True), ("7d", "养护14d", False)], "claim string, t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", support.claim_in_text(F.col("claim"), F.col("t")).alias("got")).collect())


def test_last_before_takes_ties(spark):
    points = spark.createDataFrame([(1, 5)], "k int, at int")
    marks = spark.createDataFrame([(1, 5, "same"), (1, 2, "early"), (2, 1, "other")], "k int, at int, v string")
    assert sections.last_before(points, marks, ["k"], "at", "v").first().v == "same"


def test_run_once_keeps_every_batch(spark, tmp_path):
    """Ten rows in five files, one file a trigger: append mode keeps all, update mode the last of each key, complete mode the counts."""
    from clausemill.streaming import logs

    for k in range(5):
        spark.createDataFrame([(f"u{k % 2}", 2 * k), (f"u{k % 2}", 2 * k + 1)], "user string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("user string, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in logs.run_once(source(), "t", "append").collect()) == list(range(10))
    counts = source().groupBy("user").agg(F.count("*").alias("c"))
    want = {"u0": 6, "u1": 4}
    assert {r.user: r.c for r in logs.run_once(counts, "t", "update", ["user"]).collect()} == want
    assert {r.user: r.c for r in logs.run_once(counts, "t").collect()} == want
    with pytest.raises(ValueError):
        logs.run_once(counts, "t", "update")
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("user string, n int").parquet(str(tmp_path / "none"))
    assert logs.run_once(empty, "t", "append").count() == 0


def test_json_lines_skip_or_refuse_bad_lines(spark, tmp_path):
    from clausemill.sources import files

    (tmp_path / "log.json").write_text('{"q": "甲", "n": 1}\n\nnot json\n{"q": "乙", "n": "x"}\n{"q": null}\n')
    schema = T.StructType([T.StructField("q", T.StringType()), T.StructField("n", T.IntegerType())])
    assert [(r.q, r.n) for r in files.json_lines(spark, str(tmp_path), schema).collect()] == [("甲", 1), (None, None)]
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        files.json_lines(spark, str(tmp_path), schema, strict=True).collect()


def test_markdown_folder(spark, tmp_path):
    from clausemill.sources import files

    (tmp_path / "a.md").write_text("---\ntitle: 甲标准\ntags: x\n---\n# 1 总则\n")
    (tmp_path / "b.md").write_text("# 无题\n")
    assert {r.file: (r.title, r.text[:3]) for r in files.markdown_folder(spark, str(tmp_path)).collect()} == {"a.md": ("甲标准", "---"), "b.md": (None, "# 无")}


def test_shared_folder_is_refused_off_local_mode():
    from types import SimpleNamespace

    from clausemill.session import shared_folder

    context = lambda master, named="": SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d: named)))
    assert shared_folder(context("yarn", "hdfs://x/")) == "hdfs://x" and shared_folder(context("local[4]"))
    with pytest.raises(ValueError):
        shared_folder(context("yarn"))


def test_contained_refuses_long_lists_and_finds_nested_words(spark):
    words = spark.createDataFrame([("甲乙", 1), ("乙", 2), ("", 3), (None, 4)], "word string, kind int")
    rows = spark.createDataFrame([("x", "甲乙丙"), ("y", None), ("z", "")], "key string, text string")
    assert {(r.key, r.word, r.kind) for r in lexical.contained(rows, "text", words, "word", "kind").collect()} == {("x", "甲乙", 1), ("x", "乙", 2)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexical, "MOST_WORDS", 1)
        with pytest.raises(ValueError):
            lexical.contained(rows, "text", words, "word")
