"""Markdown files as lines and sections: segmentation, types, lengths, clause numbers and lookups."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Words of front matter, and of headings that begin commentary.
NOISE = (
    "前言", "目次", "目录", "总则", "术语", "符号", "公告", "通知", "修订说明", "编制说明", "条文说明", "中华人民共和国", "发布", "住房城乡建设部", "关于发布", "施行日期", "主编单位", "批准部门", "批准施行", "发布公告",
    "标准由", "负责管理", "归口", "解释", "编制人员", "编制单位", "编委", "主编", "参编", "参加编制", "主要起草", "主要审查", "本标准主编", "本标准参编", "起草人员", "审查人员", "参加单位", "编制组", "编写组", "技术负责人",
    "技术审定", "校核", "审核人", "审定人", "设计单位", "勘察单位", "施工单位", "监理单位", "主要编写", "副主编",
)
NOISE_ENGLISH = ("Standard for", "Code for", "Technical", "General code")
COMMENTARY = "条文说明|用词说明"
TOC_LINE = r"^#{1,3}\s+(目\s*次|目\s*录|Contents)\s*$"
BODY_LINE = r"^#{1,3}\s+(\d+\s+)?(总\s*则|基本规定)\s*$"
HEADING = r"^#{1,3}\s+(.+)$"
LEAF = r"^\d+\.\d+(\.\d+)+\s+\S.*$"
PRIORITY = {"normative": 0, "commentary": 1, "appendix": 2, "reference": 3}


LINES = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("pos", T.IntegerType())]))


@F.pandas_udf(LINES)
def _placed_lines(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        split = text.split("\n")
        starts = accumulate((len(line) + 1 for line in split), initial=0)
        out.append([{"line_no": k, "line": line, "pos": pos} for k, (line, pos) in enumerate(zip(split, starts))])
    return pd.Series(out, dtype=object)


def lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row a line: key, line_no, line, pos (in code points) and the text's length.

    A file is one row, so the offsets are counted inside it and nothing is shuffled.
    """
    return files.filter(F.col(text).isNotNull()).select(key, F.length(text).alias("size"), F.inline(_placed_lines(F.col(text))))


def is_front_heading(heading: Column) -> Column:
    """Whether a heading is a table-of-contents entry, front matter or a long notice."""
    bare = F.regexp_replace(heading, "[ 　]", "")
    noise = F.lit(False)
    for word in NOISE:
        noise = noise | bare.contains(word)
    for word in NOISE_ENGLISH:
        noise = noise | bare.contains(word)
    return (
        heading.rlike(r"……\s*\d{1,4}\s*$")
        | heading.rlike(r"[\s…]{2,}\d{2,4}\s*$")
        | noise & ~heading.rlike(COMMENTARY)
        | (F.length(heading) > 60) & ~heading.rlike(r"\d+\.\d+|[IVXLCDMⅠ-ⅻ]+\s")
    )


def sections(files: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of each file: sid, heading, pos, length, type, leaf.

    Headings of up to three signs and clauses of three or more numbers begin sections; those before the body, which
    begins at the first chapter behind a table of contents, and those of front matter don't. A section ends where the
    next begins. Headings that begin commentary are kept, so that what follows them is commentary.
    """
    at = lines(files, key, text)
    own = Window.partitionBy(key)
    toc = F.min(F.when(F.col("line").rlike(TOC_LINE), F.col("pos"))).over(own)
    at = at.withColumn("toc", toc)
    body = F.min(F.when(F.col("line").rlike(BODY_LINE) & (F.col("pos") > F.coalesce("toc", F.lit(-1))), F.col("pos"))).over(own)
    at = at.withColumn("body", F.coalesce(body, F.lit(0))).filter("pos >= body")
    marked, leaf = F.col("line").rlike(HEADING), F.col("line").rlike(LEAF)
    named = at.filter(marked | leaf).withColumn("heading", F.trim(F.when(marked, F.regexp_extract("line", HEADING, 1)).otherwise(F.col("line"))))
    named = named.filter(~is_front_heading(F.col("heading")))
    commentary = F.min(F.when(marked & F.col("heading").rlike(COMMENTARY), F.col("pos"))).over(own)
    reference = F.min(F.when(marked & F.col("heading").startswith("引用标准名录"), F.col("pos"))).over(own)
    kind = (
        F.when(F.col("pos") >= F.col("commentary"), "commentary").when(F.col("heading").contains("附录"), "appendix")
        .when(F.col("pos") >= F.col("reference"), "reference").otherwise("normative")
    )
    named = named.withColumns({"commentary": commentary, "reference": reference, "leaf": ~marked}).withColumn("type", kind)
    order = Window.partitionBy(key).orderBy("pos")
    return named.select(
        key, (F.row_number().over(order) - 1).alias("sid"), F.substring("heading", 1, 120).alias("heading"), "pos",
        (F.coalesce(F.lead("pos").over(order), F.col("size")) - F.col("pos")).alias("length"), "type", "leaf",
    )


def clauses(sections: DataFrame, key: str) -> DataFrame:
    """Numbered sections: number, title, parent; a Roman number belongs to the last Arabic one before it."""
    arabic = F.nullif(F.regexp_extract("heading", r"^(\d+(?:\.\d+)*)\s", 1), F.lit(""))
    roman = F.nullif(F.regexp_extract("heading", r"^([IVXLCDMⅠ-ⅻ]+)\s", 1), F.lit(""))
    chinese = F.nullif(F.regexp_extract("heading", r"^(第[一二三四五六七八九十百千\d]+条)", 1), F.lit(""))
    rows = sections.withColumns({"arabic": arabic, "number": F.coalesce(arabic, roman, chinese)}).filter("number is not null")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.coalesce("arabic", F.when(F.col("number").startswith("第"), F.col("number"))), ignorenulls=True).over(before)
    parent = F.when(F.col("number").contains("."), F.regexp_replace("number", r"\.\d+$", "")).when(F.col("number").rlike(r"^[IVXLCDMⅠ-ⅻ]+$"), last)
    title = F.trim(F.substr("heading", F.length("number") + 1))
    return rows.withColumns({"parent": parent, "title": title})


def keep_best(rows: DataFrame, keys: list[str], priority: Column, *order: str) -> DataFrame:
    """The best row of each key by priority; ties go to the first in the given order."""
    best = Window.partitionBy(*keys).orderBy(priority, *order)
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def type_priority(kind: Column) -> Column:
    """Normative text before commentary, appendices and references; others as normative."""
    out = F.when(F.lit(False), F.lit(0))
    for name, value in PRIORITY.items():
        out = out.when(kind == name, F.lit(value))
    return out.otherwise(F.lit(0))


def section_at(points: DataFrame, sections: DataFrame, key: str, pos: str) -> DataFrame:
    """Points with the section that holds them: an equi-join on the file with the range as its condition."""
    spans = sections.select(key, F.col("pos").alias("start"), (F.col("pos") + F.col("length")).alias("stop"), "sid", "heading")
    return points.join(spans, (points[key] == spans[key]) & (points[pos] >= spans["start"]) & (points[pos] < spans["stop"])).drop(spans[key])


def last_before(points: DataFrame, marks: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    """As-of join: points with the value of the last mark at or before them; one sort of both sides together."""
    both = points.withColumns({value: F.lit(None).cast(marks.schema[value].dataType), "_point": F.lit(1)}).unionByName(marks.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(by, "_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).filter("_point = 1").drop("_point")
