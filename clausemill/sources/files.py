"""Sources and sinks: Markdown folders, JSON lines, layout blocks, status pages, and versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BLOCK = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("page_idx", T.IntegerType()),
    T.StructField("text_level", T.IntegerType()), T.StructField("list_items", T.ArrayType(T.StringType())),
])
#: Kinds of layout blocks that carry no running text.
DROPPED = ("image", "table", "header", "footer", "equation")


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every Markdown file below a folder: file, title of its front matter, text."""
    rows = spark.read.text(f"{path}/*.md", wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    title = F.nullif(F.regexp_extract("value", r"(?s)\A---\n.*?^title:\s*(.+?)\s*$.*?^---$".replace("(?s)", "(?sm)"), 1), F.lit(""))
    return rows.select("file", title.alias("title"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines by a given schema; bad lines are left out, or fail the read if strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def layout_blocks(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Layout JSON (an array of blocks) as rows: key, idx and the block's fields; unreadable content gives none."""
    return rows.select(key, F.posexplode(F.from_json(content, T.ArrayType(BLOCK))).alias("idx", "b")).select(key, "idx", "b.*")


def running_text(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Blocks that carry text of some length."""
    return blocks.filter(~F.coalesce(F.col("type"), F.lit("")).isin(*DROPPED) & (F.length(F.trim("text")) >= least))


def full_text(blocks: DataFrame, key: str) -> DataFrame:
    """Each document's text: blocks and list items in order of page and place, one a line."""
    body = F.concat_ws("\n", F.nullif(F.trim("text"), F.lit("")), F.array_join("list_items", "\n"))
    rows = blocks.select(key, F.struct(F.coalesce("page_idx", F.lit(0)).alias("page"), "idx", body.alias("body")).alias("b"))
    return rows.groupBy(key).agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["body"]), lambda x: x != ""), "\n").alias("text"))


def status_cells(html: Column) -> Column:
    """Cells of a status page's table rows, as an array of arrays."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return F.transform(rows, cell)


def write_version(frame: DataFrame, root: str, version: str) -> str:
    """A table written to a folder of its own version, so that an earlier one can be taken back."""
    path = f"{root}/{version}"
    frame.write.mode("overwrite").parquet(path)
    return path


def split_plan(size: Column, pages: Column, most_pages: int = 200, most_mb: float = 200.0) -> Column:
    """Page ranges (first, last) into which a large file is cut: as many as its pages or its size need."""
    parts = F.greatest(F.ceil(pages / most_pages), F.ceil(size / most_mb), F.lit(1)).cast("int")
    step = F.ceil(pages / parts).cast("int")
    ranges = F.transform(F.sequence(F.lit(1), parts), lambda k: F.struct(((k - 1) * step + 1).alias("first"), F.least(k * step, pages).alias("last")))
    return F.filter(ranges, lambda r: r["first"] <= r["last"])
