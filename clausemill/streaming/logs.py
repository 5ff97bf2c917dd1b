"""The search log and events as streams: windowed counts, change-only emission, zero-result feedback, index upserts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from clausemill.session import shared_folder



def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's state and output in the folder the cluster shares; the caller removes it when done with it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet file or folder as a stream of its files."""
    return spark.readStream.schema(schema).parquet(path if os.path.isdir(path) or "://" in path else f"{os.path.dirname(path)}/{os.path.basename(path)[:-8]}*.parquet")


def window_counts(stream: DataFrame, ts: str, kind: str, size: str, late: str) -> DataFrame:
    """Rows by window and kind, with a watermark; the time column may be without zone."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n")


def run_once(stream: DataFrame, name: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Everything that is there now through a stream, as a frame.

    Each batch is written to a folder of its own, so a batch that is run again replaces itself. Complete mode gives the
    last batch, append mode all batches together, and update mode the last row of each of the keys.
    """
    spark = stream.sparkSession
    out = folder(spark, name)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")

    written: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        written.append(number)
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    kept = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/data")
    if mode == "append":
        return kept.drop("batch")
    if mode == "update":
        values = [c for c in stream.columns if c not in keys]
        return kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*").select(*stream.columns)
    return kept.filter(F.col("batch") == max(written)).drop("batch")


def zero_result_feedback(logs: DataFrame) -> DataFrame:
    """Searches without results, as feedback records; works on a stream and a table."""
    return logs.filter("results = 0 and q is not null").select("log_id", F.lit("zero_result").alias("type"), F.trim("q").alias("query"), "ts")


def upsert(target: DataFrame, batch: DataFrame, key: str, newest: str) -> DataFrame:
    """A keyed table with a batch's rows in it, the newest of each key."""
    return target.unionByName(batch).groupBy(key).agg(F.max_by(F.struct(*[c for c in target.columns if c != key]), newest).alias("r")).select(key, "r.*")


def append(frame: DataFrame, path: str) -> None:
    """A frame appended to a log of JSON lines."""
    frame.write.mode("append").json(path)


__all__ = ["append", "folder", "read_stream", "run_once", "upsert", "window_counts", "zero_result_feedback"]
