"""Session settings and small helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings of a locally started session. On a cluster the submitter's own values win.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("clausemill")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_wide(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table whose rows are dear to work on: where its files give fewer tasks than there are cores, it is spread.

    Only tables of a few files are shuffled by this; large ones are read as they are split.
    """
    df = read(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, named by spark.checkpoint.dir; a temporary one in local mode, as in tests.

    Elsewhere a session without the setting is refused: a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return os.path.join(tempfile.gettempdir(), "clausemill-shared")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
