"""Tables by name from a folder of Parquet files, and reliable cuts of long lineages."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task is dealt where ``tasks_for`` tells how many tasks there are.
ROWS_A_TASK = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; an own one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """A table written to the shared folder by columns, where a checkpoint of many like strings takes many times the room."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores if it was read as fewer splits than there are cores.

    The splits are counted without reading a column. Tables of many splits stay where they are.
    """
    splits = df.select(F.spark_partition_id().alias("split")).agg(F.count_distinct("split")).first()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits < cores else df


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """How many parts a table is dealt into so that each has about ``rows`` rows (``ROWS_A_TASK``), one for each core at least.

    A number that is named is kept by Spark as it is; without one, parts are put together up to a size in
    bytes as they are stored, of which a sort or an aggregate takes many times as much memory.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / (rows or ROWS_A_TASK)))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it is kept."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
