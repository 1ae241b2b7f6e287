"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redressa.session import COMPRESSION


def read_table(spark: SparkSession, folder: str, name: str, spread_by: str | None = None) -> DataFrame:
    """A table; with ``spread_by`` also one of few splits keeps all cores busy.

    Heavy work per row on a table of one file would run in one task. Such a table is spread
    by a hash of ``spread_by``; a table with as many splits as cores is read as it is.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_by and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores, spread_by)
    return table


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """Write one batch under its own id: a replay of the batch replaces its own output only."""
    df.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{folder}/batch_id={batch_id}")


def read_batch(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All batches, with ``batch_id`` as a partition column that prunes files."""
    return spark.read.parquet(folder)
