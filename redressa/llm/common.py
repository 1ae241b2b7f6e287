"""Small pieces that several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.session import work_folder

#: Draws have so many bits.
DRAW_BITS = 63


def shipped(spark: SparkSession) -> SparkSession:
    """Workers on this machine import the package from where the driver did; a cluster gets it by ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: survives lost executors, is computed once, cuts the lineage."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def id_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(key.cast("string")) % divisor


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_share(rows: int, size: int, max_rows: int, max_bytes: int) -> int:
    """How many of 2**63 draws take a row, so that about ``max_rows`` of ``rows`` and ``max_bytes`` of ``size`` are taken."""
    whole = 1 << DRAW_BITS
    return min(whole, (max_rows << DRAW_BITS) // max(1, rows), (max_bytes << DRAW_BITS) // max(1, size))


def bounded_sample(rows: DataFrame, by: str, text: str, max_rows: int, max_bytes: int, seed: int = 1) -> DataFrame:
    """About ``max_rows`` whole rows of each value of ``by``, fewer if their texts exceed ``max_bytes``.

    One pass counts rows and bytes per value; a hash of the text then picks the share, in any
    order and on any number of tasks alike. Values of ``by`` are class names, one row each on the driver.
    """
    sizes = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).alias("size")
    ).collect()
    last = [(r[by], sample_share(r["n"], r["size"], max_rows, max_bytes) - 1) for r in sizes]
    spark = rows.sparkSession
    kind = rows.schema[by].dataType.simpleString()
    picked = F.broadcast(spark.createDataFrame(last, f"`{by}` {kind}, _last long"))
    draw = F.xxhash64(F.lit(seed), F.col(text)).bitwiseAND(F.lit((1 << DRAW_BITS) - 1))
    return rows.join(picked, by).filter(draw <= F.col("_last")).drop("_last")
