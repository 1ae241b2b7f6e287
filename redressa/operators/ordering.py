"""Row positions over data of any size and skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redressa.operators.lookup import fits_broadcast
from redressa.session import materialized

_LOCAL_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in its lower 33 bits


def with_position(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Number rows from 1 in ``order`` within ``by``, whatever the share of one key.

    A window over ``by`` would put all rows of a hot key (or of the whole table, when ``by`` is
    empty) into one task. Here rows are range-partitioned on (by, order), so a hot key spreads
    over many tasks; each row knows its index in its slice, and the rows of the same key in
    earlier slices are counted from a table of one row per key and slice. ``order`` must be
    unique within ``by``; a null key is a key like others. Pass narrow rows that are cheap to
    read: they are sampled, then written once.
    """
    keys = list(by)
    numbered = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", _LOCAL_INDEX_BITS))
        .withColumn("_index", F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_INDEX_BITS) - 1)))
        .drop("_id")
    )
    # A struct of the keys equals itself also where a key is null.
    numbered = materialized(numbered.withColumn("_group", F.struct(F.lit(0).alias("_"), *keys)))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy("_group", "_slice")
        .agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1)
        .select("_group", "_slice", "_shift")
    )
    # No key is hot here: a group's rows in one slice are at most what one task has sorted.
    return (
        numbered.join(F.broadcast(starts) if fits_broadcast(starts) else starts, ["_group", "_slice"])
        .withColumn(name, (F.col("_index") + F.col("_shift")).cast("long"))
        .drop("_group", "_slice", "_index", "_shift")
    )


def running_total(df: DataFrame, value: str, order: str, by: Sequence[str], block: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to each row in ``order`` within ``by``.

    ``block`` cuts the order into stretches. Sums run within a stretch, many tasks a key, and the totals of the
    stretches before it, one row each, are added. Rows of one order are summed together; a null key is a key. Names of
    columns that begin with ``_group``, ``_block``, ``_within`` and ``_earlier`` are taken.
    """
    blocks = df.withColumns({"_group": F.struct(F.lit(0).alias("_"), *by), "_block": block})
    totals = blocks.groupBy("_group", "_block").agg(F.sum(value).alias("_within"))
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_group", "_block", F.coalesce(F.sum("_within").over(before), F.lit(0)).alias("_earlier"))
    upto = F.sum(value).over(Window.partitionBy("_group", "_block").orderBy(order))
    summed = blocks.withColumn("_within", upto).join(starts, ["_group", "_block"])
    return summed.withColumn(name, F.col("_earlier") + F.col("_within")).drop("_group", "_block", "_within", "_earlier")
