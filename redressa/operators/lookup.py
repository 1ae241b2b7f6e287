"""Joins of a large table to a table with unique keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redressa.session import materialized

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HOT_SHARES = 1000
#: Of a bitmap that Spark's functions make.
BITMAP_BYTES = 4096


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df``: the answer is one row of partial sums, whatever its size."""
    width = F.lit(0)
    for field in df.schema.fields:
        width = width + 16
        if not isinstance(field.dataType, (T.NumericType, T.DatetimeType, T.BooleanType)):
            width = width + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def lookup_join(
    facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS,
    unique_facts: bool = False,
) -> DataFrame:
    """Join ``facts`` to ``dim`` (one row per key) without a task per hot key.

    ``dim`` is written, measured, and broadcast if it is small. Otherwise rows with a null in the key,
    which match nothing, take no part in the join, and the keys that hold more than a thousandth of all facts
    (fewer than a thousand, by counting) are joined by broadcasting their few ``dim`` rows, the others
    by a shuffle in which no key is large. With ``unique_facts`` no key is: nothing is counted.
    """
    dim = materialized(dim, "lookup")
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), list(on), how)
    whole = reduce(and_, [F.col(name).isNotNull() for name in on])
    keyed = facts.filter(whole)
    joined = keyed.join(dim, list(on), how) if unique_facts else _split_hot_keys(keyed, dim, list(on), how)
    if how not in ("left", "left_anti"):
        return joined
    return joined.unionByName(facts.filter(~whole), allowMissingColumns=True)


def take_rows(rows: DataFrame, chosen: DataFrame, row: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Those of ``rows`` whose number in ``row`` is in ``chosen``; both hold numbers of ``monotonically_increasing_id``.

    Such numbers are dense within a task, so the choice is a bit per row, which is sent to the readers up to
    ``max_bytes`` of bits: millions of texts are chosen among without a shuffle. A larger choice is joined by one.
    """
    bits = chosen.groupBy(F.bitmap_bucket_number(row).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("_bits"))
    bits = materialized(bits, "lookup")
    if bits.count() * BITMAP_BYTES > max_bytes:
        return rows.join(chosen, row, "left_semi")
    at = f"bitmap_bit_position(`{row}`)"
    byte = f"cast(conv(hex(substring(_bits, cast(shiftright({at}, 3) AS INT) + 1, 1)), 16, 10) AS INT)"
    taken = F.expr(f"shiftright({byte}, cast({at} % 8 AS INT)) & 1 = 1")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(row)).join(F.broadcast(bits), "_bucket")
    return found.filter(taken).select(*rows.columns)


def _split_hot_keys(facts: DataFrame, dim: DataFrame, on: list[str], how: str) -> DataFrame:
    # Counted once and written: the hot keys are used three times below.
    counts = materialized(facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("_n") * HOT_SHARES > F.lit(total)).select(*on))
    on_hot_rows = facts.join(hot, on, "left_semi").join(F.broadcast(dim.join(hot, on, "left_semi")), on, how)
    on_other_rows = facts.join(hot, on, "left_anti").join(dim, on, how)
    return on_hot_rows.unionByName(on_other_rows)
