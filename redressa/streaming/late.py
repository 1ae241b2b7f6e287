"""Rows that come too late for a stateful stream are dropped by Spark; here they are put aside instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redressa.session import materialized
from redressa.sources.tables import read_batch, write_batch

Handler = Callable[[DataFrame, int], None]


def beside(result: DataFrame, given: DataFrame) -> DataFrame:
    """What a stateful operator gives, and the rows it was given, as one stream of (result, given)."""
    row = lambda df: F.struct(*df.columns)
    none = lambda df: F.lit(None).cast(df.select(row(df).alias("row")).schema["row"].dataType)
    results = result.select(row(result).alias("result"), none(given).alias("given"))
    return results.unionByName(given.select(none(result).alias("result"), row(given).alias("given")))


def put_late_aside(
    folder: str, time: str, horizon: str, handle: Handler, late_from: Callable[[Column], Column] | None = None
) -> Handler:
    """Handler of a stream made by :func:`beside`: ``handle`` gets the results, late rows go to ``folder``/late.

    Spark drops rows that are not newer than the watermark under which the batch before this one ran, which is the
    newest ``time`` of all batches before that one less ``horizon``. The same rows are late here; a row
    without a time has no place in a stream ordered by it and is put aside too. Of windows Spark drops those that
    end by the watermark: ``late_from`` makes of the watermark the start of the first window that is open, and
    rows before it are late. One row per batch keeps the newest time so far. The batch is written first, so the
    operator with the state runs once however often its results are read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        both = materialized(batch, "stream-batch")
        given = both.filter("given IS NOT NULL").select("given.*")
        newest_of = lambda n: read_batch(spark, f"{folder}/newest", n).first()["newest"] if n >= 0 else None
        bound = F.date_trunc("millisecond", F.lit(newest_of(batch_id - 2)).cast("timestamp")) - F.expr(f"INTERVAL {horizon}")
        behind = F.col(time) <= bound if late_from is None else F.col(time) < late_from(bound)
        late = F.col(time).isNull() | F.coalesce(behind, F.lit(False))
        write_batch(given.filter(late), f"{folder}/late", batch_id)
        newest = F.greatest(F.max(time), F.lit(newest_of(batch_id - 1)).cast("timestamp"))
        write_batch(given.agg(newest.alias("newest")), f"{folder}/newest", batch_id)
        handle(both.filter("result IS NOT NULL").select("result.*"), batch_id)

    return run
