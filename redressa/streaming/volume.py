"""Daily volumes of a stream, each day counted once it is over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.sources.tables import read_batches, write_batch
from redressa.streaming.late import beside, put_late_aside


def daily_volume(events: DataFrame, horizon: str) -> DataFrame:
    """Stream of (day, kind, n), one row when the watermark has passed the day, beside the events.

    Takes a stream (ts, kind). Counts are combined within a task before they meet the state, so a kind with a
    third of all events costs one row a task and batch. A row without a kind is a sign of life: it
    moves the time on and is counted nowhere, so a source that falls silent can still close its last day.
    """
    days = events.withWatermark("ts", horizon).groupBy(F.window("ts", "1 day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return beside(days.select(F.col("window.start").cast("date").alias("day"), "kind", "n"), events)


def store_volume(folder: str, horizon: str):
    """Handler of :func:`daily_volume`: closed days to ``folder``/days, events that come after their day was closed to ``folder``/late."""

    def handle(days: DataFrame, batch_id: int) -> None:
        write_batch(days.filter("kind IS NOT NULL"), f"{folder}/days", batch_id)

    return put_late_aside(folder, "ts", horizon, handle, late_from=lambda bound: F.date_trunc("day", bound))


def read_volume(spark: SparkSession, folder: str) -> DataFrame:
    """All closed days; each (day, kind) comes from one batch."""
    return read_batches(spark, f"{folder}/days").select("day", "kind", "n")
