"""Moving selected open tickets one state on, in the warehouse and in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.operators.stores import advance_status, apply_status_updates, latest_per_ticket
from redressa.sources.tables import read_batch, read_batches, write_batch


def progress(selected: DataFrame, as_of: F.Column, folder: str, batch_id: int) -> None:
    """Advance ``selected`` (ticket_id, status) and append the updates for both tables.

    The selection is written before it is used, so both tables get the same one even when a
    task is repeated; a replay of the batch replaces its own updates. Only changes are
    written, the tables themselves stay where they are.
    """
    write_batch(advance_status(selected, as_of), f"{folder}/ticket_updates", batch_id)
    written = read_batch(selected.sparkSession, f"{folder}/ticket_updates", batch_id)
    write_batch(written.select("ticket_id", "status"), f"{folder}/store_updates", batch_id)


def progressed_tickets(tickets: DataFrame, folder: str) -> DataFrame:
    """The warehouse with all updates appended so far."""
    log = read_batches(tickets.sparkSession, f"{folder}/ticket_updates")
    return apply_status_updates(tickets, latest_per_ticket(log, "batch_id"))


def progressed_store(store: DataFrame, folder: str) -> DataFrame:
    """The operational store, which keeps no resolve time, with the same updates."""
    no_time = F.lit(None).cast("timestamp")
    log = read_batches(store.sparkSession, f"{folder}/store_updates")
    updates = latest_per_ticket(log, "batch_id").withColumn("resolved_ts", no_time)
    return apply_status_updates(store.withColumn("resolved_ts", no_time), updates).drop("resolved_ts")


def resolve(tickets: DataFrame, requests: DataFrame, as_of: F.Column) -> DataFrame:
    """Tickets after user resolve requests (key); asking twice resolves once."""
    updates = requests.select(F.col("key").alias("ticket_id")).distinct().select(
        "ticket_id", F.lit("resolved").alias("status"), as_of.cast("timestamp").alias("resolved_ts")
    )
    return apply_status_updates(tickets, updates)
