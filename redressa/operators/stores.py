"""Ticket store: key-wise reads, upserts, status updates, life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redressa.functions.status import (
    DELEGATED, NEW, PENDING, RESOLVED, advance, is_open, resolution_stamp, ticket_key,
)
from redressa.operators.lookup import lookup_join, take_rows
from redressa.session import materialized


def scan_open(tickets: DataFrame) -> DataFrame:
    return tickets.filter(is_open(F.col("status"))).select("ticket_id", "status")


def batch_get_new(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the asked keys that are still new."""
    wanted = keys.select(ticket_key(F.col("ticket_id")).alias("ticket_id")).distinct()
    return lookup_join(store.filter(F.col("status") == NEW), wanted, ["ticket_id"], "left_semi", unique_facts=True)


def sample_open(tickets: DataFrame, k: int | None = 2, seed: str = "1") -> DataFrame:
    """``k`` open tickets in an order that depends on the seed only, so a retry picks the same; all for None."""
    opened = scan_open(tickets)
    if k is None:
        return opened
    return opened.orderBy(F.md5(F.concat(F.lit(seed), F.col("ticket_id"))), "ticket_id").limit(k)


def advance_status(selected: DataFrame, as_of: F.Column) -> DataFrame:
    """Next state of selected open tickets: (ticket_id, status, resolved_ts)."""
    moved = selected.select("ticket_id", advance(F.col("status")).alias("status"))
    return moved.withColumn("resolved_ts", resolution_stamp(F.col("status"), as_of).cast("timestamp"))


def apply_status_updates(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Tickets with the states in ``updates`` (one row per ticket_id: status, resolved_ts)."""
    changes = updates.select(
        ticket_key(F.col("ticket_id")).alias("ticket_id"),
        F.col("status").alias("_status"),
        F.col("resolved_ts").alias("_resolved_ts"),
    )
    return lookup_join(tickets, changes, ["ticket_id"], "left", unique_facts=True).select(
        *[c for c in tickets.columns if c not in ("status", "resolved_ts")],
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("_resolved_ts", "resolved_ts").alias("resolved_ts"),
    )


def latest_per_ticket(changes: DataFrame, version: str) -> DataFrame:
    """The row of the highest version per ticket, of those with the same version the greatest hash.

    The choice is made on three fields per row, whose partial results are combined before the shuffle. Whole records
    are written once and only the chosen ones are read on; they are neither sorted nor shuffled.
    """
    others = [c for c in changes.columns if c not in ("ticket_id", version)]
    numbers = {"_hash": F.xxhash64(*others) if others else F.lit(0), "_row": F.monotonically_increasing_id()}
    rows = materialized(changes.withColumns(numbers), "changes")
    chosen = rows.groupBy("ticket_id").agg(F.max(F.struct(version, *numbers)).alias("best")).select(F.col("best._row").alias("_row"))
    return take_rows(rows, chosen, "_row").select("ticket_id", version, *others)


def upsert(store: DataFrame, updates: DataFrame, version: str) -> DataFrame:
    """The store with whole records replaced by the newest update of their key.

    Only the keys of the updates meet the store, so a small batch leaves a large store where
    it lies. Updates are taken to be newer than the store.
    """
    untouched = lookup_join(store, updates.select("ticket_id").distinct(), ["ticket_id"], "left_anti", unique_facts=True)
    return untouched.unionByName(latest_per_ticket(updates, version))


def dedupe_tickets(messages: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """One record per ticket: the one with most fields set, of those the newest, then the greatest hash.

    Equal records are one. The choice is made on four numbers per record, combined within each task; they are
    written with the records, so texts are hashed once and only the chosen ones are read on. No text is sorted, nor
    shuffled while the choice, a bit per record, is small enough to be sent to the readers. With ``among``, ids each once,
    only the records of these tickets are chosen.
    """
    others = [c for c in messages.columns if c != "ticket_id"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in others), F.lit(0))
    when = F.coalesce(F.unix_micros("raised_ts"), F.lit(0)) if "raised_ts" in others else F.lit(0)
    numbers = {"_filled": filled, "_when": when, "_hash": F.xxhash64(*others), "_row": F.monotonically_increasing_id()}
    rows = materialized(messages.withColumns(numbers), "received")
    best = rows.groupBy("ticket_id").agg(F.max(F.struct(*numbers)).alias("best"))
    if among is not None:
        best = lookup_join(best, among, ["ticket_id"], "left_semi", unique_facts=True)
    return take_rows(rows, best.select(F.col("best._row").alias("_row")), "_row").select(*messages.columns)


def lifecycle_state(log: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """State of every key after its events: (key, state), null before the first submit.

    Takes (key, ts, event_id, event) with the events submit, delegate, advance and resolve;
    ``prior`` holds (key, state) from earlier events. Folding a key's events one after the
    other would gather a hot key in one task. Only what follows the last submit matters, and
    of that only the first delegate and the first and last advance; so two rounds of partially
    combined aggregates give the same state, also when events are delivered twice.
    """
    event = F.col("event")
    at = F.struct("ts", "event_id")
    keyed = log.select("key", "event", at.alias("at"))
    anchors = keyed.groupBy("key").agg(
        F.max(F.when(event == "submit", F.col("at"))).alias("submitted"),
        F.max(F.when(event == "resolve", F.col("at"))).alias("resolved"),
    )
    if prior is None:
        anchors = anchors.withColumn("before", F.lit(None).cast("string"))
    else:
        anchors = anchors.join(prior.select("key", F.col("state").alias("before")), "key", "left")
    anchors = materialized(anchors)  # one narrow row per key, read three times below
    steps = keyed.filter(event.isin("delegate", "advance"))
    tail = lookup_join(steps, anchors.select("key", "submitted"), ["key"], "inner").filter(
        F.col("submitted").isNull() | (F.col("at") > F.col("submitted"))
    )
    moves = tail.groupBy("key").agg(
        F.min(F.when(event == "delegate", F.col("at"))).alias("delegated"),
        F.min(F.when(event == "advance", F.col("at"))).alias("advanced"),
        F.max(F.when(event == "advance", F.col("at"))).alias("advanced_last"),
    )
    start = F.when(F.col("submitted").isNotNull(), NEW).otherwise(F.col("before"))
    # None, one, or more; an advance that was delivered twice is one.
    advances = F.when(F.col("advanced").isNull(), 0).when(F.col("advanced") == F.col("advanced_last"), 1).otherwise(2)
    # A delegate counts only on a new ticket, so only when no advance came first.
    was_delegated = (start == DELEGATED) | (
        F.col("delegated").isNotNull()
        & (F.col("advanced").isNull() | (F.col("delegated") < F.col("advanced")))
        & (start == NEW)
    )
    state = (
        F.when(start.isNull(), F.lit(None))
        .when(F.col("submitted").isNull() & F.col("resolved").isNotNull(), RESOLVED)
        .when(F.col("resolved") > F.col("submitted"), RESOLVED)
        .when(start == RESOLVED, RESOLVED)
        .when((start == PENDING) & (advances == 0), PENDING)
        .when(start == PENDING, RESOLVED)
        .when(advances == 0, F.when(was_delegated, DELEGATED).otherwise(start))
        .when(was_delegated & (advances == 1), PENDING)
        .otherwise(RESOLVED)
    )
    return anchors.join(moves, "key", "left").select("key", state.alias("state"))


def minute_markers(messages: DataFrame) -> DataFrame:
    """Messages that open a new minute of their conversation: (key, event_id, label).

    Takes (key, ts, event_id). The first message of each clock minute is found by a partially
    combined aggregate; only those firsts, at most one per minute of time, are put in order.
    """
    firsts = messages.groupBy("key", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min(F.struct("ts", "event_id")).alias("first")
    )
    shown = F.lag(F.minute("minute")).over(Window.partitionBy("key").orderBy("minute"))
    return (
        firsts.withColumn("shown", shown)
        .filter(F.col("shown").isNull() | (F.col("shown") != F.minute("minute")))
        .select(
            "key",
            "first.event_id",
            F.concat_ws(":", F.hour("minute").cast("string"), F.minute("minute").cast("string")).alias("label"),
        )
    )
