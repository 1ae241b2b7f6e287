"""Submitted complaints: chat dialogs to complaint records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.functions.chat import email_of_session, format_time, mint_ticket_id, null_marker, route_intent, slot_value
from redressa.functions.status import NEW
from redressa.functions.text import is_nonblank


def _submitted(events: DataFrame) -> DataFrame:
    """The fields of the events whose intent is routed to submission."""
    intent, slots = F.col("sessionState.intent.name"), F.col("sessionState.intent.slots")
    return events.filter(route_intent(intent) == "submit_complaint").select(
        email_of_session(F.col("sessionId")).alias("user_id"),
        null_marker(slot_value(slots, "order_id")).alias("order_id"),
        slot_value(slots, "complaint_text").alias("complaint_text"),
        "received_ts",
    )


def _has_text() -> F.Column:
    return F.coalesce(is_nonblank(F.col("complaint_text")), F.lit(False))


def submit_complaints(events: DataFrame) -> DataFrame:
    """Complaint records from dialog events (sessionId, sessionState, received_ts) of any intent.

    The ticket id is a hash of what was submitted and when, so a replay mints it again.
    """
    stamp = format_time(F.col("received_ts"))
    return _submitted(events).filter(_has_text()).select(
        mint_ticket_id(F.col("user_id"), F.col("order_id"), F.col("complaint_text"), stamp).alias("ticket_id"),
        "user_id", "order_id", "complaint_text", F.lit(NEW).alias("status"), stamp.alias("timestamp"),
    )


def blank_submissions(events: DataFrame) -> DataFrame:
    """Submissions without a text, which become no record: (user_id, order_id, timestamp)."""
    return _submitted(events).filter(~_has_text()).select("user_id", "order_id", format_time(F.col("received_ts")).alias("timestamp"))
