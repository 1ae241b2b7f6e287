"""Ticket states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States, teams and the answer used when a complaint cannot be classified.
NEW, DELEGATED, PENDING, RESOLVED = "new", "delegated", "pending", "resolved"
TEAMS = ["Admin", "Developers", "Payments", "Quality Control", "Logistics", "Miscellaneous"]
DEFAULT_TEAM, DEFAULT_SEVERITY = "Miscellaneous", 3


def is_open(status: Column) -> Column:
    """A ticket without a status is neither open nor resolved."""
    return status != RESOLVED


def advance(status: Column) -> Column:
    return F.when(status == DELEGATED, PENDING).otherwise(RESOLVED)


def resolution_stamp(status: Column, as_of: Column) -> Column:
    """``as_of`` is an argument, so that a replayed batch stamps the same time."""
    return F.when(status == RESOLVED, as_of)


def ticket_key(ticket_id: Column) -> Column:
    return F.lower(ticket_id)
