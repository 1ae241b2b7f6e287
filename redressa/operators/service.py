"""Answers to status and resolve requests, and rendering of chat responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.functions.chat import BROKEN_REPLY, NOT_IMPLEMENTED, product_card
from redressa.functions.status import ticket_key
from redressa.operators.lookup import lookup_join
from redressa.session import materialized

# The status text of a missing ticket and of a ticket without a status.
NOT_FOUND, NO_STATUS = "Ticket not found", "No status available"


def _with_key(requests: DataFrame) -> DataFrame:
    return requests.withColumn("key", ticket_key(F.col("ticket_id")))


def _asked(requests: DataFrame, store: DataFrame) -> DataFrame:
    """The store rows somebody asks for, by (key, status); a popular ticket is asked for once.

    Written, so that measuring them and joining them reads the store once.
    """
    keys = _with_key(requests).select("key").distinct()
    return materialized(store.select(F.col("ticket_id").alias("key"), "status").join(keys, "key", "left_semi"))


def status_lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Each request with its ticket's status text and the reply to send."""
    found = _asked(requests, store).withColumn("found", F.lit(True))
    text = F.when(F.col("found").isNull(), NOT_FOUND).otherwise(F.coalesce("status", F.lit(NO_STATUS)))
    reply = F.format_string("Ticket %s has this status: %s.", F.col("ticket_id"), F.col("status_text"))
    return (
        lookup_join(_with_key(requests), found, ["key"], "left")
        .withColumn("status_text", text)
        .withColumn("reply", reply)
        .select(*requests.columns, "status_text", "reply")
    )


def resolve_found(requests: DataFrame, store: DataFrame) -> DataFrame:
    reply = F.format_string("Ticket %s is now resolved.", F.col("ticket_id"))
    found = lookup_join(_with_key(requests), _asked(requests, store).select("key"), ["key"], "left_semi")
    return found.select(*requests.columns, "key", reply.alias("reply"))


def resolve_missing(requests: DataFrame, store: DataFrame) -> DataFrame:
    reply = F.format_string("There is no ticket %s. Please enter the id again.", F.col("ticket_id"))
    missing = lookup_join(_with_key(requests), _asked(requests, store).select("key"), ["key"], "left_anti")
    return missing.select(*requests.columns, "key", reply.alias("reply"))


def flatten_messages(responses: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per message of a chat response: (keep, pos, kind, text, card).

    A response without messages gives one row with the error text.
    """
    exploded = responses.select(*keep, F.posexplode_outer("messages").alias("pos", "message"))
    message = F.col("message")
    kind = (
        F.when(message.isNull(), "error")
        .when(message["type"] == "unstructured", "text")
        .when((message["type"] == "structured") & (message["structured"]["type"] == "product"), "product")
        .otherwise("other")
    )
    text = (
        F.when(F.col("kind") == "error", BROKEN_REPLY)
        .when(F.col("kind") == "text", message["unstructured"]["text"])
        .when(F.col("kind") == "product", message["structured"]["text"])
        .otherwise(NOT_IMPLEMENTED)
    )
    return (
        exploded.withColumn("kind", kind)
        .withColumn("text", text)
        .withColumn("card", F.when(F.col("kind") == "product", product_card(message["structured"]["payload"])))
        .select(*keep, F.coalesce("pos", F.lit(0)).alias("pos"), "kind", "text", "card")
    )
