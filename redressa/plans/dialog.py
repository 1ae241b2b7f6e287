"""Responses to a table of dialog events, as the chat back end gives them turn by turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redressa.functions.chat import FALLBACK, action, map_intent, route_intent, set_slot, slot_value


def set_intent_word(events: DataFrame) -> DataFrame:
    """Dialog events with the model's ``answer`` mapped and stored as the intent_word slot."""
    slots = F.col("sessionState.intent.slots")
    word = map_intent(F.col("answer"))
    return events.withColumn("intent_word", word).withColumn("slots", set_slot(slots, "intent_word", word))


def dialog_actions(events: DataFrame) -> DataFrame:
    """Adds ``action``, the response of each turn.

    Takes (sessionState, requestAttributes, answer) and what the store said: ``found`` and ``status_text``
    of the asked ticket, ``new_ticket_id`` of a submitted complaint, and ``failed`` where it could not be
    reached. ``answer`` is the model's word for a turn that has to branch. The kind of action is chosen
    first and fills one record, which keeps the generated code small.
    """
    intent, slots = F.col("sessionState.intent.name"), F.col("slots")
    ticket = slot_value(slots, "ticket_id")
    handler, kind = F.col("handler"), F.col("kind")
    stored = handler.isin("check_status", "resolve_ticket", "submit_complaint")
    broken = stored & F.coalesce("failed", F.lit(False))
    chosen = (
        F.when(broken, "Close")
        .when((handler == "resolve_ticket") & ~F.col("found"), "ElicitSlot")
        .when(handler != "choose_branch", "Close")
        .when(F.col("intent_word").isNull(), "ElicitIntent")
        .otherwise("Delegate")
    )
    message = (
        F.when(broken, "Your request could not be carried out. Please try again later.")
        .when(kind == "ElicitSlot", "There is no such ticket. Please enter the id again.")
        .when(kind == "ElicitIntent", F.format_string("Going on with %s.", intent))
        .when(kind == "Delegate", F.format_string("Going on with the choice %s.", F.col("intent_word")))
        .when(handler == "check_status", F.format_string("Ticket %s has this status: %s.", ticket, F.col("status_text")))
        .when(handler == "resolve_ticket", F.format_string("Ticket %s is now resolved.", ticket))
        .when(handler == "submit_complaint", F.format_string("Your complaint has been recorded as ticket %s.", F.col("new_ticket_id")))
        .otherwise(FALLBACK)
    )
    delegated = kind == "Delegate"
    response = action(
        kind,
        intent,
        message,
        slot=F.when(kind == "ElicitSlot", "ticket_id"),
        state=F.when(broken, "Failed").when(kind == "Close", "Fulfilled").when(delegated, F.col("sessionState.intent.state")),
        slots=F.when(kind != "Close", slots),
        offered=F.when(delegated, slots),
        attributes=F.when(delegated, F.col("sessionState.sessionAttributes")),
        request=F.when(delegated, F.col("requestAttributes")),
    )
    return (
        set_intent_word(events)
        .withColumn("handler", route_intent(intent))
        .withColumn("kind", chosen)
        .withColumn("action", response)
    )
