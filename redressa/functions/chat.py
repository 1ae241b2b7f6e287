"""Column functions for chat and dialog records."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from redressa.functions.text import escape_html
from redressa.schemas import SLOTS

# Intents of the dialog, the words a model may answer, the slot words they map to.
INTENT_HANDLERS = {
    "CheckComplaintStatus": "check_status",
    "ResolveComplaint": "resolve_ticket",
    "SubmitComplaint": "submit_complaint",
    "WelcomeIntent": "choose_branch",
}
INTENT_WORDS = {"check_status": "check", "resolve_status": "resolve", "new_complaint": "new"}
AT_MARK = "-at-"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

FALLBACK = "I did not get that. Could you say it another way?"
BROKEN_REPLY = "The answer did not arrive. Please send your message once more."
NOT_IMPLEMENTED = "unsupported message"


def _literal_map(items: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(items.items())])


def session_key(email: Column) -> Column:
    """E-mail address as a session key: every at-sign is rewritten."""
    return F.replace(email, F.lit("@"), F.lit(AT_MARK))


def session_key_first(email: Column) -> Column:
    """The sign-in form of the key: only the first at-sign is rewritten."""
    return F.regexp_replace(email, "^([^@]*)@", f"$1{AT_MARK}")


def email_of_session(session: Column) -> Column:
    return F.replace(session, F.lit(AT_MARK), F.lit("@"))


def null_marker(value: Column) -> Column:
    return F.nullif(value, F.lit("null"))


def mint_ticket_id(*parts: Column) -> Column:
    """A ticket id that comes out the same when a batch is replayed."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def mint_session_id(started: Column, *parts: Column) -> Column:
    stamp = F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(stamp, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10))


def format_time(ts: Column) -> Column:
    return F.date_format(ts, TIMESTAMP_FORMAT)


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT))


def map_intent(word: Column) -> Column:
    """The slot word for a model's answer; null for an answer that is not on the list."""
    return F.try_element_at(_literal_map(INTENT_WORDS), word)


def route_intent(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(INTENT_HANDLERS), name), F.lit("fallback"))


def slot_value(slots: Column, name: str) -> Column:
    """The interpreted value of a slot; null when the slot is absent or empty."""
    return F.try_element_at(slots, F.lit(name))["value"]["interpretedValue"]


def slot_struct(value: Column) -> Column:
    return F.struct(
        F.struct(
            value.alias("originalValue"), value.alias("interpretedValue"), F.array(value).alias("resolvedValues")
        ).alias("value")
    )


def set_slot(slots: Column, name: str, value: Column) -> Column:
    """Slots with ``name`` set; an earlier value is replaced."""
    others = F.map_filter(slots, lambda k, _: k != F.lit(name))
    added = F.create_map(F.lit(name), slot_struct(value))
    return F.when(slots.isNull(), added).otherwise(F.map_concat(others, added))


def plain_message(text: Column) -> Column:
    return F.array(F.struct(F.lit("PlainText").alias("contentType"), text.alias("content")))


def action(kind: Column, intent: Column, message: Column, slot: Column, state: Column, slots: Column,
           offered: Column, attributes: Column, request: Column) -> Column:
    """One response record; every kind of action has the same fields, so one table holds them all.

    ``slots`` go back with the intent, ``offered`` with the action itself.
    """
    return F.struct(
        F.struct(
            F.struct(kind.alias("type"), slot.alias("slotToElicit"), offered.cast(SLOTS).alias("slots")).alias("dialogAction"),
            F.struct(intent.alias("name"), state.alias("state"), slots.cast(SLOTS).alias("slots")).alias("intent"),
            attributes.alias("sessionAttributes"),
        ).alias("sessionState"),
        plain_message(message).alias("messages"),
        request.alias("requestAttributes"),
    )


def derive_reply(state: Column, slot: Column, messages: Column) -> Column:
    """What the user sees: the slot prompt while a slot is asked for, else the first message."""
    plain = F.get(F.filter(messages, lambda m: m["contentType"] == "PlainText"), F.lit(0))["content"]
    asked = F.format_string("Please enter a value for %s.", slot)
    first = F.coalesce(F.get(messages, F.lit(0))["content"], F.lit(""))
    return F.when((state == "InProgress") & slot.isNotNull(), F.coalesce(plain, asked)).otherwise(first)


def product_card(payload: Column) -> Column:
    """A product card as HTML; every value is escaped."""
    value = lambda name: escape_html(F.coalesce(payload[name], F.lit("")))
    return F.concat(
        F.lit('<figure><img src="'), value("imageUrl"), F.lit('"/><figcaption>'), value("name"),
        F.lit(" ($"), value("price"), F.lit(')</figcaption><button data-action="'), value("clickAction"),
        F.lit('">'), value("buttonLabel"), F.lit("</button></figure>"),
    )
