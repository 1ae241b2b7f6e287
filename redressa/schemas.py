"""Record shapes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _INT = T.StringType(), T.TimestampType(), T.IntegerType()


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


COMPLAINT = record(ticket_id=_S, user_id=_S, order_id=_S, complaint_text=_S, status=_S, timestamp=_S)
TICKET = record(ticket_id=_S, raised_ts=_TS, team_name=_S, severity_level=_INT, status=_S, resolved_ts=_TS)
CLASSIFIED = record(ticket_id=_S, raised_ts=_TS, user_id=_S, team=_S, severity=_INT)
MAIL = record(recipient=_S, subject=_S, page=T.LongType(), body=_S)

CHAT_REQUEST = record(messages=T.ArrayType(record(type=_S, unstructured=record(id=_S, text=_S))))

_CARD = record(imageUrl=_S, name=_S, price=_S, clickAction=_S, buttonLabel=_S)
RESPONSE_MESSAGE = record(
    type=_S,
    unstructured=record(id=_S, text=_S, timestamp=_S, sessionId=_S),
    structured=record(type=_S, text=_S, payload=_CARD),
)
CHAT_RESPONSE = record(messages=T.ArrayType(RESPONSE_MESSAGE))

SLOT = record(value=record(originalValue=_S, interpretedValue=_S, resolvedValues=T.ArrayType(_S)))
SLOTS = T.MapType(_S, SLOT)
_INTENT = record(name=_S, state=_S, slots=SLOTS)
_ATTRIBUTES = T.MapType(_S, _S)
DIALOG_EVENT = record(
    sessionId=_S,
    sessionState=record(intent=_INTENT, sessionAttributes=_ATTRIBUTES),
    requestAttributes=_ATTRIBUTES,
)
DIALOG_ACTION = record(
    sessionState=record(
        dialogAction=record(type=_S, slotToElicit=_S, slots=SLOTS), intent=_INTENT, sessionAttributes=_ATTRIBUTES
    ),
    messages=T.ArrayType(record(contentType=_S, content=_S)),
    requestAttributes=_ATTRIBUTES,
)
