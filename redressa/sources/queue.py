"""The complaint queue: JSON message bodies in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redressa.functions.chat import parse_time, session_key
from redressa.functions.status import ticket_key
from redressa.schemas import CHAT_REQUEST, COMPLAINT

CORRUPT = "corrupt"
DRAIN_CAP = 1000
READ_SIZE = 10


def to_body(*columns: str | Column) -> Column:
    """A record as a JSON body; null fields are written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def publish(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return records.select(*keep, to_body(*COMPLAINT.fieldNames()).alias("body"))


def _parsed(messages: DataFrame) -> DataFrame:
    """Adds the record fields. A generated row is not seen through by the optimizer: a filter
    on its fields stays above it, so each body is parsed once and not once more per filter."""
    schema = T.StructType([*COMPLAINT.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return messages.select("*", F.inline_outer(F.array(F.from_json("body", schema, options))))


def _is_good() -> Column:
    return F.col(CORRUPT).isNull() & F.col("ticket_id").isNotNull()


def parse_complaints(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Well-formed bodies as records, ids in lower case; the time is parsed too, as ``raised_ts``."""
    good = _parsed(messages).filter(_is_good()).select(*keep, *COMPLAINT.fieldNames())
    return good.withColumn("ticket_id", ticket_key(F.col("ticket_id"))).withColumn("raised_ts", parse_time(F.col("timestamp")))


def quarantine(messages: DataFrame) -> DataFrame:
    """The other bodies, untouched, to be looked at and put back on the queue."""
    return _parsed(messages).filter(~_is_good()).select(*messages.columns)


def cap_messages(messages: DataFrame, arrival: Sequence[str], cap: int = DRAIN_CAP, read: int = READ_SIZE) -> DataFrame:
    """All messages with ``taken``: whether the next bounded drain takes them, or they stay on the queue.

    A drain takes the oldest messages in whole reads, as long as ``cap`` is not exceeded. Only the
    ``cap`` first keys are put in order; ``arrival`` must tell messages apart.
    """
    if cap < read:
        raise ValueError(f"a drain of {cap} takes no read of {read}")
    first = messages.select(*arrival).orderBy(*arrival).limit(cap // read * read).withColumn("taken", F.lit(True))
    # At most ``cap`` rows.
    return messages.join(F.broadcast(first), list(arrival), "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def parse_chat_envelope(requests: DataFrame, default_sender: str, keep: Sequence[str] = ()) -> DataFrame:
    """Sender and text of a chat request's first message; no message gives a null text."""
    first = F.get(F.from_json("body", CHAT_REQUEST)["messages"], F.lit(0))["unstructured"]
    sender = F.coalesce("id", F.lit(default_sender))
    return requests.select(*keep, F.inline_outer(F.array(first))).select(
        *keep, sender.alias("sender"), session_key(sender).alias("session"), "text"
    )
