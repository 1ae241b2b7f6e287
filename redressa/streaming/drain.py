"""Streams over the complaint queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redressa.functions.status import DELEGATED
from redressa.operators.digests import outbox
from redressa.operators.stores import latest_per_ticket
from redressa.plans.delegate import Classifier, delegate_batch, read_complaints, ticket_rows
from redressa.plans.intake import blank_submissions, submit_complaints
from redressa.schemas import CLASSIFIED, MAIL
from redressa.session import materialized, scratch
from redressa.sources.queue import parse_complaints, publish, quarantine
from redressa.sources.tables import read_batch, read_batches, write_batch
from redressa.streaming.late import beside, put_late_aside


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def read_queue(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """JSON message files as a stream of bodies; ``max_files`` bounds a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).withColumnRenamed("value", "body")


def drain(stream: DataFrame, handle, checkpoint: str, output_mode: str = "append", idle_batches: bool = True) -> None:
    """Run ``handle(batch, batch_id)`` over all that is waiting, then stop.

    Offsets are committed after ``handle`` returns: a batch that failed is handled again, so
    nothing is lost, and outputs keyed by the batch id make the repetition harmless. Working tables of a
    batch are removed when it is done. State is kept in RocksDB, with its snapshots beside the offsets, so it is
    not bounded by memory. Without ``idle_batches`` no batch without rows follows to move the state on to the newest
    watermark; that is left to the next rows.
    """

    def scoped(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            handle(batch, batch_id)

    conf = stream.sparkSession.conf
    settings = {STATE_STORE: ROCKS, **({} if idle_batches else {IDLE: "false"})}
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        query = (
            stream.writeStream.foreachBatch(scoped)
            .outputMode(output_mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def store_complaints(folder: str):
    """Handler: keep well-formed complaints, put the rest aside."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(parse_complaints(batch), f"{folder}/complaints", batch_id)
        write_batch(quarantine(batch), f"{folder}/quarantine", batch_id)

    return handle


def fresh_tickets(messages: DataFrame, horizon: str = "30 days") -> DataFrame:
    """A stream of bodies beside the ids of the tickets that have not been delivered before.

    The ids are kept as state for ``horizon`` after their delivery, which has to be longer than the queue may
    take to deliver a message again. Time is that of the delivery, which a replayed batch keeps, so no
    message is too late and none needs a time of its own.
    """
    ids = parse_complaints(messages).select("ticket_id", F.current_timestamp().alias("delivered_ts"))
    fresh = ids.withWatermark("delivered_ts", horizon).dropDuplicatesWithinWatermark(["ticket_id"])
    return beside(fresh.select("ticket_id"), messages.select("body"))


def delegate(folder: str, classify: Classifier, stop_words=None, table=None):
    """Handler of :func:`fresh_tickets`: the delegation batch with its outputs.

    A ticket that an earlier batch has delegated is left out of all outputs, so a message that is
    delivered again mails nobody twice; which these are the stream's state tells, and no earlier output is read.
    The classified frame is written first and read back by the other outputs, so a model is not asked again
    for each of them and all of them agree.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        def written(df: DataFrame, table: str) -> DataFrame:
            write_batch(df, f"{folder}/{table}", batch_id)
            return read_batch(batch.sparkSession, f"{folder}/{table}", batch_id)

        # Written first: the operator with the state runs once.
        both = materialized(batch, "stream-batch")
        messages = both.filter("given IS NOT NULL").select("given.*")
        fresh = both.filter("result IS NOT NULL").select("result.*")
        written(quarantine(messages), "quarantine")
        if fresh.isEmpty():
            received = parse_complaints(messages).limit(0)
        else:
            received = read_complaints(messages, fresh.select("ticket_id"))
        complaints = written(received, "complaints")
        if fresh.isEmpty():  # nothing new has come: no model is asked, the outputs get no row
            classified, mails = (batch.sparkSession.createDataFrame([], schema) for schema in (CLASSIFIED, MAIL))
            written(classified, "classified")
        else:
            classified = written(delegate_batch(complaints, classify, stop_words, table), "classified")
            mails = outbox(classified.join(complaints.select("ticket_id", "complaint_text"), "ticket_id"))
        written(ticket_rows(classified), "tickets")
        written(mails, "outbox")
        written(complaints.withColumn("status", F.lit(DELEGATED)), "store")

    return handle


def read_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """The warehouse over all batches; a message delivered again later counts once."""
    return latest_per_ticket(read_batches(spark, f"{folder}/tickets"), "batch_id")


def submit(folder: str):
    """Handler: submit dialogs to complaint records, stored and put on the queue; submissions without a text put aside.

    Both outputs come from the one written table, so a record is never stored without being
    published.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(blank_submissions(batch), f"{folder}/blank", batch_id)
        write_batch(submit_complaints(batch), f"{folder}/complaints", batch_id)
        written = read_batch(batch.sparkSession, f"{folder}/complaints", batch_id)
        publish(written).write.mode("overwrite").text(f"{folder}/queue/batch_id={batch_id}")

    return handle


def dedupe_stream(complaints: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Drop copies delivered within ``horizon`` of each other.

    Spark also drops rows that arrive later than ``horizon`` behind the newest one, so it must
    be longer than any delivery may be late; :func:`first_complaints` puts those aside. Where no such bound is known,
    :func:`fresh_tickets` goes by the time of delivery.
    """
    return complaints.withWatermark("raised_ts", horizon).dropDuplicatesWithinWatermark(["ticket_id"])


def first_complaints(complaints: DataFrame, horizon: str = "1 day") -> DataFrame:
    """The first delivery of every complaint by :func:`dedupe_stream`, beside all of them; see :func:`store_first`.

    A complaint without a time has no place in the stream's order and is no first delivery.
    """
    return beside(dedupe_stream(complaints.filter("raised_ts IS NOT NULL"), horizon), complaints)


def store_first(folder: str, horizon: str = "1 day"):
    """Handler of :func:`first_complaints`: first deliveries to ``folder``/complaints, those that come too late to ``folder``/late."""
    return put_late_aside(folder, "raised_ts", horizon, lambda first, batch_id: write_batch(first, f"{folder}/complaints", batch_id))
