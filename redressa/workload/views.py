"""Complaint, chat and event tables derived from the given tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redressa.functions.chat import format_time, session_key, slot_struct
from redressa.functions.status import TEAMS
from redressa.functions.text import collapse_whitespace, remove_special_characters
from redressa.plans.delegate import by_lexicon, clean
from redressa.schemas import CHAT_RESPONSE, DIALOG_EVENT, RESPONSE_MESSAGE, SLOTS
from redressa.session import materialized
from redressa.sources.queue import publish
from redressa.sources.tables import read_table

EPOCH = 1704067200  # 2024-01-01


def _ticket_id(number: str) -> Column:
    return F.concat(F.lit("t"), F.lpad(F.col(number).cast("string"), 12, "0"))


def _mail(number: Column) -> Column:
    return F.concat(F.lit("user"), number.cast("string"), F.lit("@example.com"))


def complaints(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Documents as complaints; every fifth has no order. ``spread`` is for work on the text."""
    raised = F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 37)
    return read_table(spark, folder, "documents", "doc_id" if spread else None).select(
        "doc_id",
        "lang",
        _ticket_id("doc_id").alias("ticket_id"),
        _mail(F.col("doc_id") % 97).alias("user_id"),
        F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("order_id"),
        F.col("text").alias("complaint_text"),
        F.lit("new").alias("status"),
        format_time(raised).alias("timestamp"),
        raised.alias("raised_ts"),
    )


def store(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints in all states; some records have no status."""
    states = F.array(*[F.lit(s) for s in ("new", "delegated", "pending", "resolved")])
    state = F.when(F.col("doc_id") % 29 != 0, F.get(states, (F.col("doc_id") % 4).cast("int")))
    return complaints(spark, folder).withColumn("status", state)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints as queue bodies; English ones come twice, German ones also with a copy that was cut short."""
    bodies = publish(complaints(spark, folder, spread=True), keep=["doc_id", "lang"])
    cut = bodies.filter(F.col("lang") == "de").withColumn("body", F.expr("substring(body, 1, length(body) - 7)"))
    return bodies.unionByName(bodies.filter(F.col("lang") == "en")).unionByName(cut)


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the benchmark items; the team follows from the length of the word."""
    text = F.lower(remove_special_characters(collapse_whitespace(F.col("text"))))
    words = read_table(spark, folder, "benchmark").select(F.explode(F.split(text, " ")).alias("word"))
    team = F.get(F.array(*[F.lit(t) for t in TEAMS]), F.length("word") % len(TEAMS))
    return words.filter(F.col("word") != "").distinct().withColumn("team", team)


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """(ticket_id, raised_ts, user_id, team, severity) of all complaints."""
    return by_lexicon(lexicon(spark, folder))(clean(complaints(spark, folder, spread=True)))


def written_classified(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once, for work that reads it more than once."""
    return materialized(classified(spark, folder))


def classified_texts(spark: SparkSession, folder: str) -> DataFrame:
    return written_classified(spark, folder).join(complaints(spark, folder).select("ticket_id", "complaint_text"), "ticket_id")


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    """The warehouse: classified complaints in the states of the store."""
    state = store(spark, folder).select("ticket_id", "status", "doc_id")
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") % 240).cast("int"))
    return classified(spark, folder).join(state, "ticket_id").select(
        "ticket_id",
        "raised_ts",
        F.col("team").alias("team_name"),
        F.col("severity").alias("severity_level"),
        "status",
        F.when(F.col("status") == "resolved", F.col("raised_ts") + hours).alias("resolved_ts"),
    )


def events(spark: SparkSession, folder: str, spread_by: str | None = None) -> DataFrame:
    return read_table(spark, folder, "events", spread_by).withColumn("ts", F.col("ts").cast("timestamp"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests about a ticket, its id in upper case; most ids do not exist."""
    return events(spark, folder).select("event_id", "ts", "event_type", F.upper(_ticket_id("event_id")).alias("ticket_id"))


def resolve_requests(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).filter(F.col("event_type") == "purchase").select("event_id", "ticket_id")


def ticket_log(log: DataFrame) -> DataFrame:
    """Events as the life of one ticket per user."""
    names = {"signup": "submit", "click": "delegate", "view": "advance", "purchase": "resolve"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    return log.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                      event.alias("event"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations")


def chat_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as chat request bodies; system turns have no sender."""
    sender = F.when(F.col("role") != "system", _mail(F.col("conv_id")))
    unstructured = F.struct(sender.alias("id"), "text")
    message = F.struct(F.lit("unstructured").alias("type"), unstructured.alias("unstructured"))
    body = F.to_json(F.struct(F.array(message).alias("messages")))
    return turns(spark, folder).select("conv_id", "turn", body.alias("body"))


def chat_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to turns: text to users, a card and a carousel to the assistant, nothing to the system."""
    none = F.lit(None)
    text = F.struct(
        F.lit("unstructured").alias("type"),
        F.struct(F.lit("user1").alias("id"), F.col("text").alias("text"), F.lit("").alias("timestamp"),
                 session_key(_mail(F.col("conv_id"))).alias("sessionId")).alias("unstructured"),
        none.alias("structured"),
    ).cast(RESPONSE_MESSAGE)
    payload = F.struct(
        F.lit("/p.png").alias("imageUrl"), F.col("text").alias("name"),
        F.col("turn").cast("string").alias("price"), F.lit("buy").alias("clickAction"), F.lit("Buy").alias("buttonLabel"),
    )
    card = F.struct(
        F.lit("structured").alias("type"), none.alias("unstructured"),
        F.struct(F.lit("product").alias("type"), F.lit("For you").alias("text"), payload.alias("payload")).alias("structured"),
    ).cast(RESPONSE_MESSAGE)
    carousel = F.struct(F.lit("carousel").alias("type"), none.alias("unstructured"), none.alias("structured")).cast(RESPONSE_MESSAGE)
    answer = (
        F.when(F.col("role") == "user", F.array(text))
        .when(F.col("role") == "assistant", F.array(text, card, carousel))
        .otherwise(F.array().cast(T.ArrayType(RESPONSE_MESSAGE)))
    )
    body = F.to_json(F.struct(answer.alias("messages")))
    return turns(spark, folder).select("conv_id", "turn", F.from_json(body, CHAT_RESPONSE)["messages"].alias("messages"))


INTENT_OF_EVENT = {
    "view": "CheckComplaintStatus",
    "purchase": "ResolveComplaint",
    "signup": "SubmitComplaint",
    "click": "WelcomeIntent",
    "error": "OtherIntent",
}


def dialog_events(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as dialog JSON, read back: errors come with an empty ticket slot."""
    kind = F.col("event_type")
    name = F.coalesce(*[F.when(kind == k, v) for k, v in INTENT_OF_EVENT.items()])
    slot = F.when(kind != "error", slot_struct(F.upper(_ticket_id("event_id"))))
    body = F.to_json(
        F.struct(
            session_key(_mail(F.col("user_id"))).alias("sessionId"),
            F.struct(
                F.struct(
                    name.alias("name"), F.lit("InProgress").alias("state"),
                    F.create_map(F.lit("ticket_id"), slot, F.lit("intent_word"), F.lit(None)).cast(SLOTS).alias("slots"),
                ).alias("intent"),
                F.create_map(F.lit("lang"), F.lit("en")).alias("sessionAttributes"),
            ).alias("sessionState"),
        ),
        {"ignoreNullFields": "false"},
    )
    answers = {0: "check_status", 1: "resolve_status", 2: "new_complaint"}
    answer = F.coalesce(*[F.when(F.col("user_id") % 4 == k, v) for k, v in answers.items()], F.lit("no idea"))
    parsed = F.inline_outer(F.array(F.from_json(body, DIALOG_EVENT)))
    return events(spark, folder, "event_id").select("event_id", answer.alias("answer"), parsed)


def submit_dialogs(spark: SparkSession, folder: str, blank_first: bool = False) -> DataFrame:
    """All turns as dialogs: users submit, the assistant checks, the system is welcomed; a first turn has no order."""
    text = F.when(F.col("turn") == 0, F.lit(" \t")).otherwise(F.col("text")) if blank_first else F.col("text")
    order = F.when(F.col("turn") == 0, "null").otherwise(F.col("conv_id").cast("string"))
    received = F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 600 + F.col("turn"))
    slots = F.create_map(F.lit("order_id"), slot_struct(order), F.lit("complaint_text"), slot_struct(text))
    intent = F.when(F.col("role") == "user", "SubmitComplaint").when(F.col("role") == "assistant", "CheckComplaintStatus")
    return turns(spark, folder).select(
        session_key(_mail(F.col("conv_id"))).alias("sessionId"),
        F.struct(F.struct(F.coalesce(intent, F.lit("WelcomeIntent")).alias("name"), slots.alias("slots")).alias("intent")).alias("sessionState"),
        received.alias("received_ts"),
    )


def word_count_scorer():
    """A test double for a remote model: answers by the number of words, with the faults models have."""
    teams = list(TEAMS)

    def connect():
        import re

        def score(prompt: str) -> tuple[str, int]:
            answers = []
            for number, text in re.findall(r"^(\d+)\. (.*)$", prompt, re.MULTILINE):
                n = len(text.split())
                severity = 9 if n % 41 == 0 else 1 + n % 5
                separator = "," if n % 37 == 0 else ", "
                if n % 31 != 0:
                    answers.append(f"{number}. {teams[n % 6]}{separator}{severity}")
            return "\n".join(answers), len(prompt) // 4

        return score

    return connect
