"""Queue, store, chat and job behaviour on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from redressa.functions import chat
from redressa.operators import lookup, service, stores
from redressa.plans import delegate, dialog, intake, progress
from redressa.schemas import DIALOG_EVENT
from redressa.session import shared_folder, work_folder
from redressa.sources import queue
from redressa.sources.tables import read_batches, write_batch
from redressa.streaming import drain


def body(i, text="hello", **changes):
    record = dict(ticket_id=f"t{i}", user_id="a@b.c", order_id=None, complaint_text=text, status="new",
                  timestamp="2024-01-01 00:00:00")
    return json.dumps({**record, **changes})


def bodies(spark, values):
    return spark.createDataFrame([(v,) for v in values], "body string")


BAD = ["{", body(9)[:-5], "", None, "[]", '{"user_id": "x"}', "import os"]


def test_bad_bodies_are_put_aside_untouched(spark):
    messages = bodies(spark, [body(1), *BAD, body(2, "the word null stays, so does 'None'")])
    good = queue.parse_complaints(messages).orderBy("ticket_id").collect()
    assert [r.ticket_id for r in good] == ["t1", "t2"]
    assert good[1].complaint_text == "the word null stays, so does 'None'" and good[0].order_id is None
    assert sorted(map(str, (r.body for r in queue.quarantine(messages).collect()))) == sorted(map(str, BAD))


def test_published_bodies_keep_nulls_and_read_back(spark):
    records = queue.parse_complaints(bodies(spark, [body(1, "line\nbreak \"q\"")]))
    sent = queue.publish(records).first().body
    assert json.loads(sent)["order_id"] is None and "\n" not in sent
    assert queue.parse_complaints(bodies(spark, [sent])).collect() == records.collect()


def test_chat_envelope(spark):
    sent = [
        {"messages": [{"type": "unstructured", "unstructured": {"id": "a@b@c", "text": "hi"}}]},
        {"messages": [{"type": "unstructured", "unstructured": {"text": "no id"}}]},
        {"messages": []},
    ]
    rows = queue.parse_chat_envelope(bodies(spark, [json.dumps(s) for s in sent] + ["{"]), "unknown").collect()
    assert [(r.sender, r.session, r.text) for r in rows] == [
        ("a@b@c", "a-at-b-at-c", "hi"), ("unknown", "unknown", "no id"), ("unknown", "unknown", None), ("unknown", "unknown", None)
    ]


def test_cap_takes_whole_reads(spark):
    frame = spark.range(100).withColumn("at", -F.col("id"))
    capped = queue.cap_messages(frame, ["at"], cap=25, read=10)
    assert sorted(r.id for r in capped.filter("taken").collect()) == list(range(80, 100))
    assert sorted(r.id for r in capped.filter("not taken").collect()) == list(range(80))
    with pytest.raises(ValueError):
        queue.cap_messages(frame, ["at"], cap=5, read=10)


def test_keys(spark):
    frame = spark.createDataFrame([("a@b@c",)], "x string")
    x = F.col("x")
    row = frame.select(chat.session_key(x), chat.session_key_first(x), chat.email_of_session(chat.session_key(x))).first()
    assert tuple(row) == ("a-at-b-at-c", "a-at-b@c", "a@b@c")


STORE = [("t1", "new"), ("t2", "delegated"), ("t3", "pending"), ("t4", "resolved"), ("t5", None)]


def store(spark):
    return spark.createDataFrame(STORE, "ticket_id string, status string")


def test_status_of_mixed_case_ids(spark):
    asked = spark.createDataFrame([(1, "T1"), (2, "t5"), (3, "t9"), (4, "T1")], "event_id long, ticket_id string")
    got = {r.event_id: r.status_text for r in service.status_lookup(asked, store(spark)).collect()}
    assert got == {1: "new", 2: "No status available", 3: "Ticket not found", 4: "new"}
    assert {r.event_id for r in service.resolve_found(asked, store(spark)).collect()} == {1, 2, 4}
    assert {r.event_id for r in service.resolve_missing(asked, store(spark)).collect()} == {3}


def test_open_tickets_without_status_are_left_out(spark):
    assert {r.ticket_id for r in stores.scan_open(store(spark)).collect()} == {"t1", "t2", "t3"}


def test_progress_stamps_what_it_resolves(spark):
    as_of = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    tickets = store(spark).withColumn("resolved_ts", F.lit(None).cast("timestamp"))
    folder = work_folder(spark, "progress")
    for _ in range(2):  # the second is a replay
        progress.progress(stores.scan_open(tickets), as_of, folder, 0)
    moved = progress.progressed_tickets(tickets, folder)
    got = {r.ticket_id: (r.status, r.resolved_ts is not None) for r in moved.collect()}
    assert got == {"t1": ("resolved", True), "t2": ("pending", False), "t3": ("resolved", True), "t4": ("resolved", False), "t5": (None, False)}
    assert {r.ticket_id: r.status for r in progress.progressed_store(store(spark), folder).collect()} == {k: v[0] for k, v in got.items()}
    progress.progress(stores.scan_open(moved), as_of, folder, 1)
    assert {r.ticket_id: r.status for r in progress.progressed_tickets(tickets, folder).collect()}["t2"] == "resolved"


def test_sample_is_repeatable(spark):
    first = [r.ticket_id for r in stores.sample_open(store(spark), 2, "s").collect()]
    assert len(first) == 2 and first == [r.ticket_id for r in stores.sample_open(store(spark).repartition(5), 2, "s").collect()]
    picks = {tuple(r.ticket_id for r in stores.sample_open(store(spark), 1, str(s)).collect()) for s in range(12)}
    assert len(picks) > 1


def test_user_resolve_twice_is_once(spark):
    as_of = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    tickets = store(spark).withColumn("resolved_ts", F.lit(None).cast("timestamp"))
    keys = spark.createDataFrame([("t1",), ("T1",), ("zz",)], "key string")
    got = progress.resolve(tickets, keys.withColumn("key", F.lower("key")), as_of).collect()
    assert len(got) == 5 and {r.ticket_id for r in got if r.resolved_ts} == {"t1"}


def test_upsert_keeps_one_row_per_key(spark):
    old = store(spark).withColumn("version", F.lit(0))
    new = spark.createDataFrame([("t1", "pending", 1), ("t1", "delegated", 2), ("t7", "new", 1)], old.schema)
    got = {r.ticket_id: r.status for r in stores.upsert(old, new, "version").collect()}
    assert got == {**dict(STORE), "t1": "delegated", "t7": "new"}
    assert stores.upsert(stores.upsert(old, new, "version"), new, "version").count() == 6


def test_dedupe_of_copies(spark):
    one = spark.createDataFrame([("t1", "x", None)] * 500 + [("t2", None, "y")], "ticket_id string, a string, b string")
    assert sorted(map(tuple, stores.dedupe_tickets(one).collect())) == [("t1", "x", None), ("t2", None, "y")]


def test_dedupe_keeps_the_complete_then_the_newest_record(spark):
    rows = [("t1", None, 9), ("t1", "u", 1), ("t1", "v", 3), ("t1", "w", 2), ("t2", None, 5), ("t2", None, 4)]
    frame = spark.createDataFrame(rows, "ticket_id string, user_id string, at long")
    frame = frame.withColumn("raised_ts", F.timestamp_seconds("at"))
    assert {r.ticket_id: (r.user_id, r.at) for r in stores.dedupe_tickets(frame).collect()} == {"t1": ("v", 3), "t2": (None, 5)}
    plan = stores.dedupe_tickets(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan


def event(name, slots, session="a-at-b.c"):
    return {"sessionId": session, "sessionState": {"intent": {"name": name, "state": "InProgress", "slots": slots}}}


def slot(value):
    return {"value": {"originalValue": value, "interpretedValue": value, "resolvedValues": [value]}}


def dialogs(spark, events, extra=""):
    rows = [(json.dumps(e),) for e in events]
    return spark.createDataFrame(rows, "body string").select(F.inline_outer(F.array(F.from_json("body", DIALOG_EVENT))))


def test_submit(spark):
    events = dialogs(spark, [
        event("SubmitComplaint", {"order_id": slot("null"), "complaint_text": slot("broken")}),
        event("SubmitComplaint", {"order_id": slot("7"), "complaint_text": slot("broken")}),
        event("SubmitComplaint", {"order_id": None, "complaint_text": slot(" \t")}),
        event("SubmitComplaint", {"order_id": None, "complaint_text": None}),
        event("CheckComplaintStatus", {"order_id": None, "complaint_text": slot("not a submission")}),
    ]).withColumn("received_ts", F.to_timestamp(F.lit("2024-02-03 04:05:06")))
    got = intake.submit_complaints(events).collect()
    assert [(r.user_id, r.order_id, r.status, r.timestamp) for r in got] == [
        ("a@b.c", None, "new", "2024-02-03 04:05:06"), ("a@b.c", "7", "new", "2024-02-03 04:05:06")
    ]
    assert len({r.ticket_id for r in got}) == 2 and intake.submit_complaints(events).collect() == got
    assert intake.blank_submissions(events).count() == 2


def test_slots(spark):
    frame = dialogs(spark, [event("X", {"a": slot("1"), "b": None}), event("X", None)])
    slots = F.col("sessionState.intent.slots")
    set_a = chat.set_slot(slots, "a", F.lit("2"))
    rows = frame.select(chat.slot_value(slots, "a"), chat.slot_value(slots, "b"), chat.slot_value(slots, "c"),
                        chat.slot_value(set_a, "a"), F.size(set_a)).collect()
    assert [tuple(r) for r in rows] == [("1", None, None, "2", 2), (None, None, None, "2", 1)]


def test_actions(spark):
    names = ["CheckComplaintStatus", "ResolveComplaint", "ResolveComplaint", "SubmitComplaint", "WelcomeIntent", "WelcomeIntent", "Other",
             "SubmitComplaint"]
    frame = dialogs(spark, [event(n, {"ticket_id": slot("T1")}, str(i)) for i, n in enumerate(names)])
    frame = frame.withColumn("found", F.col("sessionId") != "2").withColumn(
        "answer", F.when(F.col("sessionId") == "4", "resolve_status").otherwise("no idea"))
    frame = frame.withColumns({"status_text": F.lit("pending"), "new_ticket_id": F.lit("n1"), "failed": F.col("sessionId") == "7"})
    rows = {r.sessionId: r.action for r in dialog.dialog_actions(frame).select("sessionId", "action").collect()}
    kinds = [rows[str(i)].sessionState.dialogAction.type for i in range(8)]
    assert kinds == ["Close", "Close", "ElicitSlot", "Close", "Delegate", "ElicitIntent", "Close", "Close"]
    assert [rows[i].sessionState.intent.state for i in "037"] == ["Fulfilled", "Fulfilled", "Failed"]
    said = [rows[i].messages[0].content for i in "03"]
    assert said == ["Ticket T1 has this status: pending.", "Your complaint has been recorded as ticket n1."]
    assert rows["4"].sessionState.dialogAction.slots["ticket_id"].value.interpretedValue == "T1"
    assert rows["4"].sessionState.intent.slots["intent_word"].value.interpretedValue == "resolve"
    assert rows["2"].sessionState.dialogAction.slotToElicit == "ticket_id" and rows["0"].sessionState.intent.slots is None


@pytest.mark.parametrize(
    "state, slot_name, messages, reply",
    [
        ("InProgress", "x", [("Card", "c"), ("PlainText", "p")], "p"),
        ("InProgress", "x", [("Card", "c")], "Please enter a value for x."),
        ("InProgress", None, [("Card", "c"), ("PlainText", "p")], "c"),
        ("Fulfilled", "x", [("Card", "c")], "c"),
        ("Fulfilled", "x", [], ""),
        ("Fulfilled", "x", None, ""),
    ],
)
def test_reply(spark, state, slot_name, messages, reply):
    frame = spark.createDataFrame([(state, slot_name, messages)], "s string, x string, m array<struct<contentType:string,content:string>>")
    assert frame.select(chat.derive_reply(F.col("s"), F.col("x"), F.col("m"))).first()[0] == reply


def test_warehouse_filter_and_columns_reach_the_scan(spark):
    folder = work_folder(spark, "scan")
    rows = store(spark).withColumns({"raised_ts": F.lit(None).cast("timestamp"), "team_name": F.lit("Admin")})
    write_batch(rows, folder, 0)
    plan = stores.scan_open(read_batches(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(status,resolved))" in plan and "ReadSchema: struct<ticket_id:string,status:string>" in plan


def put(spark, folder, name, values):
    bodies(spark, values).coalesce(1).write.text(f"{folder}/{name}")


def lexicon(spark):
    return spark.createDataFrame([("pay", "Payments"), ("ship", "Logistics")], "word string, team string")


def test_stream_is_replayed_after_a_failure(spark):
    shared_folder(spark)
    folder = work_folder(spark, "stream")
    put(spark, f"{folder}/in", "a", [body(1, "pay"), body(1, "pay"), body(2, "ship <b>"), "{"])
    classify = delegate.by_lexicon(lexicon(spark))
    handle = drain.delegate(folder, classify)
    source = lambda: drain.fresh_tickets(drain.read_queue(spark, f"{folder}/in/*"))

    def fails_late(batch, batch_id):
        handle(batch, batch_id)
        raise RuntimeError("lost after writing, before the offsets were committed")

    with pytest.raises(Exception):
        drain.drain(source(), fails_late, f"{folder}/offsets")
    drain.drain(source(), handle, f"{folder}/offsets")
    put(spark, f"{folder}/in", "b", [body(3, "what"), body(1, "pay")])  # one of them is delivered again
    drain.drain(source(), handle, f"{folder}/offsets")

    got = {r.ticket_id: (r.team_name, r.severity_level) for r in drain.read_tickets(spark, folder).collect()}
    assert got == {"t1": ("Payments", 1), "t2": ("Logistics", 1), "t3": ("Miscellaneous", 3)}
    assert drain.read_tickets(spark, folder).count() == 3
    assert [r.body for r in read_batches(spark, f"{folder}/quarantine").collect()] == ["{"]
    assert read_batches(spark, f"{folder}/store").count() == 3
    mails = read_batches(spark, f"{folder}/outbox").filter("batch_id = 0").collect()
    again = read_batches(spark, f"{folder}/outbox").filter("batch_id = 1").collect()
    assert not any("t1" in m.body for m in again)
    assert {m.recipient for m in mails} == {"payments@teams.invalid", "logistics@teams.invalid", "a@b.c"}
    assert all("<b>" not in m.body for m in mails)


def test_working_tables_of_a_batch_are_removed(spark):
    import os

    from redressa.session import materialized, run_folder, scratch

    made = []
    with pytest.raises(RuntimeError), scratch(spark):
        made += materialized(store(spark), "outer").inputFiles()
        with scratch(spark):
            made += materialized(store(spark), "inner").inputFiles()
        raise RuntimeError("a batch that fails")
    assert made and not any(os.path.exists(f.removeprefix("file://")) for f in made)
    before = set(os.listdir(run_folder(spark)))
    folder = work_folder(spark, "kept")
    put(spark, f"{folder}/in", "a", [body(1, "pay"), body(2, "ship")])
    source = drain.fresh_tickets(drain.read_queue(spark, f"{folder}/in/*"))
    drain.drain(source, drain.delegate(folder, delegate.by_lexicon(lexicon(spark))), f"{folder}/offsets")
    assert drain.read_tickets(spark, folder).count() == 2
    assert {name.split("-")[0] for name in set(os.listdir(run_folder(spark))) - before} <= {"kept", "changes", "lookup"}


def test_a_submitted_complaint_is_stored_and_published(spark):
    folder = work_folder(spark, "intake")
    events = dialogs(spark, [event("SubmitComplaint", {"order_id": None, "complaint_text": slot("broken")})])
    events = events.withColumn("received_ts", F.to_timestamp(F.lit("2024-02-03 04:05:06")))
    handle = drain.submit(folder)
    handle(events, 0)
    handle(events, 0)
    stored = read_batches(spark, f"{folder}/complaints").drop("batch_id").collect()
    sent = spark.read.text(f"{folder}/queue").selectExpr("value AS body")
    assert len(stored) == 1 and queue.parse_complaints(sent).drop("raised_ts").collect() == stored


def test_watermarked_dedupe(spark):
    folder = work_folder(spark, "dedupe")
    put(spark, f"{folder}/in", "a", [body(i % 3) for i in range(30)])
    stream = queue.parse_complaints(drain.read_queue(spark, f"{folder}/in/*"))
    query = (
        drain.dedupe_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 3


def admin_scorer():
    def connect():
        import re

        def score(prompt):
            numbers = re.findall(r"^(\d+)\. ", prompt, re.MULTILINE)
            return "\n".join(f"{n}. Admin, 2" for n in numbers), len(prompt)

        return score

    return connect


@pytest.mark.parametrize("by_scorer", [False, True])
def test_missing_fields_lose_no_ticket(spark, by_scorer):
    folder = work_folder(spark, "gaps")
    gaps = [body(1, user_id=None), body(2, None), body(3, timestamp=None), body(4, timestamp="soon"), body(5, "")]
    put(spark, f"{folder}/in", "a", gaps)
    classify = delegate.by_scorer(admin_scorer()) if by_scorer else delegate.by_lexicon(lexicon(spark))
    source = drain.fresh_tickets(drain.read_queue(spark, f"{folder}/in/*"))
    drain.drain(source, drain.delegate(folder, classify), f"{folder}/offsets")
    got = drain.read_tickets(spark, folder).collect()
    expected = ("Admin", 2) if by_scorer else ("Miscellaneous", 3)
    assert {(r.ticket_id, r.team_name, r.severity_level) for r in got} == {(f"t{i}", *expected) for i in range(1, 6)}
    mails = read_batches(spark, f"{folder}/outbox").collect()
    assert all(m.body for m in mails) and sum(m.body.count("<tr><td>") for m in mails) == 10


def test_a_replayed_batch_asks_the_model_nothing(spark, tmp_path):
    import re
    import uuid

    def connect():
        def score(prompt):
            (tmp_path / uuid.uuid4().hex).touch()
            return "\n".join(f"{n}. Admin, 2" for n in re.findall(r"^(\d+)\. ", prompt, re.MULTILINE)), len(prompt)

        return score

    folder = work_folder(spark, "asked")
    put(spark, f"{folder}/in", "a", [body(i, f"text {i}") for i in range(3)])
    handle = drain.delegate(folder, delegate.by_scorer(connect, ledger=f"{folder}/ledger"))
    source = lambda: drain.fresh_tickets(drain.read_queue(spark, f"{folder}/in/*"))

    def fails_late(batch, batch_id):
        handle(batch, batch_id)
        raise RuntimeError("lost after writing")

    with pytest.raises(Exception):
        drain.drain(source(), fails_late, f"{folder}/offsets")
    asked = len(list(tmp_path.iterdir()))
    drain.drain(source(), handle, f"{folder}/offsets")
    assert asked == 1 == len(list(tmp_path.iterdir()))
    assert {(r.ticket_id, r.team_name) for r in drain.read_tickets(spark, folder).collect()} == {(f"t{i}", "Admin") for i in range(3)}


def test_nothing_to_do(spark):
    empty = bodies(spark, [])
    received = delegate.read_complaints(empty)
    assert delegate.ticket_rows(delegate.delegate_batch(received, delegate.by_lexicon(lexicon(spark)))).count() == 0


def test_many_tickets_are_chosen_without_a_shuffle_of_their_records(spark):
    """More tickets than a broadcast of their numbers would hold: a bit for each is sent."""
    ids = F.concat(F.lit("t"), (F.col("id") % 510_000).cast("string")).alias("ticket_id")
    given = spark.range(0, 520_000, 1, 7).select(ids, (F.col("id") % 3).alias("order_id"), F.lit("text").alias("complaint_text"))
    once = stores.dedupe_tickets(given)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning" not in plan
    assert once.count() == once.select("ticket_id").distinct().count() == 510_000
    few = stores.dedupe_tickets(given, spark.createDataFrame([("t7",), ("t509999",), ("none",)], "ticket_id string"))
    assert sorted(r.ticket_id for r in few.collect()) == ["t509999", "t7"]


def test_rows_are_taken_by_number(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, (1 << 33), (1 << 33) + 5, (7 << 33) + 40000]
    rows = spark.createDataFrame([(n, f"x{n}") for n in numbers], "_row long, text string")
    for taken in (numbers[::2], numbers[1::3], [], numbers):
        chosen = spark.createDataFrame([(n,) for n in taken], "_row long")
        for limit in (1 << 20, 0):
            assert sorted(r._row for r in lookup.take_rows(rows, chosen, "_row", limit).collect()) == taken
