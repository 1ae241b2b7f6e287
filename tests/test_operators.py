"""Skew-safe operators against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from redressa.operators import lookup, packing, stores
from redressa.operators.classify import classify_intent, classify_lexicon
from redressa.operators.digests import first_seen_keys, group_by_key, team_digest, user_digest
from redressa.operators.ledger import read_ledger, score_once
from redressa.operators.lookup import fits_broadcast, lookup_join
from redressa.operators.ordering import with_position
from redressa.operators.predictions import default_predictions, parse_answers, score_prompts, zip_predictions
from redressa.session import work_folder


def skewed(spark, n=3000, hot="hot"):
    """A third of all rows carry one key."""
    draw = random.Random(3)
    rows = [(i, hot if i % 3 == 0 else f"k{draw.randrange(200)}", draw.randrange(10**6)) for i in range(n)]
    draw.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, key string, at long").repartition(8)


@pytest.mark.parametrize("by", [[], ["key"]])
def test_positions(spark, by):
    rows, frame = skewed(spark)
    expected, seen = {}, {}
    for i, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        group = key if by else None
        seen[group] = seen.get(group, 0) + 1
        expected[i] = seen[group]
    got = with_position(frame, ["at", "id"], by)
    assert {r.id: r.position for r in got.collect()} == expected


def test_positions_under_a_null_key(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else "a", i) for i in range(50)], "id long, key string, at long")
    got = {r.id: r.position for r in with_position(frame, ["at"], ["key"]).collect()}
    assert got == {i: i // 2 + 1 for i in range(50)}


def test_positions_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, key string, at long")
    assert with_position(empty, ["at", "id"], ["key"]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("max_rows", [0, 10**6])
def test_lookup_join(spark, how, max_rows):
    _, frame = skewed(spark)
    frame = frame.unionByName(spark.createDataFrame([(-1, None, 0)], frame.schema))
    dim = frame.filter("key is not null").select("key").distinct().filter("key < 'k5' or key = 'hot'")
    dim = dim.withColumn("extra", F.length("key"))
    expected = frame.join(dim, "key", how)
    got = lookup_join(frame, dim, ["key"], how, max_rows)
    assert got.columns == expected.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_lookup_leaves_no_large_task(spark, how):
    """A third of the keys null, a third one key, past the broadcast bound."""
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string"))
    facts = spark.range(30_000).withColumn("key", key).repartition(12)
    dim = facts.filter("key is not null and id % 2 = 0").select("key").distinct().withColumn("extra", F.lit(1))
    joined = lookup_join(facts, dim, ["key"], how, max_rows=0)
    sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == facts.join(dim, "key", how).count()
    assert max(sizes) < 0.2 * sum(sizes)



def test_broadcast_is_measured(spark):
    frame = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 1000))
    assert fits_broadcast(frame) and not fits_broadcast(frame, max_rows=999) and not fits_broadcast(frame, max_bytes=10**6)
    assert fits_broadcast(frame.limit(0))


def greedy(chars, limit, head):
    """Packing by hand: one line after the other."""
    out, batch, item, used = [], 1, 0, head // 4
    for n in chars:
        line = (n + len(str(item + 1)) + 3) // 4
        if item and used + line > limit:
            batch, item, used = batch + 1, 0, head // 4
            line = (n + 4) // 4
        item, used = item + 1, used + line
        out.append((batch, item, line))
    return out


@pytest.mark.parametrize("arrow_rows", [7, 10000])
def test_packing_loses_nothing_and_keeps_order(spark, arrow_rows):
    draw = random.Random(5)
    chars = [draw.choice([0, 3, 40, 150, 399, 2000]) for _ in range(2500)]
    rows = [(f"t{i:05d}", i, n) for i, n in enumerate(chars)]
    frame = spark.createDataFrame(rows, "ticket_id string, at long, chars int").repartition(6)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        runs = packing.with_runs(frame, ["at", "ticket_id"], run_size=1000)
        got = packing.pack_batches(runs, token_limit=200, head_chars=100).orderBy("ticket_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    expected = [(i // 1000, *p) for i in range(0, 2500, 1000) for p in greedy(chars[i:i + 1000], 200, 100)]
    assert [(r.run, r.batch, r.item, r.tokens) for r in got] == expected
    by_batch = {}
    for r in got:
        by_batch.setdefault((r.run, r.batch), []).append(r.tokens)
    assert all(25 + sum(t) <= 200 or len(t) == 1 for t in by_batch.values())


def test_packing_at_the_limit(spark):
    # The head takes 25 tokens; lines of 10, 15 and 1 tokens: the second fits exactly.
    rows = [("a", 0, 1, 37), ("b", 0, 2, 57), ("c", 0, 3, 1)]
    frame = spark.createDataFrame(rows, "ticket_id string, run long, run_position int, chars int")
    got = {r.ticket_id: (r.batch, r.item) for r in packing.pack_batches(frame, 50, 100).collect()}
    assert got == {"a": (1, 1), "b": (1, 2), "c": (2, 1)}


def test_prompts_and_tokens(spark):
    items = spark.createDataFrame([(0, 1, 2, "two", 1), (0, 1, 1, "one", 1), (0, 2, 1, "three", 2)],
                                  "run long, batch int, item int, text string, tokens int")
    prompts = {r.batch: r.prompt for r in packing.build_prompts(items, "Head\n").collect()}
    assert prompts == {1: "Head\n1. one\n2. two\n", 2: "Head\n1. three\n"}
    assert packing.sum_tokens(items, 10).first().asDict() == {"line_tokens": 4, "head_tokens": 20}
    assert len(packing.PROMPT_HEAD) // 4 == 63


def test_answers_are_read_by_number(spark):
    answer = "1. Payments, 4\n\n2. Admin,2\n4.Quality Control , 5\n5. Admin, 9\n6. Admin\nhello\n1. Admin, 1\n99999999999. Admin, 1"
    answers = spark.createDataFrame([(0, 1, answer), (0, 2, None)], "run long, batch int, answer string")
    parsed = parse_answers(answers)
    assert {(r.item, r.team, r.severity) for r in parsed.collect()} == {
        (1, "Payments", 4), (2, "Admin", 2), (4, "Quality Control", 5)
    }
    items = spark.createDataFrame([(f"t{b}{i}", 0, b, i) for b in (1, 2) for i in range(1, 6)],
                                  "ticket_id string, run long, batch int, item int")
    paired = zip_predictions(items, parsed).select("ticket_id", *default_predictions())
    got = {r.ticket_id: (r.team, r.severity) for r in paired.collect()}
    assert got["t11"] == ("Payments", 4) and got["t14"] == ("Quality Control", 5)
    assert got["t13"] == got["t15"] == got["t21"] == ("Miscellaneous", 3) and len(got) == 10


def test_a_failing_call_costs_its_batch_only(spark):
    def connect():
        def score(prompt):
            if "bad" in prompt:
                raise RuntimeError("no answer")
            return "1. Admin, 1", 7
        return score

    prompts = spark.createDataFrame([(0, 1, "good"), (0, 2, "bad"), (0, 3, "good")], "run long, batch int, prompt string")
    rows = {r.batch: r for r in score_prompts(prompts.repartition(2), connect).collect()}
    assert {b: (r.answer, r.tokens_used, r.status) for b, r in rows.items()} == {
        1: ("1. Admin, 1", 7, "ok"), 2: (None, 0, "failed"), 3: ("1. Admin, 1", 7, "ok")
    }
    assert rows[2].error == "RuntimeError: no answer"


def test_a_call_is_repeated_and_bounded_in_time(spark):
    def connect():
        import time

        asked = []

        def score(prompt):
            asked.append(prompt)
            if "slow" in prompt or asked.count(prompt) < 3:
                time.sleep(5 if "slow" in prompt else 0)
                raise RuntimeError("try again")
            return "1. Admin, 1", 7
        return score

    prompts = spark.createDataFrame([(0, 1, "good"), (0, 2, "slow")], "run long, batch int, prompt string")
    rows = {r.batch: r.status for r in score_prompts(prompts.coalesce(1), connect, attempts=3, timeout=0.2).collect()}
    assert rows == {1: "ok", 2: "failed"}


def counting_scorer(folder):
    """Leaves a file behind for every call."""
    def connect():
        import os
        import time
        import uuid

        def score(prompt):
            open(f"{folder}/{uuid.uuid4().hex}-{prompt}", "w").close()
            if "hang" in prompt:
                time.sleep(30)
            if "bad" in prompt and len([f for f in os.listdir(folder) if f.endswith("bad")]) < 4:
                raise RuntimeError("no answer")
            return f"1. Admin, 1 {prompt}", 7

        return score

    return connect


def test_a_hanging_call_holds_up_no_other(spark, tmp_path):
    words = ["ok1", "hang", "ok2", "ok3", "hang2", "ok4"]
    prompts = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "run long, batch int, prompt string").coalesce(1)
    start = time.time()
    rows = {r.batch: r.status for r in score_prompts(prompts, counting_scorer(tmp_path), attempts=2, timeout=0.3, callers=1).collect()}
    assert rows == {0: "ok", 1: "failed", 2: "ok", 3: "ok", 4: "failed", 5: "ok"} and time.time() - start < 25
    calls = sorted(f.name.split("-")[1] for f in tmp_path.iterdir())
    assert calls == sorted(["ok1", "ok2", "ok3", "ok4", "hang", "hang", "hang2", "hang2"])


def test_ledger_asks_nothing_twice(spark, tmp_path):
    ledger = work_folder(spark, "ledger")
    schema = "run long, batch int, prompt string"
    calls = lambda: sorted(f.name.split("-")[1] for f in tmp_path.iterdir())

    def ask(rows):
        answers = score_once(spark.createDataFrame(rows, schema), counting_scorer(tmp_path), ledger, attempts=2)
        return {(r.run, r.batch): (r.answer, r.tokens_used, r.status) for r in answers.collect()}

    first = ask([(0, 1, "a"), (0, 2, "b"), (1, 1, "a"), (1, 2, "bad")])
    assert first == {
        (0, 1): ("1. Admin, 1 a", 7, "ok"), (0, 2): ("1. Admin, 1 b", 7, "ok"), (1, 1): ("1. Admin, 1 a", 0, "known"), (1, 2): (None, 0, "failed")
    }
    assert calls() == ["a", "b", "bad", "bad"]
    # A replay asks only for what had failed; other runs and batches find the answers too.
    again = ask([(0, 1, "a"), (5, 2, "b"), (1, 1, "c"), (1, 2, "bad")])
    assert again == {(0, 1): ("1. Admin, 1 a", 0, "known"), (5, 2): ("1. Admin, 1 b", 0, "known"), (1, 1): ("1. Admin, 1 c", 7, "ok"),
                     (1, 2): ("1. Admin, 1 bad", 7, "ok")}
    assert calls() == ["a", "b", *["bad"] * 4, "c"]
    assert ask([]) == {} and read_ledger(spark, ledger).count() == 4


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_lexicon(spark, broadcast_rows):
    cleaned = spark.createDataFrame(
        [("a", "Pay pay ship"), ("b", "nothing known"), ("c", "ship pay"), ("d", " ".join(["ship"] * 130)), ("e", "")],
        "ticket_id string, cleaned string",
    )
    lexicon = spark.createDataFrame([("pay", "Payments"), ("ship", "Logistics")], "word string, team string")
    got = classify_lexicon(cleaned, lexicon, broadcast_rows=broadcast_rows)
    assert {r.ticket_id: (r.team, r.severity) for r in got.collect()} == {
        "a": ("Payments", 1), "b": ("Miscellaneous", 3), "c": ("Payments", 1), "d": ("Logistics", 5), "e": ("Miscellaneous", 3)
    }


def test_intent_words(spark):
    texts = ["What's the STATUS?", "please close it", "a new problem", "hello", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in frame.select(classify_intent(F.col("x"))).collect()]
    assert got == ["check_status", "resolve_status", "new_complaint", None, None]


def step(state, event):
    if event == "submit":
        return "new"
    if state is None or state == "resolved":
        return state
    if event == "delegate":
        return "delegated" if state == "new" else state
    if event == "advance":
        return "pending" if state == "delegated" else "resolved"
    return "resolved" if event == "resolve" else state


EVENTS = ["submit", "delegate", "advance", "resolve", None]


@pytest.mark.parametrize("max_rows", [0, lookup.BROADCAST_ROWS])
def test_lifecycle_is_the_fold(spark, monkeypatch, max_rows):
    monkeypatch.setattr(lookup.lookup_join, "__defaults__", ("left", max_rows, False))
    draw = random.Random(11)
    log = [(f"k{draw.randrange(400)}" if i % 3 else "hot", i, draw.choices(EVENTS, [1, 3, 3, 1, 1])[0]) for i in range(6000)]
    first, second = {}, {}
    for i, (key, _, event) in enumerate(log):
        if i < 3000:
            first[key] = step(first.get(key), event)
    second.update(first)
    for key, _, event in log[3000:]:
        second[key] = step(second.get(key), event)

    def frame(rows):
        rows = [(k, 0, i, e) for k, i, e in rows]
        return spark.createDataFrame(rows, "key string, ts long, event_id long, event string").repartition(8)

    prior = stores.lifecycle_state(frame(log[:3000]))
    assert {r.key: r.state for r in prior.collect()} == first
    later = {r.key: r.state for r in stores.lifecycle_state(frame(log[3000:]), prior).collect()}
    assert later == {k: second[k] for k in {r[0] for r in log[3000:]}}


def test_minute_markers(spark):
    draw = random.Random(2)
    rows, at = [], 0
    for i in range(2000):
        at += draw.choice([1, 20, 45, 70, 3600, 7200])
        rows.append(("hot" if i % 3 else f"c{i % 5}", at, i))
    shown, expected = {}, {}
    for key, at, i in rows:
        minute = at // 60 % 60
        if shown.get(key) != minute:
            expected[i] = f"{at // 3600 % 24}:{minute}"
        shown[key] = minute
    frame = spark.createDataFrame(rows, "key string, at long, event_id long").select("key", F.timestamp_seconds("at").alias("ts"), "event_id")
    assert {r.event_id: r.label for r in stores.minute_markers(frame).collect()} == expected


def tickets(spark, n=130):
    rows = [(f"t{i:03d}", i, "Admin" if i % 3 else "Payments", i % 5 + 1, f"u{i % 2}", f"text <{i}>") for i in range(n)]
    frame = spark.createDataFrame(rows, "ticket_id string, at long, team string, severity int, user_id string, complaint_text string")
    return frame.withColumn("raised_ts", F.timestamp_seconds(1000 - F.col("at"))).drop("at")


def test_pages_hold_every_ticket_in_arrival_order(spark):
    pages = group_by_key(tickets(spark), "team", page_size=10).orderBy("team", "page").collect()
    admin = [i for r in pages if r.team == "Admin" for i in r.ticket_ids.split(",")]
    assert admin == [f"t{i:03d}" for i in range(129, -1, -1) if i % 3]
    assert max(r.n for r in pages) == 10 and sum(r.n for r in pages) == 130


def test_digests_escape_and_keep_all(spark):
    teams = team_digest(tickets(spark), page_size=50).collect()
    assert sum(r.body.count("<td>t") for r in teams) == 2 * 130  # ids and texts start with t
    assert all("text &lt;" in r.body and "text <" not in r.body for r in teams)
    users = user_digest(tickets(spark), page_size=50).collect()
    assert {(r.user_id, r.page, r.n) for r in users} == {(u, p, n) for u in ("u0", "u1") for p, n in ((1, 50), (2, 15))}


def test_first_seen(spark):
    assert {r.team: r.position for r in first_seen_keys(tickets(spark), "team").collect()} == {"Payments": 1, "Admin": 2}
