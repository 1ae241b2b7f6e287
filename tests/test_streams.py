"""Streams with state: life cycles, de-duplication, daily volumes."""

import datetime as dt
import itertools
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from redressa.operators import stores
from redressa.session import run_folder, work_folder
from redressa.sources.tables import read_batches, read_table
from redressa.streaming import drain, lifecycle, volume
from redressa.workload import views
from redressa.workload.queries import QUERIES

START = dt.datetime(2024, 5, 1)
LOG = "key string, ts timestamp, event_id long, event string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run_log(spark, files, horizon="30 days", span_ms=lifecycle.HOUR_MS, folder=None, check=None):
    """Files of (key, minute, event_id, event) as a stream, one file a batch; returns its folder."""
    folder = folder or work_folder(spark, "life")
    for i, rows in enumerate(files):
        frame = spark.createDataFrame([(k, None if m is None else at(m), n, e) for k, m, n, e in rows], LOG)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        log = spark.readStream.schema(LOG).parquet(f"{folder}/in")
        drain.drain(lifecycle.lifecycle_changes(log, horizon, span_ms), lifecycle.store_changes(folder, horizon), f"{folder}/offsets", "update")
        if check:
            check(i, states(spark, folder))
    return folder


def states(spark, folder):
    return {r.key: r.state for r in lifecycle.read_lifecycle(spark, folder).collect()}


def folded(events):
    """Event by event, in order, each once."""
    out = {}
    for key, _, _, event in sorted(set(events), key=lambda e: (e[1], e[2])):
        state = out.get(key)
        if event == "submit":
            state = "new"
        elif state is not None and event == "delegate" and state == "new":
            state = "delegated"
        elif state is not None and event == "advance":
            state = "pending" if state == "delegated" else "resolved"
        elif state is not None and event == "resolve":
            state = "resolved"
        out[key] = state
    return out


def test_states_follow_the_log(spark):
    files = [[("k", 1, 1, "submit"), ("k", 2, 2, "delegate"), ("old", 3, 3, "submit")], [("k", 4, 4, "advance")],
             [("k", 4, 4, "advance"), (None, 5, 9, "submit")], [("k", 6, 5, "submit"), ("z", 7, 6, "resolve"), ("k", None, 7, "resolve")]]
    seen = []

    def check(i, got):
        seen.extend(e for e in files[i] if e[1] is not None)
        assert got == folded(seen)

    folder = run_log(spark, files, check=check)
    assert [r.event_id for r in read_batches(spark, f"{folder}/late").collect()] == [7]


def test_mixed_order_and_second_deliveries(spark):
    rng = random.Random(3)
    events = [(f"k{rng.randrange(6)}", m, m, rng.choice(["submit", "delegate", "delegate", "advance", "advance", "resolve", None])) for m in range(0, 2000, 7)]
    given = events + rng.sample(events, 120)
    rng.shuffle(given)
    folder = run_log(spark, [given[:150], given[150:290], given[290:]])
    assert states(spark, folder) == folded(events)
    schema = spark.createDataFrame([(k, at(m), n, e) for k, m, n, e in given], LOG)
    assert {r.key: r.state for r in stores.lifecycle_state(schema).collect()} == folded(events)
    assert read_batches(spark, f"{folder}/late").count() == 0


def test_closed_spans_and_late_events(spark):
    """Events behind the horizon are put aside; those within it count, also in a span that others have left."""
    files = [
        [("k", 0, 1, "submit"), ("k", 10, 2, "delegate"), ("a", 500, 3, "submit")],
        [("a", 510, 4, "delegate")],
        [("k", 5, 5, "resolve"), ("k", 505, 6, "advance"), ("a", 390, 7, "resolve"), ("a", 502, 8, "advance"), ("a", 510, 4, "delegate")],
        [("k", 506, 9, "advance"), ("a", 2000, 10, "error")],
    ]
    folder = run_log(spark, files, horizon="100 minutes", span_ms=600_000)
    late = sorted(r.event_id for r in read_batches(spark, f"{folder}/late").collect())
    assert late == [5, 7]
    assert states(spark, folder) == folded([e for f in files for e in f if e[2] not in late])


def test_late_rows_without_a_restart(spark):
    """Several files in one run: what Spark drops and what is put aside are the same rows."""
    folder = work_folder(spark, "life")
    rng = random.Random(8)
    files = [[(f"k{rng.randrange(3)}", 300 * i - rng.randrange(0, 1500), 100 * i + n, "submit") for n in range(12)] for i in range(1, 6)]
    for rows in files:
        frame = spark.createDataFrame([(k, at(m), n, e) for k, m, n, e in rows], LOG)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("key", F.col("event_id").cast("string"))
    drain.drain(lifecycle.lifecycle_changes(log, "5 hours", 600_000), lifecycle.store_changes(folder, "5 hours"), f"{folder}/offsets", "update")
    late = {str(r.event_id) for r in read_batches(spark, f"{folder}/late").collect()}
    kept = set(states(spark, folder))
    assert late and not late & kept and len(late | kept) == 60


def test_moves():
    events = ["submit", "delegate", "advance", "resolve"]
    for steps in itertools.product(events, repeat=4):
        move = lifecycle.STAY
        for step in steps:
            move = lifecycle.then(move, lifecycle.MOVES[step])
        want = folded([("k", i, i, e) for i, e in enumerate(steps)])["k"]
        assert lifecycle.STATES[int(move[0])] == want
        half = lifecycle.then(*[lifecycle.then(lifecycle.MOVES[steps[i]], lifecycle.MOVES[steps[i + 1]]) for i in (0, 2)])
        assert half == move


def test_first_complaints_and_late_ones(spark):
    folder = work_folder(spark, "first")
    schema = "ticket_id string, raised_ts timestamp, complaint_text string"
    files = [[("t1", 0), ("t2", 10), ("t1", 0)], [("t2", 10), ("t3", 2000)], [("t4", 5), ("t3", 2000), ("t5", 1990), ("t6", None), ("t1", 0)]]
    for rows in files:
        frame = spark.createDataFrame([(t, None if m is None else at(m), "x") for t, m in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        drain.drain(drain.first_complaints(stream), drain.store_first(folder), f"{folder}/offsets")
    first = sorted(r.ticket_id for r in read_batches(spark, f"{folder}/complaints").collect())
    late = sorted(r.ticket_id for r in read_batches(spark, f"{folder}/late").collect())
    # t1 comes again after the horizon: as late, not as a second first delivery.
    assert first == ["t1", "t2", "t3", "t5"] and late == ["t1", "t4", "t6"]


def test_daily_volume(spark):
    folder = work_folder(spark, "volume")
    day = 24 * 60
    files = [[(5, "a"), (6, "a"), (7, "b"), (day + 1, "a")], [(day + 2, "a"), (2 * day + 60, "b")], [(day - 1, "b")], [(3 * day, None)],
             [(30, "a"), (None, "a"), (2 * day + 70, "b"), (8 * day, None)]]
    for rows in files:
        frame = spark.createDataFrame([(None if m is None else at(m), k) for m, k in rows], "ts timestamp, kind string")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    events = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    drain.drain(volume.daily_volume(events, "12 hours"), volume.store_volume(folder, "12 hours"), f"{folder}/offsets")
    got = {((r.day - START.date()).days, r.kind): r.n for r in volume.read_volume(spark, folder).collect()}
    late = sorted((None if r.ts is None else (r.ts - START).total_seconds() // 60, r.kind) for r in read_batches(spark, f"{folder}/late").collect() if r.ts)
    # Each file is late by the watermark of the batch before the last: the first day is closed when file four is read.
    given = [(m // day, k) for f in files for m, k in f if m is not None and k]
    lost = [(m // day, k) for m, k in late]
    assert late == [(30.0, "a")]
    want = {k: given.count(k) - lost.count(k) for k in given}
    assert got == {k: n for k, n in want.items() if n}
    assert read_batches(spark, f"{folder}/late").filter("ts IS NULL").count() == 1


def test_needed_events_stand_for_all():
    """Whatever comes before, after or between: the events kept give the state that all give."""
    rng = random.Random(5)
    for _ in range(4000):
        times = rng.sample(range(12), rng.randrange(1, 9))
        events = [(at, 0, rng.randrange(4)) for at in times]
        cut, base = rng.randrange(len(events) + 1), rng.randrange(5)
        kept = lifecycle.needed(events[:cut])
        assert lifecycle.needed(kept + events[:1] * (cut > 0)) == kept
        assert lifecycle.state_after(base, lifecycle.needed(kept + events[cut:])) == lifecycle.state_after(base, sorted(events))


def test_a_task_sends_on_few_events_of_a_key(monkeypatch):
    """Those that each key needs, and its newest row, also of a key that is null; in pieces they stand for all."""
    rng = random.Random(7)
    names, long = ["key", "ts", "at", "event_id", "kind"], pa.int64()

    def sent(rows, size):
        kinds = (long if rows[0][0] == 0 else pa.string(), long, long, long, pa.int32())
        table = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), kinds)], names) for i in range(0, len(rows), size)]
        return [tuple(row.values()) for b in lifecycle.drop_needless(iter(table)) for row in b.to_pylist()]

    for _ in range(300):
        rows = [(rng.choice([None, "a", "b"]), at, at, rng.randrange(2), rng.choice([0, 1, 1, 2, 3, None])) for at in rng.choices(range(15), k=rng.randrange(1, 40))]
        monkeypatch.setattr(lifecycle, "HELD", 500_000)
        whole = sent(rows, 7)
        monkeypatch.setattr(lifecycle, "HELD", rng.choice([5, 12]))
        pieces = sent(rows, 3)
        for key in {row[0] for row in rows}:
            own = [row for row in rows if row[0] == key]
            events = lambda given: [row[2:] for row in given if row[0] == key and row[4] is not None]
            want = lifecycle.needed(events(own))
            newest = max(row[2] for row in own)
            assert lifecycle.needed(events(whole)) == want == lifecycle.needed(events(pieces))
            assert set(want) <= set(events(whole)) and len(events(whole)) <= len(want) + 1
            assert max(row[2] for row in whole if row[0] == key) == newest == max(row[2] for row in pieces if row[0] == key)
            # Rows that Spark drops behind the watermark make no difference.
            late = rng.randrange(15)
            assert lifecycle.needed(e for e in events(whole) if e[0] > late) == lifecycle.needed(e for e in events(own) if e[0] > late)
    rows = [(i % 3, i, i, i, (0, 1, 2, 3, 1)[i % 5]) for i in range(30_000)]
    monkeypatch.setattr(lifecycle, "HELD", 10_000)
    assert len(sent(rows, 1000)) < 30


def test_a_key_takes_one_write_a_batch(spark):
    """However many hours a key has events in: it holds the few that matter, in one value."""

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    class Handle:
        timers, value = [], Value()

        def getValueState(self, name, schema):
            return self.value

        def registerTimer(self, at):
            self.timers.append(at)

    state, handle = lifecycle.Lifecycle(), Handle()
    state.init(handle)
    kinds = [0, 1, 2, None, 1, 2, 3, 1] * 2000
    rows = [Row(at=i * 1000 * lifecycle.HOUR_MS, event_id=i, kind=kind) for i, kind in enumerate(kinds)]
    random.Random(2).shuffle(rows)
    assert [r.state for r in state.handleInputRows(("k",), iter(rows), None)] == ["resolved"]
    assert handle.value.calls == 2 and len(handle.timers) == 1 and len(handle.value.held[1]) < 200


def _written_by(spark, query, folder, prefix):
    """Input files and batches of a query's stream, and its rows."""
    before = set(os.listdir(run_folder(spark)))
    rows = sorted(QUERIES[query](spark, folder).collect())
    (made,) = [name for name in os.listdir(run_folder(spark)) if name.startswith(prefix) and name not in before]
    made = f"{run_folder(spark)}/{made}"
    batches = sorted(int(name.split("=")[1]) for name in os.listdir(f"{made}/complaints") if name.startswith("batch_id="))
    return len([name for name in os.listdir(f"{made}/in") if name.endswith(".txt")]), batches, rows


@pytest.fixture
def six_files(spark):
    """A table of documents in six files."""
    folder = work_folder(spark, "given")
    langs = ["en", "de", "fr", "es", None]
    rows = [(i, langs[i % 5], "src", f"text {i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    frame.repartition(6).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", "text of an item")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_a_part_of_the_queue_is_written_by_many_tasks(spark, six_files, monkeypatch):
    monkeypatch.setattr(views, "read_table", lambda spark, folder, name, spread_by=None: read_table(spark, folder, name).repartition(6))
    files, batches, rows = _written_by(spark, "dedupe_stream", six_files, "first-")
    assert files > 12 and batches == [0, 1, 2] and [r.ticket_id for r in rows] == [f"t{i:012d}" for i in range(600)]
    files, batches, rows = _written_by(spark, "dedupe_late", six_files, "late-")
    last = max(i for i in range(600) if i % 5 != 2)
    assert files > 12 and batches == [0, 1, 2]
    assert rows == [(f"t{i:012d}", "late" if i % 5 == 2 and 37 * i <= 37 * last - 3600 else "complaints") for i in range(600)]


def test_a_queue_of_nothing_is_many_files_in_two_batches(spark, six_files, monkeypatch):
    monkeypatch.setattr(views, "read_table", lambda spark, folder, name, spread_by=None: read_table(spark, folder, name).repartition(6))
    files, batches, rows = _written_by(spark, "delegate_nothing", six_files, "nothing-")
    assert files == 6 and batches == [0, 1] and sorted((r.output, r.n) for r in rows)[-2:] == [("store", 0), ("tickets", 0)]
    assert dict((r.output, r.n) for r in rows)["quarantine"] == 600


def test_a_long_queue_takes_few_batches(spark, six_files, monkeypatch):
    monkeypatch.setattr(views, "read_table", lambda spark, folder, name, spread_by=None: read_table(spark, folder, name).repartition(16))
    files, batches, rows = _written_by(spark, "delegate_stream", six_files, "queue-")
    assert files == 48 and batches == [0, 1, 2, 3] and len(rows) == 600
