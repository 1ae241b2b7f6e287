"""Dashboard figures on hand rows: nulls, ties, days without events, empty tables, and the plans."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from redressa.operators import dashboard as db
from redressa.operators.ordering import running_total

TICKETS = "ticket_id string, raised_ts timestamp, team_name string, severity_level int, status string, resolved_ts timestamp"


def day(n, hours=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hours)


@pytest.fixture(scope="module")
def tickets(spark):
    rows = [
        ("t1", day(0), "Admin", 1, "resolved", day(3)), ("t2", day(0, 5), "Admin", 2, "pending", None), ("t3", day(40), "Admin", 1, "new", None),
        ("t4", day(2), None, 1, "resolved", day(2, 1)), ("t5", day(2), None, None, None, None), ("t6", None, "Admin", 5, "pending", None),
        ("t8", day(0), "Admin", 1, "delegated", None), ("t7", day(0), "Admin", 1, "delegated", None),
    ]
    return spark.createDataFrame(rows, TICKETS)


def test_backlog(tickets):
    got = {(r.team_name, (r.day - dt.date(2024, 1, 1)).days): (r.opened, r.closed, r.open) for r in db.open_backlog(tickets).collect()}
    assert len(got) == 41 + 39
    assert got["Admin", 0] == (4, 0, 4) and got["Admin", 3] == (0, 1, 3) and got["Admin", 39] == (0, 0, 3) and got["Admin", 40] == (1, 0, 4)
    assert got[None, 2] == (2, 1, 1) and got[None, 40] == (0, 0, 1)


def test_backlog_sums_no_window_over_all_rows(tickets):
    plan = db.open_backlog(tickets)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(60), rng.randrange(9) - 4) for _ in range(500)]
    frame = spark.createDataFrame(rows, "k string, o int, v long")
    got = running_total(frame, "v", "o", ["k"], (F.col("o") / 7).cast("int"), "s").collect()
    assert len(got) == 500
    assert all(r.s == sum(v for k, o, v in rows if k == r.k and o <= r.o) for r in got)


def resolved(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        raised = day(rng.randrange(5))
        team = rng.choice(["Admin", "Admin", "Payments", None])
        rows.append((f"t{i}", raised, team, 1, "resolved", raised + dt.timedelta(seconds=rng.choice([rng.randrange(100_000), 60]))))
    return rows, spark.createDataFrame(rows, TICKETS)


def test_resolve_times(spark, tickets):
    assert {r.team_name: tuple(r)[1:] for r in db.resolve_times(tickets).collect()} == {
        "Admin": (1, 259200.0, 259200.0, 259200.0), None: (1, 3600.0, 3600.0, 3600.0)
    }
    rows, frame = resolved(spark, 301)
    got = {r.team_name: r for r in db.resolve_times(frame).collect()}
    for team in ("Admin", "Payments", None):
        times = sorted((r[5] - r[1]).total_seconds() for r in rows if r[2] == team)
        assert got[team].n == len(times) and got[team].mean_s == pytest.approx(statistics.fmean(times))
        assert got[team].p50_s == pytest.approx(statistics.median(times))
        rank = 0.95 * (len(times) - 1)
        low = int(rank)
        assert got[team].p95_s == pytest.approx(times[low] + (times[low + 1] - times[low]) * (rank - low), abs=1e-3)


def test_sketches_merge(spark):
    rows, frame = resolved(spark, 3000)
    states = db.resolve_states(frame, 200)
    early, late = states.filter("day < '2024-01-03'"), states.filter("day >= '2024-01-03'")
    for team, n, mean, p50, p95 in db.merged_times(early.unionByName(late), ["team_name"], size=200).collect():
        times = [(r[5] - r[1]).total_seconds() for r in rows if r[2] == team]
        assert n == len(times) and mean == pytest.approx(statistics.fmean(times))
        for answer, share in ((p50, 0.5), (p95, 0.95)):
            below, upto = (sum(f(t, answer) for t in times) / n for f in (lambda a, b: a < b, lambda a, b: a <= b))
            assert below <= share + 0.03 and upto >= share - 0.03


def test_drift(spark):
    schema = "k string, a string, b int, extra int"
    left = spark.createDataFrame([("1", "x", 1, 7), ("2", "x", None, 7), ("3", None, None, 7), ("4", "x", 2, 7), ("5", None, 3, 7), (None, "x", 1, 7)], schema)
    right = spark.createDataFrame([("1", "x", 1, 8), ("2", "x", None, 8), ("3", "y", 0, 8), ("4", "x", 3, 8), ("6", None, None, 8)], schema)
    got = {tuple(r) for r in db.drift(left, right, "k", ["a", "b"]).collect()}
    assert got == {("3", "both", "a,b"), ("4", "both", "b"), ("5", "left only", ""), ("6", "right only", "")}
    assert db.drift(left, left, "k", ["a", "b"]).count() == 0
    # A null and a value side by side are not the same as the other way round.
    swapped = spark.createDataFrame([("1", None, "z"), ("2", "z", None)], "k string, a string, c string")
    other = spark.createDataFrame([("1", "z", None), ("2", "z", None)], "k string, a string, c string")
    assert [tuple(r) for r in db.drift(swapped, other, "k", ["a", "c"]).collect()] == [("1", "both", "a,c")]


def test_drift_of_long_fields(spark):
    left = spark.range(10).selectExpr("CAST(id AS STRING) AS k", "repeat('x', 100) AS text")
    got = db.drift(left, left.withColumn("text", F.concat("text", F.when(F.col("k") == "3", "y").otherwise(""))), "k", ["text"]).collect()
    assert [tuple(r) for r in got] == [("3", "both", "text")]


def test_funnel(spark):
    log = [("a", 0, "submit"), ("a", 1, "delegate"), ("a", 3, "advance"), ("b", 5, "delegate"), ("b", 6, "submit"), ("b", 7, "advance"),
           ("c", 2, "submit"), ("c", 2, "delegate"), ("c", 9, "resolve"), (None, 1, "submit"), ("d", 1, "other")]
    rows = [(k, day(0, h), n, e) for n, (k, h, e) in enumerate(log)]
    got = db.funnel(spark.createDataFrame(rows, "key string, ts timestamp, event_id long, event string"), ["submit", "delegate", "advance"])
    assert [tuple(r) for r in got.orderBy("step_no").collect()] == [(1, "submit", 3, None), (2, "delegate", 2, 1800.0), (3, "advance", 1, 7200.0)]


def test_subtotals(tickets):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in db.team_severity(tickets).collect()}
    assert got[None, None, 3] == (8, 5, 2) and got["Admin", None, 1] == (6, 5, 1) and got[None, None, 1] == (2, 0, 1)
    assert got[None, None, 0] == (1, 0, 0) and got["Admin", 1, 0] == (4, 3, 1)


def test_oldest_open(tickets):
    got = [tuple(r)[:2] + (r.place,) for r in db.oldest_open(tickets, 2).collect()]
    assert sorted(got) == [("Admin", "t7", 1), ("Admin", "t8", 2)]
    plan = db.oldest_open(tickets, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    assert "WindowGroupLimit" in plan


def test_empty(tickets):
    none = tickets.limit(0)
    for made in (db.open_backlog(none), db.resolve_times(none), db.merged_times(db.resolve_states(none), ["team_name"]), db.oldest_open(none)):
        assert made.count() == 0
    log = none.select(F.col("ticket_id").alias("key"), F.col("raised_ts").alias("ts"), F.lit(1).alias("event_id"), F.col("status").alias("event"))
    assert [r.reached for r in db.funnel(log, ["submit", "resolve"]).collect()] == [0, 0]
    assert db.drift(none, none, "ticket_id", ["status"]).count() == 0
