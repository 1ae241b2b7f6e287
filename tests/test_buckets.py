"""The bucketed store against a dictionary, and its plans."""

import random

import pytest

from redressa.session import work_folder
from redressa.sources import buckets as bk

SCHEMA = "ticket_id string, status string, text string, n int"


def frame(spark, records):
    return spark.createDataFrame([(k, *v) for k, v in records], SCHEMA)


def held(spark, folder):
    return {r.ticket_id: tuple(r)[1:] for r in bk.read_store(spark, folder).collect()}


@pytest.fixture(scope="module")
def filled(spark):
    """A store, its folder and what it should hold, after batches of changes and a compaction among them."""
    rng = random.Random(4)
    folder = work_folder(spark, "buckets")
    want = {f"t{i}": ("new", f"text {i}", i) for i in range(300)}
    bk.create_store(frame(spark, [*want.items(), (None, ("x", "y", 1))]), folder, buckets=4)
    assert held(spark, folder) == want
    for batch in range(4):
        changes = {f"t{rng.randrange(400)}": (rng.choice(["delegated", None]), f"batch {batch}", rng.randrange(9)) for _ in range(50)}
        bk.append_changes(frame(spark, changes.items()), folder, batch)
        if batch == 2:
            bk.append_changes(frame(spark, changes.items()), folder, batch)  # a replay
        want.update(changes)
        assert held(spark, folder) == want
        if batch == 1:
            bk.compact(spark, folder)
            assert held(spark, folder) == want
    return folder, want


def test_changes_and_compaction(spark, filled):
    folder, want = filled
    assert bk._bases(spark, folder) == [-1, 1] and bk._batches(spark, folder) == [0, 1, 2, 3]
    bk.compact(spark, folder)
    assert held(spark, folder) == want and bk._bases(spark, folder) == [-1, 1, 3]
    bk.clean(spark, folder)
    assert bk._bases(spark, folder) == [3] and bk._batches(spark, folder) == [] and held(spark, folder) == want
    bk.append_changes(frame(spark, [("t1", ("resolved", "late", 1)), ("t1", ("resolved", "late", 1))]), folder, 4)
    assert held(spark, folder) == want | {"t1": ("resolved", "late", 1)}


def test_another_session_finds_the_store(spark, filled):
    folder, _ = filled
    before = held(spark, folder)
    for table in spark.catalog.listTables():
        if table.name.startswith("buckets_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert held(spark, folder) == before


def moved_scans(df):
    """The scans of files that stand below an exchange in the plan, and how many exchanges there are."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    moved, count = [], 0
    for i, line in enumerate(lines):
        if "Exchange" in line:
            count += 1
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            moved += [x for x in below if "FileScan" in x]
    return moved, count


def test_the_store_is_not_shuffled(spark, filled):
    folder, want = filled
    for rule in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(rule, "-1")
    try:
        assert moved_scans(bk.read_store(spark, folder)) == ([], 0)
        keys = spark.createDataFrame([("t5",), ("t7",), ("none",)], "ticket_id string")
        asked = bk.records_of(keys, folder)
        moved, count = moved_scans(asked)
        assert not moved and count  # the keys only
        assert {r.ticket_id for r in asked.collect()} == {"t5", "t7"}
    finally:
        for rule in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(rule)


def test_status_updates(spark, filled):
    folder, _ = filled
    before = held(spark, folder)
    updates = spark.createDataFrame([("t5", "resolved", None), ("t6", None, 77), ("none", "resolved", 1)], "ticket_id string, status string, n int")
    bk.change_status(updates, folder, 9)
    want = before | {"t5": ("resolved", *before["t5"][1:]), "t6": (*before["t6"][:2], 77)}
    assert held(spark, folder) == want


def test_empty(spark):
    folder = work_folder(spark, "buckets")
    bk.create_store(frame(spark, []), folder, buckets=2)
    assert held(spark, folder) == {}
    bk.compact(spark, folder)
    bk.append_changes(frame(spark, []), folder, 0)
    assert held(spark, folder) == {}
    bk.append_changes(frame(spark, [("a", (None, None, None))]), folder, 1)
    assert held(spark, folder) == {"a": (None, None, None)}
