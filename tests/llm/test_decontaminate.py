import hashlib
import random
import re

import pytest

from redressa.llm import decontaminate as dc
from redressa.operators import lookup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out, windows = [], {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    rows = [(i, " ".join(f"t{rng.randrange(40)}" for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "!!"), (103, "The OF and"), (104, "the of and the of and the of and the of and"), (104, "second text"), (7, rows[7][1])]
    return rows


@pytest.fixture(scope="module")
def documents(small_docs, items):
    rng = random.Random(5)
    made = []
    for i in range(60):
        a, b = items[rng.randrange(40)][1].split(), items[rng.randrange(40)][1].split()
        made.append((10_000 + i, f"{rng.random()}, ".join(["", " ".join(a[: rng.randrange(1, 31)]).upper(), "-".join(b)])))
    return [(d, t) for d, t, _ in small_docs if len(t or "") < 100_000] + made


@pytest.mark.parametrize("bound", [None, 0])
def test_same_as_every_window(spark, documents, items, monkeypatch, bound):
    if bound is not None:  # nothing is small enough to be sent to all tasks
        monkeypatch.setattr(dc, "fits_broadcast", lambda df: lookup.fits_broadcast(df, bound))
    docs = spark.createDataFrame([(*r, "x", 1) for r in documents], "doc_id long, text string, term string, pos int").repartition(3)
    got = dc.decontaminate(docs, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, offset int")).collect()
    assert sorted(map(tuple, got), key=str) == brute(documents, items)


def test_proximity(spark):
    docs = dc._keyed(spark.createDataFrame([(1, "x b a c y"), (2, "a q q q b c"), (3, "a b " + "z " * 30 + "c")], "doc_id long, text string"))
    windows = dc.windows_of(spark.createDataFrame([(9, "a b c")], "item_id long, text string"))
    anchors = dc.anchors_of(windows, docs)
    index = dc.postings_of(docs, anchors.select("term"))
    assert {r._id for r in dc.proximity_matches(index, anchors).collect()} == {1, 2}
    assert dc.phrase_matches(index, anchors).count() == 0


def test_empty(spark, no_docs, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.decontaminate(no_docs, items).count() == 0
    assert not any(r.contaminated for r in dc.decontaminate(docs, items.limit(0)).collect())
