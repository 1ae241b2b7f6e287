import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import ODD_TEXTS
from pyspark.sql import functions as F

from redressa.llm import periodic_runs as pr


def brute_runs(w, least=6, times=4):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any((s, x) == (i, length) for s, x, _ in out):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, damage=True):
    o = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, w = len(o), o
    h = zlib.crc32(str(doc_id).encode()) if damage and doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [o[i] if i < a else o[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, x, q in runs for i in range(s + q, s + x)}
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], runs, " ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_of_random_words():
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        words = [rng.randrange(rng.choice([2, 3, 8])) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            part = words[:rng.randrange(1, 8)] or [1]
            words = words + (part * 9)[: rng.randrange(1, 9 * len(part) + 1)] + [rng.randrange(3)] * rng.randrange(8)
        texts.append(words)
    flat = np.array([x for t in texts for x in t], np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.searchsorted(text, np.arange(len(texts)))
    got = pr.runs_of(flat, text)
    for d, words in enumerate(texts):
        mine = got[(text[got[:, 0]] == d)] if len(got) else got
        assert [(int(s - first[d]), int(x), int(q)) for s, x, q in mine] == brute_runs(words), words


@pytest.fixture(scope="module")
def rows(small_docs):
    def bounded(text):  # the brute-force version takes a square of the words
        return text is None or len(text) < 6000

    made = [(i, t) for i, t, *_ in small_docs if bounded(t)]
    made += [(2000 + i, "a b c " * i + "x") for i in range(12)] + [(3000 + i, "one two  three\nfour five\tsix seven eight nine ten eleven twelve " * 2) for i in range(60)]
    return made + [made[3], made[3], (None, "y " * 9)]


def test_same_as_brute_force(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, runs string").repartition(3)
    got = pr.periodic_runs(frame, F.crc32(F.col("doc_id").cast("string"))).withColumn("lines", pr.run_lines(F.col("runs"))).collect()
    mine = [(*tuple(r)[:6], [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(mine, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert all(r.lines == "".join("%d,%d,%d\n" % tuple(x) for x in r.runs) for r in got)


def test_long_texts(spark):
    """Texts beyond the brute-force version: one word over and over, and copies of a long passage."""
    passage = " ".join(f"w{i}" for i in range(5000))
    made = [(i, t) for i, t in ODD_TEXTS if t and len(t) > 100_000] + [(1, " ".join([passage] * 5) + " end"), (2, "z " * 300_000)]
    got = {r.doc_id: r for r in pr.periodic_runs(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (1, 0, 25000, 5000, 5000)
    assert hashlib.md5(got[1].collapsed.encode()).digest() == hashlib.md5((passage + " end").encode()).digest()
    assert tuple(got[2])[1:6] == (1, 0, 300_000, 1, 300_000_000) and got[2].collapsed == "z"
    assert tuple(got[900_006])[1:6] == (1, 0, 120_000, 3, 40_000_000)


def test_empty(no_docs):
    assert pr.periodic_runs(no_docs).count() == 0
