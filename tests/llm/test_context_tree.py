import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import remainder

from redressa.llm import context_tree as ct
from redressa.llm.common import table
from redressa.llm.words import words_of


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def stream(text):
    return b" ".join(fold(text)) + b"\n"


class Brute:
    """The same tree as nested dictionaries, one decision at a time."""

    def __init__(self, texts):
        self.n, self.below = Counter(), {}
        for t in texts:
            for context, node, bit in self.steps(stream(t)):
                for d in range(ct.DEPTH + 1):
                    self.n[context[:d], node, bit] += 1
                    if d:
                        self.below.setdefault((context[:d - 1], node), set()).add(context[:d])
        self.memo = {}

    @staticmethod
    def steps(data):
        data = b"\n" * ct.DEPTH + data
        for i in range(ct.DEPTH, len(data)):
            context, byte = data[i - ct.DEPTH:i][::-1], data[i]
            for k in range(8):
                yield context, (1 << k) | byte >> (8 - k), (byte >> (7 - k)) & 1

    def kt(self, context, node):
        a, b = self.n[context, node, 0], self.n[context, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, node):
        key = context, node
        if key not in self.memo:
            own = self.kt(context, node)
            if len(context) == ct.DEPTH:
                self.memo[key] = own, None
            else:
                longer = sum(self.weighted(c, node)[0] for c in self.below[key])
                self.memo[key] = np.logaddexp(own, longer) - math.log(2), 1 / (1 + math.exp(min(700, longer - own)))
        return self.memo[key]

    def score(self, text):
        total = 0.0
        for context, node, bit in self.steps(stream(text)):
            chance = None
            for d in range(ct.DEPTH, -1, -1):
                c = context[:d]
                n = self.n[c, node, 0] + self.n[c, node, 1]
                if n:
                    own = (self.n[c, node, bit] + 0.5) / (n + 1)
                    w = self.weighted(c, node)[1]
                    chance = own if chance is None else w * own + (1 - w) * chance
            total += math.log10(0.5 if chance is None else chance)
        return total


@pytest.fixture(scope="module")
def rows(small_docs):
    return [(d, t) for d, t, _ in small_docs if len(t or "") < 1500][:45] + [(d, t) for d, t, _ in small_docs if d is None or d > 900_007]


@pytest.fixture(scope="module")
def got(spark, rows):
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, grp int, score string").repartition(3)
    return ct.language_model(frame).collect()


def test_tree_is_the_brute_force_one(rows, got):
    brute = Brute([t for d, t in rows if d is None or remainder(d, 10)])
    want = sorted((str(d), round(brute.score(t), 5)) for d, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in got) == want


def test_word_model(rows, got):
    count = Counter()
    for d, t in rows:
        if d is None or remainder(d, 10):
            count.update([*fold(t), None])
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        words = [*fold(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        held = d is not None and remainder(d, 10) == 0
        want.append((str(d), held, len(words), sum(count[w] > 0 for w in words), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)


def test_chances_sum_to_one():
    keys, _ = ct.serial(words_of(pa.array(["the cat sat on the mat", "a cat", ""]), lower=True))
    own, counts = np.unique(keys, return_counts=True)
    levels = ct.deep_levels(own, counts)
    while len(levels) <= ct.DEPTH:
        levels.append(ct._level(*ct._up(levels[-1])))
    for context in (own[0], own[5], np.uint64(0x7A7A7A7A7A00)):
        every = (context >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** ct.chances(every, levels)).sum() - 1) < 1e-9


def test_beats_the_word_model_on_held_out_text(spark):
    rows = [r for r in ct.language_model(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert len(rows) > 60 and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 and r.bits_per_byte < 8 for r in rows)


def test_questions_of_many_groups(spark, rows, got, monkeypatch):
    """Groups beyond what one task answers ask a copy of the model's part."""
    monkeypatch.setattr(ct, "ANSWERED", 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "false AS held_out")
    learnt = frame.filter("doc_id IS NULL OR crc32(CAST(doc_id AS STRING)) % 10 <> 0")
    scored = ct.score(frame, ct.fit(learnt), groups=7).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in scored) == sorted((str(r.doc_id), round(r.score, 6)) for r in got)


def test_empty(no_docs):
    assert ct.language_model(no_docs).count() == 0


def test_keys_of_bytes_take_little_memory():
    """Also where texts are short, empty or null, each byte has its own text's bytes before it and line ends before those."""
    given = [None, "", " ", "a", "Ab cd  e\tf", " é leads", "wwwwwwwww", "", "x y"]
    column = pa.array(["other words", *given * 3]).slice(1)
    keys, sizes = ct.serial(words_of(column, lower=True))
    texts = [b"\n" * ct.DEPTH + stream(t) for t in given * 3]
    want = [int.from_bytes(bytes([t[i], *t[i - ct.DEPTH:i]]), "little") for t in texts for i in range(ct.DEPTH, len(t))]
    assert keys.tolist() == want and sizes.tolist() == [len(t) - ct.DEPTH for t in texts]
    words = words_of(pa.array(["some words of a text " * 5000] * 5))
    tracemalloc.start()
    keys, _ = ct.serial(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 * len(keys)


def test_distinct_keys_are_sorted_not_hashed(monkeypatch):
    """``np.unique`` takes a hundred times as long as a sort of so many numbers."""
    monkeypatch.setattr(np, "unique", None)
    rows = pa.record_batch([pa.array([2, 1, None]), pa.array(["b a b", None, "A"]), pa.array([0, 0, 0])], ["doc_id", "text", "tag"])
    found = ct._distinct(rows)
    assert len(found[ct.WORD]) == 3 and found[ct.GRAM].tolist() == sorted(set(ct.serial(words_of(rows["text"], lower=True))[0].tolist()))
    assert ct._places(np.array([9, 3, 5], np.uint64), np.array([1, 3, 5, 9], np.uint64)).tolist() == [3, 1, 2]
