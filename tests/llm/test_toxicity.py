from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import remainder
from pyspark.sql import functions as F

from redressa.llm import toxicity
from redressa.llm.common import table


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, "/root/testdata/sf0.001", "labels")


def test_rows_and_held_out(docs, labels, small_docs):
    rows = toxicity.toxicity(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in small_docs)
    assert all(r.held_out == (r.doc_id is not None and remainder(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    empty = {round(r.score, 12) for r in rows if r.doc_id in (900_001, 900_002, 900_003, 900_011)}
    assert len(empty) == 1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    rows = [r for r in toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()]
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    wrong = sum(p for p, y in held if not y) / sum(1 - y for _, y in held)
    assert len(held) > 500 and caught > 0.85 and wrong < 0.01


def test_copies_count_once(spark):
    """A word of one text, copied often, tells nothing; one in many places does."""
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [("same words all over mark here", 1)] * 400 + [(f"{name(i)} idiot {name(i + 9)}", 1) for i in range(60)]
    rows += [(f"{name(i)} fine {name(i + 5)} and {name(i % 90)}", 0) for i in range(400)]
    got = toxicity.ratios(spark.createDataFrame(rows, "text string, toxic int")).collect()
    words = toxicity.words_of(pa.array(["idiot mark same"]), gap=toxicity.NOT_LETTER).hashes.view("int64").tolist()
    found = {r.unit: r.ratio for r in got}
    assert found[words[0]] > 2 and words[1] not in found and words[2] not in found


def test_one_class_none_and_empty(docs, labels, no_docs):
    one = toxicity.toxicity(docs, labels.withColumn("toxic", F.lit(1))).collect()
    assert all(r.predicted == 1 for r in one)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    odd = toxicity.toxicity(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).collect()
    assert all(r.predicted == 0 for r in odd)
    assert toxicity.toxicity(no_docs, labels).count() == 0


TEXTS = [
    ("you are a fool and a foolish man", 1), ("what a fool you are", 1), ("a fool a fool", 1), ("go away you fool", 1),
    ("you are kind and a good man", 0), ("what a day you had", 0), ("a man and a day", 0), ("no fool goes there", 0),
    ("what a kind man you are", 0), ("go away from there", 0), ("foolishness of a day", 0), ("", 0),
]


def counted(spark, texts):
    return toxicity.counts(spark.createDataFrame(texts, "text string, toxic int"))


def places(text):
    """Arguments of ``chances`` for the words of a text, and the words."""
    words = toxicity._words(pa.RecordBatch.from_pydict({"text": [text]}))
    return (toxicity._before(words), words.hashes, toxicity._stems(words), np.zeros(len(words.hashes), np.int64)), text.split()


def by_hand(texts, off, strength, known):
    """Chance of (class, word before, word), with dictionaries; ``off`` has the discounts of pairs, words and stems."""
    stem = lambda w: w if len(w) < 5 else w[:5] + "*"
    pairs = [Counter(), Counter()]
    for text, y in texts:
        pairs[y].update(set(zip(["", *text.split()], text.split())))
    pairs.append(pairs[0] + pairs[1])
    words = [Counter(w for _, w in p) for p in pairs[:2]]
    stems = [Counter() for _ in words]
    for y in (0, 1):
        for w, n in words[y].items():
            stems[y][stem(w)] += n
    kinds = Counter(map(stem, known))
    kinds.update(s for s in set(kinds) if len(s) > 5)  # a word that was not seen
    take = lambda d, n: d[min(n, 3)]

    def level(n, d, unit, base):
        return (n[unit] - take(d, n[unit]) + sum(take(d, x) for x in n.values()) * base) / sum(n.values())

    def alone(y, w):
        return level(words[y], off[1][y], w, level(stems[y], off[2][y], stem(w), 1 / (1 + len(kinds))) / max(1, kinds[stem(w)]))

    def adapted(y, w):
        total = [sum(x.values()) for x in words]
        return alone(y, w) * sum(total) / sum(t * alone(k, w) for k, t in enumerate(total))

    def chance(y, before, w):
        follow = [{b: n for (a, b), n in p.items() if a == before} for p in pairs]
        left = [sum(take(d, n) for n in f.values()) for d, f in zip(off[0], follow)]
        seen = [f.get(w, 0) - take(d, f.get(w, 0)) for d, f in zip(off[0], follow)]
        norm = left[2] + sum((n - take(off[0][2], n)) * adapted(y, b) for b, n in follow[2].items())
        common = (seen[2] * adapted(y, w) + left[2] * alone(y, w)) / norm if norm else alone(y, w)
        return (seen[y] + (left[y] + strength) * common) / (sum(follow[y].values()) + strength)

    return chance, kinds


KNOWN = {w for text, _ in TEXTS for w in text.split()}


def test_chances_are_those_of_the_method(spark):
    """A word's chance follows from its history, its class's own counts, its stem and the discounts, and chances sum to one."""
    model = counted(spark, TEXTS)
    chance, kinds = by_hand(TEXTS, (model.pairs.off, model.words.off, model.stems.off), toxicity.STRENGTH, KNOWN)
    for text in ("you are a fool", "a foolproof plan", "fool you there a fool", "unheard words"):
        arguments, words = places(text)
        got = toxicity.chances(model, *arguments)
        for i, (before, word) in enumerate(zip(["", *words], words)):
            assert got[:, i] == pytest.approx([chance(y, before, word) for y in (0, 1)], rel=1e-5), (before, word)
    fool = toxicity.chances(model, *places("a fool")[0])[:, 1]
    assert fool[1] > 2 * fool[0]
    others = [s[:5] + "zzz" for s in kinds if len(s) > 5] + ["zz"]  # a new word of each stem, and one of none
    for before in ("a", "fool", "day", "unheard"):
        for y in (0, 1):
            assert sum(chance(y, before, w) for w in [*KNOWN, *others]) == pytest.approx(1)


def test_without_own_counts(spark):
    """A text of the sample has about the chances that it would have, were it not there; words and discounts stay."""
    model = counted(spark, TEXTS)
    off = model.pairs.off, model.words.off, model.stems.off
    for at in (0, 1, 4, 10):
        text, y = TEXTS[at]
        arguments, words = places(text)
        got = toxicity.chances(model, *arguments, own=np.full(len(words), y))
        chance, _ = by_hand(TEXTS[:at] + TEXTS[at + 1 :], off, toxicity.STRENGTH, KNOWN)
        want = np.array([[chance(y, b, w) for b, w in zip(["", *words], words)] for y in (0, 1)])
        assert np.abs(np.log(got / want)).max() < 0.2 < 1 < np.abs(np.log(toxicity.chances(model, *arguments) / want)).max()


def test_order_of_words_counts(spark):
    """Texts of the same words in another order differ; words that pass no significance test count."""
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(i, f"{name(i)} shut up you {name(i + 9)}", 1) for i in range(40)]
    rows += [(100 + i, f"{name(i)} you shut it up {name(i + 5)}", 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    asked = spark.createDataFrame([(1, "xx shut up you yy"), (2, "xx up you shut yy")], "doc_id long, text string")
    got = {r.doc_id: r._score for r in toxicity.score(asked, model).collect()}
    assert got[1] > got[2]


def test_no_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, "1 2 3"), (3, None), (4, "a word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4] and len({round(r.score, 9) for r in rows}) == 1
