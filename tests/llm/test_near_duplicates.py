import random

import numpy as np
import pyarrow as pa
import pytest

from redressa.llm import near_duplicates as nd
from redressa.llm.words import words_of


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = fold(text).encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, share, of):
    """Every pair; [(doc_id, n_shingles, component, kept)]."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and share * max(map(len, (sets[i], sets[j]))) <= of * min(map(len, (sets[i], sets[j]))):
                both = len(sets[i] & sets[j])
                if of * both >= share * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(find(i), d) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c if d is not None else c is None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(small_docs):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    made = [(10_000, " ".join(base).upper()), (10_001, " ".join(base)), (10_002, "\t".join(base) + "\n")]
    for i in range(120):  # copies of copies, some far from the first, so that components are chains
        words = made[rng.randrange(len(made))][1].split() if i % 2 else list(base)
        for _ in range(rng.choice([1, 2, 4, 8, 9])):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        made.append((10_003 + i, " ".join(words)))
    made += [(20_000, "Only two"), (20_001, "only TWO"), (20_002, "two"), (None, "another without id"), (None, "a b c d e f g")]
    return [(d, t) for d, t, _ in small_docs] + made


@pytest.mark.parametrize("k, share, block, few", [(3, 85, 512, 8), (5, 80, 16, 2), (3, 85, 8, 1), (2, 70, 512, 1)])
def test_same_as_every_pair(spark, rows, monkeypatch, k, share, block, few):
    monkeypatch.setattr(nd, "FEW", few)
    monkeypatch.setattr(nd, "BLOCK", block)
    frame = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, node int, kept boolean").repartition(3)
    got = sorted((tuple(r)[:4] for r in nd.near_duplicates(frame, words=k, share=share).collect()), key=str)
    assert got == brute(rows, k, share, 100)


def test_estimate_follows_the_similarity(spark):
    rng = np.random.default_rng(1)
    for overlap in (0.3, 0.6, 0.85, 0.95):
        apart = []
        for _ in range(40):
            common = rng.integers(0, 1 << 63, int(400 * overlap), dtype=np.uint64)
            rest = rng.integers(0, 1 << 63, (2, (400 - len(common)) // 2), dtype=np.uint64)
            planes = nd.signatures(nd.minima([np.concatenate([common, r]) for r in rest])).view(np.int64)
            apart.append(planes.tolist())
        frame = spark.createDataFrame(apart, "a array<long>, b array<long>")
        values = [r[0] for r in frame.select(nd._estimate("a", "b")).collect()]
        assert abs(np.mean(values) - overlap) < 0.03 and min(values) > overlap - nd.MARGIN


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50), dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 10_000, 300, dtype=np.uint64)) for _ in range(5)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    assert (nd._shared_counts(sets)[~np.eye(len(sets), dtype=bool)] == np.array(want)[~np.eye(len(sets), dtype=bool)]).all()


def test_sets_are_exact():
    text = "The cat sat on the cat sat on the mat"
    for k in (1, 3, 5, 50):
        assert len(nd.shingle_sets(words_of(pa.array([text]), lower=True), k)[0]) == len(shingles(text, k))


def test_empty(no_docs):
    assert nd.near_duplicates(no_docs).count() == 0
