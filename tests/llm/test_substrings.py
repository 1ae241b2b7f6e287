import random
from collections import Counter

import pytest

from redressa.llm import substrings


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(small_docs):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(80)]
    made = []
    for i in range(90):  # parts of one passage of every length around the window, at any offset
        a = rng.randrange(40)
        own = [f"o{rng.random()}" for _ in range(rng.randrange(60))]
        at = rng.randrange(len(own) + 1)
        made.append((10_000 + i, " ".join(own[:at] + passage[a:a + 30 + i % 12] + own[at:])))
    made += [(20_000, "same " * 36), (20_001, "again " * 35), (20_002, "twice here " * 20), (None, " ".join(passage)), (None, "n " * 34)]
    made += [(20_003, " ".join(passage[:35])), (20_003, "x " + " ".join(passage[1:36]))]
    return [(d, t) for d, t, _ in small_docs if len(t or "") < 300_000] + made


@pytest.mark.parametrize("window, groups", [(35, None), (35, 3), (10, 7), (7, 1)])
def test_same_as_every_window(spark, rows, window, groups):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, grp int, tag string").repartition(3)
    got = substrings.remove_repeats(frame, window, groups).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute(rows, window)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_empty(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
