import random

import pytest

from redressa.llm import line_runs as lr


def brute(rows, least):
    """Every pair of places is compared; lines that are blank go with the line before them."""
    texts, numbers = {}, {}
    for d, t in rows:
        whole = [x.rstrip(" ") for x in t.split("\n")] if t else []
        numbers[d, t] = [i for i, x in enumerate(whole) if x] + [len(whole)]
        texts[d, t] = [x for x in whole if x]
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    gone, seen = {k: set() for k in texts}, set()
    for k in order:
        for i in range(len(texts[k]) - least + 1):
            run = tuple(texts[k][i:i + least])
            if run in seen:
                gone[k].update(range(numbers[k][i], numbers[k][i + least]))
            seen.add(run)
    out = []
    for d, t in rows:
        w, longest = texts[d, t], 0
        for i in range(len(w)):
            for other, v in texts.items():
                for j in range(len(v)):
                    if (other, j) != ((d, t), i):
                        n = 0
                        while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                            n += 1
                        longest = max(longest, n)
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t]) if t else ""
        out.append((d, numbers[d, t][-1], len(gone[d, t]), longest, kept))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(small_docs):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(30)]
    made = [(i, "\n".join(rng.choice(lines[:6]) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    made += [(100 + i, "\n".join(lines[i:i + 12] + [f"own {i}"])) for i in range(8)]
    made += [(200, "\n".join(["same"] * 20)), (201, "\n\n\n"), (202, "a\nb  \nc"), (203, "a \nb\nd"), (204, None), (205, ""), (206, "one line")]
    made += [(208, "\n\nline 3\n \n\nline 4\n"), (209, "line 9\n\nline 3\nline 4"), (210, "\n".join(lines[3:20] + ["else"] + lines[2:9])), (211, "\n".join(["same"] * 13 + ["x"]))]
    made += [(207, "twice\nthe same"), (207, "twice\nthe same"), (None, "line 3\nline 4\nz")]
    return made


@pytest.mark.parametrize("least, large", [(1, 1 << 16), (2, 1 << 16), (3, 1), (5, 10)])
def test_same_as_every_run(spark, rows, least, large):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, lines string").repartition(3)
    got = sorted((tuple(r) for r in lr.remove_runs(frame, least, large).collect()), key=str)
    assert got == brute(rows, least)


@pytest.mark.parametrize("large", [1 << 16, 3])
def test_suffix_array(spark, rows, large):
    docs = spark.createDataFrame(rows[:50], "doc_id long, text string")
    classes = lr.line_classes(lr.places_of(docs))
    array, borders, _ = lr.suffix_array(classes, large=large)
    ids = {r._doc: [p.start for p in r.lines] for r in classes.collect()}
    places = [(p.start, p.off, p.size, ids[r._doc][p.pos:]) for r in array.collect() for p in r.lines if p.start >= 0]
    for start in {p[0] for p in places}:
        mine = sorted((p for p in places if p[0] == start), key=lambda p: p[3])
        suffixes = [p[3] for p in mine]
        assert [p[1] for p in mine] == [suffixes.index(x) for x in suffixes] and [p[2] for p in mine] == [suffixes.count(x) for x in suffixes]
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = {i: shared(suffixes[i - 1], suffixes[i]) for i in range(1, len(mine)) if suffixes[i] != suffixes[i - 1]}
        given = {r.at: r for r in borders.filter(f"start = {start}").collect()}
        assert set(given) == set(want) and all(r.least == want[i] if r.exact else r.least <= want[i] < 2 * r.least for i, r in given.items())


def test_long_copies(spark):
    """Copies of more lines than the rounds tell apart: no line splits in the first table, a few do in the second."""
    long = "\n".join(f"line {i}" for i in range(100))
    for made in ([(1, long), (2, long)], [(1, long), (2, long), (3, f"line 5\nline 6\nelse\n{long}"), (4, "line 5\nline 7")]):
        got = sorted((tuple(r) for r in lr.remove_runs(spark.createDataFrame(made, "doc_id long, text string")).collect()), key=str)
        assert got == brute(made, lr.LEAST_LINES) and got[1][2:4] == (100, 100)


def test_empty(no_docs):
    assert lr.remove_runs(no_docs).count() == 0
