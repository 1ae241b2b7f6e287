import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redressa.llm import bit_slices as bs


def brute(rows, k=5, divisor=50, scale=256):
    fit = []
    for n, (i, e) in enumerate(rows):
        if e is not None and all(x is not None and math.isfinite(x) and abs(x * scale) < bs.MOST for x in e):
            fit.append((n, i, [math.floor(x * scale) for x in e]))
    out = []
    for n, i, v in fit:
        if i is not None and i % divisor == 0:
            others = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, j, w in fit if m != n and len(w) == len(v)]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


def rows_of(seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-0.4, 0.4) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)] + [(i, [1.0, -2.5, 0.0]) for i in (400, 401, 402)]
    rows += [(450, None), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [None] * 8), (650, []), (651, []), (700, [0.0] * 8)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, rows[100][1]), (750, [1e300] * 8), (800, [5000.0] * 8), (801, [-4000.5] * 8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, rank int, row string, block long").repartition(4)


@pytest.mark.parametrize("slices, block_rows, group", [(6, 64, 2), (2, 100, 5), (12, 1 << 14, 1024)])
def test_same_as_brute_force(spark, slices, block_rows, group):
    rows = rows_of()
    got = bs.top_products(frame(spark, rows), F.col("vec_id") % 50 == 0, slices=slices, block_rows=block_rows, group=group)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert bs.top_products(frame(spark, rows_of()).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_sums_and_selection():
    rng = np.random.default_rng(3)
    values = rng.integers(-300, 300, (500, 16))
    weights = rng.integers(-200, 200, 16)
    index, shift = bs.sliced(values, 10)
    assert shift == 0
    total = bs.weighted_sum(index, weights)
    bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little")[:500] for s in total]).astype(np.int64)
    sums = (bits << np.arange(len(total))[:, None]).sum(axis=0)
    exact = values @ weights
    assert len(set(exact - sums)) == 1
    every = bs.bitmaps(np.ones(500, np.uint8))
    for k in (1, 5, 100, 500):
        kth = bs.kth_largest(total, every, k)
        assert kth == sorted(sums)[-k]
        for value in (kth, kth + 1, 0, 1 << 60):
            chosen = np.flatnonzero(np.unpackbits(bs.at_least(total, every, int(value)).view(np.uint8), bitorder="little")[:500])
            assert set(chosen) == set(np.flatnonzero(sums >= value))


def test_boundary_is_small():
    """Few rows are scored with all bits, the best ones always."""
    rng = np.random.default_rng(4)
    values = rng.normal(0, 32, (4096, 64)).astype(np.int64)
    index, shift = bs.sliced(values)
    every = bs.bitmaps(np.ones(4096, np.uint8))
    for q in range(20):
        found, score = bs.best_rows(index, shift, values, values[q], every, 5)
        assert len(found) < 400 and set(np.argsort(-(values @ values[q]))[:5]) <= set(found)
        assert (score == values[found] @ values[q]).all()
