import math

import numpy as np
import pytest

from redressa.llm import embedding_join
from redressa.llm.common import table
from redressa.llm.links import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, a int"


def brute(rows):
    """Every pair of a label, one by one; {row number: (n_links, component)}."""
    def good(r):
        return None not in r[:3] and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    unit = [np.array(r[1], np.float32).astype(float) if good(r) else None for r in rows]
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] / math.sqrt(unit[i] @ unit[i]) / math.sqrt(unit[j] @ unit[j]) >= 0.98] for i in range(n)]
    out = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = [k for k in link[todo.pop()] if k not in seen]
            seen.update(new)
            todo += new
        out[i] = (rows[i][0], len(link[i]), min(rows[k][0] for k in seen) if rows[i][0] is not None else None)
    return sorted(out.values(), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out, centres = [], rng.normal(size=(12, 6))
    for i in range(420):
        x = centres[i % 12] + rng.normal(size=6) * (0.12 if i % 3 else 0.02)
        out.append((i, [float(np.float32(v)) for v in x], int(i % 12 > 7)))
    out += [(500 + i, out[7][1], out[7][2]) for i in range(60)]  # copies
    out += [(600, [2 * x for x in out[7][1]], out[7][2]), (601, out[7][1], None), (602, None, 0), (603, [], 0), (604, [0.0] * 6, 0)]
    out += [(605, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (606, [math.nan] * 6, 0), (607, [math.inf] * 6, 0), (None, out[7][1], 0)]
    out += [(608, [1.0, 0.0], 0), (609, [1.0, 0.01], 0), (610, [3e38] * 6, 1), (611, [1e-38] * 6, 1)]
    out += [(701, [1.0, 0.0], 5), (701, [0.0, 1.0], 5), (702, [0.0, 1.0], 5), (703, [1.0, 0.001], 5)]  # one id, two vectors
    return out


@pytest.mark.parametrize("cell, block", [(2000, 4096), (40, 4096), (15, 16)])
def test_same_as_every_pair(spark, rows, cell, block):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    got = embedding_join.near_vectors(frame, cell=cell, block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_many_pivots_in_small_steps(spark, rows, monkeypatch):
    monkeypatch.setattr(embedding_join, "AT_ONCE", 50)
    got = embedding_join.near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), cell=1).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)


def test_given_table(spark):
    data = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding", "label").collect()]
    got = embedding_join.near_vectors(table(spark, "/root/testdata/sf0.001", "embeddings"), cell=50).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(data)


def test_empty(spark):
    assert embedding_join.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 160), (1, 2), (2, 1), (5, 5), (3, 2)] + [(900, 900 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 7 for i in range(100, 161)}, 2: 1, 3: 1, **{900 + i: 900 for i in range(1, 50)}}
