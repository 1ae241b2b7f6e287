import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from redressa.llm import mixing

LEVELS = ["domain", "lang", "source"]


def fill(children, budget):
    """Share a budget among {name: (capacity, weight)} by repeated rounds, until nobody is over capacity."""
    share, left, todo = dict.fromkeys(children, 0.0), budget, {k for k, (_, w) in children.items() if w > 0}
    while todo:
        total = sum(children[k][1] for k in todo)
        over = {k for k in todo if left * children[k][1] / total >= children[k][0]}
        if not over:
            share.update({k: left * children[k][1] / total for k in todo})
            break
        for k in over:
            share[k] = children[k][0]
            left -= children[k][0]
        todo -= over
    return share


def brute(rows, weights, share, epochs, seed):
    """rows: (domain, lang, source, doc_id, tag, n). {row: (budget, copies)} as sorted rows."""
    def deal(depth, rows, budget):
        if depth == 3:
            whole = min(epochs, budget // t) if (t := sum(r[5] for r in rows)) else 0
            rest, out = budget - whole * t, []
            for r in sorted(rows, key=lambda r: (hashlib.md5(":".join(map(str, [seed, whole, r[3]])).encode()).hexdigest(), r[3], r[5], r[4])):
                rest -= r[5]
                out.append((*r, budget, whole + (rest >= 0 and whole < epochs)))
                rest = rest if rest >= 0 else float("-inf")
            return out
        groups = defaultdict(list)
        for r in rows:
            groups[r[depth]].append(r)
        known = weights.get(LEVELS[depth], {})
        got = fill({k: (epochs * sum(r[5] for r in g), known.get(k, 1.0)) for k, g in groups.items()}, budget)
        return [x for k, g in groups.items() for x in deal(depth + 1, g, got[k] if depth < 2 else int(round(got[k], 3)))]

    return sorted(deal(0, rows, share * sum(r[5] for r in rows)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(900):
        source = "src0" if i % 3 == 0 else f"src{rng.randrange(9)}"  # a third in one source
        out.append((f"domain{int(source[3:]) % 3}", rng.choice(["en", "en", "de", "fr"]), source, i, i * 7, rng.randrange(0, 400)))
    return out + [("domain9", "en", "none", 5000, 1, 0), ("domain9", "en", "none", 5001, 1, 0), ("domain1", "xx", "src1", 6000, 1, 90_000)]


@pytest.mark.parametrize("share, epochs, size", [(0.3, 1, 2000), (0.9, 2, 7), (0.7, 1, 1), (1.0, 1, 50), (2.5, 2, 7), (0.0, 1, 5)])
def test_same_as_one_by_one(spark, rows, monkeypatch, share, epochs, size):
    monkeypatch.setattr(mixing, "BIN", size)
    monkeypatch.setattr(mixing, "STRETCH", 3)
    weights = {"domain": {"domain0": 5, "domain2": 0.5}, "lang": {"en": 3, "fr": 0}, "source": {"src0": 0.2}}
    frame = spark.createDataFrame([(*r, "x") for r in rows], "domain string, lang string, source string, doc_id long, tag long, n_tokens long, n string")
    got = mixing.mix(frame.repartition(4), LEVELS, weights, share, epochs, seed=3).drop("n").collect()
    assert sorted(map(tuple, got)) == brute(rows, weights, share, epochs, 3)


def test_budget_is_met(spark, rows):
    frame = spark.createDataFrame(rows, "domain string, lang string, source string, doc_id long, tag long, n_tokens long")
    got = mixing.mix(frame, LEVELS, {}, 0.5).selectExpr("sum(n_tokens * copies) t", "sum(n_tokens) a").first()
    assert got.t <= 0.5 * got.a


def test_odd_rows(spark, docs, no_docs, small_docs):
    kept = mixing.mixed(docs, {}, 1.0)
    assert kept.columns == docs.columns and kept.count() == len(small_docs)
    assert mixing.mixed(no_docs, {}, 0.5).count() == 0
    values = spark.createDataFrame([("src4", None, "a b"), (None, "en", None), ("x", "en", " ")], "source string, lang string, text string")
    got = values.selectExpr("1L as doc_id", "*")
    assert {tuple(r) for r in mixing.described(got).select("domain", "lang", "source", "n_tokens").collect()} == {
        ("domain1", "unknown", "src4", 2), ("domain0", "en", "unknown", 0), ("domain0", "en", "x", 0)
    }


def test_documents_keep_columns_of_any_name(spark, docs):
    names = ["tag", "n_tokens", "budget", "copies", "_rest", "_bin", "_order", "_whole", "_document", "domain", "tokens", "n", "_cut"]
    given = docs.select("*", *[F.concat(F.lit(name), "text").alias(name) for name in names if name not in docs.columns])
    kept = mixing.mixed(given, {"lang": {"en": 2}}, 0.6, seed=5)
    assert kept.columns == given.columns
    plain = mixing.mixed(docs, {"lang": {"en": 2}}, 0.6, seed=5)
    assert sorted(map(str, kept.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert kept.filter(" OR ".join(f"`{name}` <> concat('{name}', text)" for name in names)).count() == 0


def test_rows_of_one_id_are_cut_again(spark, monkeypatch):
    """A third of a leaf's rows share an id, and many of those a length: few are left to be put in order."""
    rng, left = random.Random(3), []
    rows = [("domain0", "en", "src0", i, rng.randrange(-(1 << 63), 1 << 63), rng.randrange(9, 40)) for i in range(600)]
    rows += [("domain0", "en", "src0", 7, rng.randrange(-(1 << 63), 1 << 63), 20 + i % 2) for i in range(300)]
    first = [r for r in sorted(rows, key=lambda r: hashlib.md5(f"1:0:{r[3]}".encode()).hexdigest())]
    at = next(i for i, r in enumerate(first) if r[3] == 7)
    share = (sum(r[5] for r in first[:at]) + 3000) / sum(r[5] for r in rows)
    keep = mixing.written

    def seen(df, name):
        out = keep(df, name)
        left.extend([out.count()] if name == "mix-edge" else [])
        return out

    monkeypatch.setattr(mixing, "BIN", 20)
    monkeypatch.setattr(mixing, "written", seen)
    frame = spark.createDataFrame(rows, "domain string, lang string, source string, doc_id long, tag long, n_tokens long")
    got = sorted(tuple(r) for r in mixing.mix(frame, LEVELS, {}, share, seed=1).collect())
    assert got == brute(rows, {}, share, 1, 1)
    assert left and left[0] > 300 and left[-1] <= 60
