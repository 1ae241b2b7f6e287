import math

import pytest

from redressa.llm.common import bounded_sample, sample_share


@pytest.mark.parametrize("rows, size", [(10**11, 10**14), (10**13, 10**16), (1, 1), (3000, 24 << 20), (10**6, 0)])
def test_share_at_any_size(rows, size):
    share = sample_share(rows, size, 3000, 24 << 20)
    part = min(1.0, 3000 / rows, (24 << 20) / max(1, size))
    assert share > 0 and math.isclose(share / 2**63, part, rel_tol=1e-3)


def test_small_classes_are_taken_whole(spark):
    frame = spark.createDataFrame([(c, f"{c} {i}") for c, n in (("a", 50), ("b", 4000), (None, 3)) for i in range(n)], "c string, t string")
    got = {r["c"]: r["count"] for r in bounded_sample(frame, "c", "t", 400, 1 << 40).groupBy("c").count().collect()}
    assert got["a"] == 50 and 300 < got["b"] < 500 and None not in got
    assert bounded_sample(frame.limit(0), "c", "t", 400, 10).count() == 0
