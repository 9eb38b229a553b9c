"""The nearest vectors against all pairs scored one by one: ties, zero vectors, other lengths, and blocks of queries."""

import numpy as np
import pytest

from tessera.operators import retrieval as R


@pytest.mark.parametrize("max_bytes", [64 << 20, 2000])
def test_nearest_is_all_pairs(spark, monkeypatch, max_bytes):
    monkeypatch.setattr(R, "MAX_SCORES", 100)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]  # few values: many equal scores
    rows += [(60, [0.0, 0.0, 0.0]), (61, [1.0, 2.0]), (62, [2.0, 4.0]), (63, [1.0, 0.0, 1.0]), (64, [1.0, 0.0, 1.0]), (65, None)]
    given = spark.createDataFrame(rows, "id long, vector array<float>")

    def score(a, b):
        dot = x = y = 0.0
        for p, q in zip(a, b, strict=True):
            dot, x, y = dot + p * q, x + p * p, y + q * q
        scale = np.sqrt(x) * np.sqrt(y)
        return dot / scale if scale > 0 else 0.0

    asked, wanted = [r for r in rows if r[0] % 3 == 0 and r[1]], set()
    for i, a in asked:
        ranked = sorted((-score(a, b), j) for j, b in rows if b and j != i and len(a) == len(b))[:4]
        wanted |= {(i, j, -s, place + 1) for place, (s, j) in enumerate(ranked)}
    found = R.nearest(given.where("id % 3 = 0"), given, 4, max_bytes=max_bytes)
    assert {(r.query, r.id, r.score, r["rank"]) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
