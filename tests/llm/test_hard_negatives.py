"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismspark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id long, row int, rank int, `a.b` int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((9, 12))
    rows = [(i, (centres[i % 9] + 0.4 * rng.standard_normal(12)).tolist(), int(rng.integers(4)) if rng.random() < 0.6 else 1) for i in range(400)]
    rows += [(k, rows[5][1], 2) for k in (5, 5, 100, 500, 500)] + [(600, rows[7][1], 9), (700, [0.0] * 12, 1), (701, [0.0] * 12, 2), (704, [1.0, 2.0], 0), (800, [], 0), (10, [-x for x in rows[10][1]], 3)]
    rows += [(401, None, 1), (900, None, 1), (403, [None] + [1.0] * 11, 1), (404, [math.inf] * 12, 1), (405, [math.nan] * 12, 1), (406, rows[1][1], None), (None, rows[5][1], 1)]
    return spark.createDataFrame([(i, v, y, 1, 2, 3, 4) for i, v, y in rows], SCHEMA).repartition(3).cache()


def expected(frame):
    rows = []
    for r in frame.collect():
        v, y = r["embedding"], r["label"]
        if r["vec_id"] is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((r["vec_id"], [math.floor(256 * x) for x in v], (y + 1) % 10 if r["vec_id"] % 7 == 0 else y))
    out = []
    for k, (i, v, y) in enumerate(rows):
        if i % 100 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for m, (j, w, z) in enumerate(rows) if m != k]
            for p, j, _ in sorted(s for s in scores if s[2] == y)[:5]:
                fit = sorted(s for s in scores if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
                out += [(i, j, n + 1, m, min(2**63 - 1, -p), min(2**63 - 1, -s)) for n, (s, m, _) in enumerate(fit)]
    return sorted(out)


def mined(frame):
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("id") % 100 == 0, label).collect())


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_ROWS": 300, "GROUP": 3, "MEMBERS": 2, "STRIDE": 7}])
def test_equals_brute_force(vectors, sizes, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(hard_negatives, name, value)
    want = expected(vectors)
    assert len(want) > 60 and mined(vectors) == want


def test_scores_beyond_doubles(spark):
    rows = [(i, [1e7 * (i + 1), float(i % 3), 1e7], i % 2) for i in range(0, 500, 25)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(frame) == expected(frame) != []


def test_no_vectors_and_no_anchors(vectors):
    assert mined(vectors.limit(0)) == mined(vectors.filter("vec_id = 1")) == []


def test_lists_end_where_their_bound_proves_it():
    """Clustered vectors: the members leave the list early, with the same winners."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 32))
    x = np.floor(256 * (np.repeat(centres, 500, axis=0) + 0.05 * rng.standard_normal((10_000, 32))))
    members, best = x[:40], [hard_negatives._Best(5) for _ in range(40)]
    scored = hard_negatives._walk(members, x, lambda m: best[m].least, lambda m, places, scores: best[m].add(scores, places), True)
    full = members @ x.T
    for m in range(40):
        order = np.lexsort((np.arange(len(x)), -full[m]))[:5]
        assert [(-s, i) for s, i in best[m].rows] == [(full[m][i], i) for i in order.tolist()]
    assert scored < 0.4 * full.size


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for spread in (0.1, 1.0, 30.0):
        members = rng.standard_normal(8) + spread * rng.standard_normal((30, 8))
        others = rng.standard_normal((500, 8)) * rng.exponential(size=(500, 1))
        others[0] = members[0] = 0
        order, bound, length = hard_negatives.shared_list(members, others)
        assert (np.diff(bound) <= 0).all()
        assert (members @ others[order].T <= length[:, None] * bound + 1e-9).all()
