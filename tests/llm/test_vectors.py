"""Vector operators and components against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismspark.llm import embedding_dedup, topk_search
from prismspark.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, id long, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.25 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(40)]  # copies
    rows += [(400, None), (401, [0.0] * 16), (402, [math.nan] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [math.inf] * 16), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, []), (None, rows[5][1]), (5, rows[5][1]), (50, rows[7][1]), (50, rows[8][1]), (8, rows[7][1])]
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def usable(frame):
    """(vec_id, vector) of each row that takes part."""
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("blocks", [(topk_search.CANDIDATE_BLOCK, topk_search.QUERY_BLOCK), ((37, 37), (2, 2))])
def test_search_equals_brute_force(vectors, blocks, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", blocks[1])
    known = [(i, [math.floor(256 * x) for x in v]) for i, v in usable(vectors)]
    want = []
    for n, (q, w) in enumerate(known):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for m, (i, v) in enumerate(known) if m != n)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk_search.search(vectors, F.col("id") % 50 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)
    assert sum(q == 50 for q, *_ in want) == 15


def test_search_of_few_and_of_none(spark, vectors):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk_search.search(few, F.col("id") == 0).collect()] == [(1, 2**63 - 1)]
    assert topk_search.search(vectors.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("tile", [32_768, 60])
def test_links_equal_brute_force(vectors, tile):
    known = [(i, v) for i, v in usable(vectors) if any(v)]
    links, root = [0] * len(known), list(range(len(known)))
    for n, (_, v) in enumerate(known):
        for m, (_, w) in enumerate(known[:n]):
            x, y = np.array(v, float), np.array(w, float)
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[n] += 1
                links[m] += 1
                low, high = sorted((root[m], root[n]))
                root = [low if r == high else r for r in root]
    least = {r: min(i for (i, _), s in zip(known, root, strict=True) if s == r) for r in set(root)}
    want = [(i, k, least[r], i == least[r]) for (i, _), k, r in zip(known, links, root, strict=True)]
    want += [(i, 0, i, True) for i in (None, 400, 401, 402, 403, 404, 407)]
    got = [tuple(r) for r in embedding_dedup.near_duplicates(vectors, tile=tile).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(links) > 3000 and len({w for w in want if w[0] == 50}) == 3


def test_dense_cluster_needs_no_list_of_pairs():
    """20,000 vectors that all link: counts and a tree, in bounded memory."""
    import tracemalloc

    import pyarrow as pa

    n, rng = 20_000, np.random.default_rng(2)
    x = (rng.standard_normal(32) + 0.02 * rng.standard_normal((n, 32))).astype(np.float32)
    column = lambda v: pa.array(np.full(n, v))
    group = pa.table({"key": pa.array(np.arange(n)), "copies": column(1), "vector": pa.array(list(x), pa.list_(pa.float32())), "visits": column(False), "tile": column(0), "dims": column(32), "block": column(0), "slab": column(0), "p": column(0), "q": column(0)})
    compare = embedding_dedup._compare(embedding_dedup._spaces(0.9, 16, 9), 0.9)
    tracemalloc.start()
    out = compare(group).to_pylist()
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert sum(r["links"] for r in out) == n * (n - 1)
    assert sorted(r["a"] for r in out if r["b"] is not None) == list(range(1, n)) and {r["b"] for r in out} == {None, 0}


def test_no_vectors(vectors):
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_blocks_cover_every_close_pair():
    space, rng = embedding_dedup.Subspaces(24, 0.9, 7, 1), np.random.default_rng(0)
    x = rng.standard_normal((500, 24))
    y = x + 0.4 * rng.standard_normal((500, 24))
    (ux, rx), (uy, ry) = space.rotated(x), space.rotated(y)
    near = (ux * uy).sum(axis=1) >= 0.9
    within = np.stack([((rx - ry)[:, a:b] ** 2).sum(axis=1) <= e for (a, b), e in zip(space.blocks, space.budgets, strict=True)])
    assert near.sum() > 50 and within[:, near].any(axis=0).all()


def test_components(spark):
    rng, n = random.Random(1), 120
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(200, k) for k in range(201, 260)] + [(300 + k, 301 + k) for k in range(20)]
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    frame = spark.createDataFrame([*pairs, (7, None), (None, 8), (9, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert all(got.get(k, k) == r for k, r in root.items())
    assert components(frame.limit(0)).count() == 0
