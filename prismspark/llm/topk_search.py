"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every component of a vector is a term with a whole-number weight.  Candidates
are dealt into blocks by a hash of their row, queries likewise; for each pair of
blocks the candidates' postings (term -> places and weights) are laid out once,
and each query adds, term by term, its weight times the posting's weights into
a dense array of scores.  A partition selection keeps the block's k best, and
the blocks' winners are merged by rank.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id; a missing term weighs 0, so vectors of
different length still score; equal scores go to the smaller id; rows that
repeat an id are queries and candidates of their own, each against every other
row; a query with fewer candidates than k returns them all; scores beyond a long
are cut to its range; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.llm.storage import written

SCALE, TOP = 256, 5
#: Least and largest number of vectors in a block.  Larger blocks move fewer
#: copies of them, smaller ones keep more tasks busy.
CANDIDATE_BLOCK, QUERY_BLOCK = (8_192, 65_536), (512, 8_192)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _accumulate(k: int, scale: int):
    def run(group: pa.Table) -> pa.Table:
        ids, keys, query = (group[c].to_numpy() for c in ("id", "row", "query"))
        lists = group["vector"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        wide = int(sizes.max(initial=0))
        whole = float(np.abs(values).max(initial=0.0))
        kind = np.int64 if whole**2 * max(wide, 1) < 2.0**62 else object
        dense = np.zeros((len(ids), wide), object if kind is object else np.float64)
        if kind is object:
            values = np.array([int(v) for v in values], object)
        dense[np.arange(wide) < sizes[:, None]] = values
        held = np.flatnonzero(~query)
        names, places, docs = ids[held], keys[held], dense[held].astype(kind)
        postings = []
        for term in range(wide):
            column = np.ascontiguousarray(docs[:, term])
            at = np.flatnonzero(column)
            postings.append((None, column) if len(at) == len(column) else (at, column[at]))
        out: list[tuple[int, int, int, int]] = []
        for row in np.flatnonzero(query):
            weights = dense[row].astype(kind)
            scores = np.zeros(len(held), kind)
            for term in np.flatnonzero(weights):
                at, column = postings[term]
                if at is None:
                    scores += weights[term] * column
                else:
                    scores[at] += weights[term] * column
            others = np.flatnonzero(places != keys[row])
            own = scores[others]
            if len(own) > k:
                least = np.partition(own, len(own) - k)[len(own) - k]
                others, own = others[own >= least], own[own >= least]
            best = sorted(zip((-own).tolist(), names[others].tolist(), strict=True))[:k]
            out += [(int(keys[row]), int(ids[row]), int(i), max(-(2**63), min(2**63 - 1, -int(s)))) for s, i in best]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "query_id", "vec_id", "score"), columns, strict=True)})

    return run


def _blocks(n: int, wanted: int, size: tuple[int, int]) -> int:
    """How many blocks n vectors make: ``wanted``, within the sizes allowed."""
    return max(1, -(-n // min(size[1], max(size[0], n // wanted))))


def search(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id,
    embedding) that ``is_query`` names, its k best among all others by inner
    product of floor(scale * component)."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    # Rows are numbered once, in the written table, so every reader sees the same.
    rows = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("asked", F.coalesce(is_query, F.lit(False))), "search-vectors")
    n = rows.agg(F.count(F.lit(1)), F.sum(F.col("asked").cast("int"))).first()
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    blocks, query_blocks = _blocks(n[0], tasks, CANDIDATE_BLOCK), _blocks(n[1] or 0, 4, QUERY_BLOCK)
    candidates = rows.select("id", "row", "vector", F.lit(False).alias("query"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    queries = rows.filter("asked").select("id", "row", "vector", F.lit(True).alias("query"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("c"), F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(query_blocks)).cast("int").alias("q"))
    found = candidates.unionByName(queries).groupBy("c", "q").applyInArrow(_accumulate(k, scale), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
