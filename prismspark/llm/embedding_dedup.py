"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks of
few dimensions.  Two vectors with cosine >= t have squared distance <= 2 - 2t,
so in at least one block their squared distance is within the block's share of
that budget (its dimensions over all).  Each block is range-joined: a vector
goes to the slab of its first coordinate in the block, as wide as the block's
radius, and visits the next slab; within a slab pairs within the block's budget
are candidates, and their cosine is verified in double precision.  A pair that
several blocks find counts in the first of them.

Equal vectors are one class beforehand, so that a vector with very many copies
is compared once.  A slab with many members is dealt into tiles, and each pair
of tiles is a task's work; tasks return counts and a spanning forest of the
links they verified, never the pairs.

Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing; vectors of different length do not link; rows that
repeat an id are vectors of their own, and link with each other only by cosine; a
null id stays alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismspark.llm.components import components
from prismspark.llm.storage import written
from prismspark.llm.topk_search import finite

COSINE, BLOCK_DIMS, SEED = 0.9, 16, 9
#: Members of one tile of a slab, and those that 128 of them are compared with
#: at once.
TILE, SPAN = 32_768, 8_192
_SLACK = 1e-9


class Subspaces:
    """The rotation of ``dims`` dimensions, its blocks and their budgets."""

    def __init__(self, dims: int, cosine: float, block_dims: int, seed: int):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
        self.matrix = q * np.sign(np.diag(r))
        n = max(1, round(dims / block_dims))
        edges = np.linspace(0, dims, n + 1).round().astype(int)
        self.blocks = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        self.budgets = [(2 - 2 * cosine + _SLACK) * (b - a) / dims for a, b in self.blocks]
        self.widths = [float(np.sqrt(x)) * (1 + _SLACK) for x in self.budgets]

    def rotated(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms and rotated unit vectors.  Only element-wise steps, so that a
        vector's numbers are the same to the bit in every task."""
        top = np.abs(vectors).max(axis=1, keepdims=True)
        scaled = vectors / top
        norm = np.zeros(len(vectors))
        for j in range(vectors.shape[1]):
            norm += scaled[:, j] * scaled[:, j]
        norm = np.sqrt(norm)
        unit = scaled / norm[:, None]
        out = np.zeros_like(unit)
        for j in range(vectors.shape[1]):
            out += unit[:, j : j + 1] * self.matrix[j]
        return unit, out


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _spaces(cosine: float, block_dims: int, seed: int):
    """Subspaces of each number of dimensions, made when first met."""
    known: dict[int, Subspaces] = {}

    def of(dims: int) -> Subspaces:
        if dims not in known:
            known[dims] = Subspaces(dims, cosine, block_dims, seed)
        return known[dims]

    return of


def _slabs(of):
    """Adds to each vector its places: the slab of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                space = of(dims)
                _, turned = space.rotated(_matrix(part.column(2), dims))
                slabs = np.stack([np.floor(turned[:, a] / w).astype(np.int32) for (a, _), w in zip(space.blocks, space.widths, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(slabs), pa.list_(pa.int32()))], names=["key", "copies", "vector", "slabs"])

    return run


def _hits(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the set flags of a matrix whose width is a multiple of 8; few
    are set, so eight at a time are passed over."""
    i, j = np.nonzero(flags.view(np.uint64))
    i, j = np.repeat(i, 8), (j[:, None] * 8 + np.arange(8)).ravel()
    keep = flags[i, j]
    return i[keep], j[keep]


class Forest:
    """Smallest place that each place is linked with, directly or not."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _compare(of, cosine: float):
    def run(group: pa.Table) -> pa.Table:
        dims, block, p, q = (group[c][0].as_py() for c in ("dims", "block", "p", "q"))
        space = of(dims)
        key, copies, visits, tile = (group[c].to_numpy() for c in ("key", "copies", "visits", "tile"))
        unit, turned = space.rotated(_matrix(group["vector"], dims))
        low, high = space.blocks[block]
        near, unit32 = turned[:, low:high].astype(np.float32), unit.astype(np.float32)
        size, one = (near * near).sum(axis=1, keepdims=True), np.ones((len(near), 1), np.float32)
        # The product of these two is the squared distance.
        from_, to = np.hstack([-2 * near, size, one]), np.hstack([near, one, size])
        along = turned[:, min(low + 1, high - 1)]  # neighbours lie within the radius here too
        limit, reach = np.float32(space.budgets[block] + 1e-5), space.widths[block]
        squares = np.stack([(turned[:, a:b] ** 2).sum(axis=1) for a, b in space.blocks[: block + 1]])
        links, forest = np.zeros(len(key), np.int64), Forest(len(key))

        def verify(a: np.ndarray, b: np.ndarray) -> None:
            close = np.einsum("ij,ij->i", unit32[a], unit32[b]) >= cosine - 1e-4
            a, b = a[close], b[close]
            dot, first = np.zeros(len(a)), np.full(len(a), -1)
            for d in range(dims):
                dot += unit[a, d] * unit[b, d]
            for c, (start, stop) in enumerate(space.blocks[: block + 1]):
                gap = np.zeros(len(a))
                for d in range(start, stop):
                    gap += (turned[a, d] - turned[b, d]) ** 2
                first[(first < 0) & (gap <= space.budgets[c])] = c
            own = (dot >= cosine) & (first == block)
            a, b = a[own], b[own]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            forest.join(a, b)

        def verify_many(rows: np.ndarray, columns: np.ndarray, hit: np.ndarray) -> None:
            """As ``verify``, for most pairs of a matrix at once; pairs too close
            to a bound to tell from products go through ``verify``."""
            dot = unit[rows] @ unit[columns].T
            sure = hit & (dot >= cosine + 1e-9)
            unsure = hit & ~sure & (dot >= cosine - 1e-9)
            for c, (start, stop) in enumerate(space.blocks[: block + 1]):
                gap = squares[c][rows][:, None] + squares[c][columns] - 2 * (turned[rows, start:stop] @ turned[columns, start:stop].T)
                edge = np.abs(gap - space.budgets[c]) <= 1e-9
                unsure |= sure & edge
                sure &= ~edge & ((gap <= space.budgets[c]) == (c == block))
            sure &= ~unsure
            links[rows] += sure @ copies[columns]
            links[columns] += copies[rows] @ sure
            i, j = np.nonzero(sure & (forest.root[rows][:, None] != forest.root[columns]))
            forest.join(rows[i], columns[j])
            i, j = np.nonzero(unsure)
            verify(rows[i], columns[j])

        def scan(left: np.ndarray, right: np.ndarray, same: bool) -> None:
            left, right = left[np.argsort(along[left], kind="stable")], right[np.argsort(along[right], kind="stable")]
            wanted, steps = np.ascontiguousarray(to[right]), along[right]
            for at in range(0, len(left), 128):
                rows = left[at : at + 128]
                begin = max(at if same else 0, int(np.searchsorted(steps, along[rows[0]] - reach)))
                end = int(np.searchsorted(steps, along[rows[-1]] + reach, "right"))
                for start in range(begin, end, SPAN):
                    columns = right[start : min(start + SPAN, end)]
                    flags = np.zeros((len(rows), -(-len(columns) // 8) * 8), bool)
                    hit = flags[:, : len(columns)]
                    np.less_equal(from_[rows] @ wanted[start : start + len(columns)].T, limit, out=hit)
                    if same and start < at + 128:
                        hit &= (at + np.arange(len(rows)))[:, None] < start + np.arange(len(columns))
                    if np.count_nonzero(hit) * 16 > hit.size:
                        verify_many(rows, columns, hit)
                    else:
                        i, j = _hits(flags)
                        verify(rows[i], columns[j])

        home = [np.flatnonzero((tile == t) & ~visits) for t in (p, q)]
        guest = [np.flatnonzero((tile == t) & visits) for t in (p, q)]
        scan(home[0], home[1], p == q)
        scan(home[0], guest[1], False)
        if p != q:
            scan(home[1], guest[0], False)
        root = forest.root
        joined, linked = np.flatnonzero(root != np.arange(len(key))), np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([key[linked], key[joined]]), pa.int64()),
            "b": pa.array([None] * len(linked) + key[root[joined]].tolist(), pa.int64()),
            "links": pa.array(links[linked].tolist() + [0] * len(joined), pa.int64()),
        })

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``
    (vec_id, embedding)."""
    fit = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = written(vectors.select("vec_id", F.when(fit, F.col("embedding")).alias("vector")), "vectors")
    classes = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Classes are numbered, as several may have one smallest id.
    classes = written(classes.select(F.monotonically_increasing_id().alias("key"), "rep", "copies", "vector"), "vector-classes")
    of, kind = _spaces(cosine, block_dims, seed), classes.schema["vector"].dataType.simpleString()
    placed = classes.filter(F.size("vector") > 0).select("key", "copies", "vector").mapInArrow(_slabs(of), f"key long, copies long, vector {kind}, slabs array<int>")
    placed = placed.select("key", "copies", "vector", F.size("vector").alias("dims"), F.posexplode("slabs").alias("block", "home"))
    visited = F.array(F.struct(F.col("home").alias("slab"), F.lit(False).alias("visits")), F.struct((F.col("home") + 1).alias("slab"), F.lit(True).alias("visits")))
    placed = placed.select("key", "copies", "vector", "dims", "block", F.explode(visited).alias("x")).select("key", "copies", "vector", "dims", "block", "x.*")
    # One row a block and slab: at most 2 / width + 2 slabs of each length of vectors.
    members = placed.groupBy("dims", "block", "slab").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    dealt = placed.join(members, ["dims", "block", "slab"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.select("*", other.alias("o")).withColumns({"p": F.least("tile", "o"), "q": F.greatest("tile", "o")})
    parts = dealt.select("key", "copies", "vector", "visits", "tile", "dims", "block", "slab", "p", "q").groupBy("dims", "block", "slab", "p", "q").applyInArrow(_compare(of, cosine), "a long, b long, links long")
    parts = written(parts, "vector-links")
    reached = components(parts.filter("b is not null").select("a", "b"))  # roots are named as components alone
    reached = reached.unionAll(reached.select("component", "component").distinct()).withColumnRenamed("node", "key").join(classes.select("key", "rep"), "key")
    least = reached.groupBy("component").agg(F.min("rep").alias("least"))
    reached = written(reached.join(least, "component").select("key", "least"), "vector-components")
    counts = written(parts.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")), "vector-counts")
    known = classes.join(counts, "key", "left").join(reached, "key", "left")
    known = known.select(F.col("vector").alias("same"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "rep").alias("component"))
    out = rows.join(written(known, "vector-known"), F.col("vector") == F.col("same"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
