"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct word shingles, each a 64-bit hash.  Two fixed
permutations of a universe of 2^20 places make the whole signature: the first
scatters a shingle to a place, the second gives it a value, and coordinate k is
the least value over the set when the second is shifted by k places.  So a
shingle's values are a window of consecutive numbers, and a signature is the
minimum of windows.  Coordinates are banded; documents that share a band are
candidates, and links are confirmed on full sets.

Documents with equal sets are one class beforehand.  In a band's bucket every
class is compared with the bucket's smallest; where that does not join the
bucket into one component, the classes outside its largest component are held
in tiles, an index of their full sets, and all its classes pass by; only links
that join components are returned.  So no bucket is cut short, none is expanded
into pairs, and a task holds one class or one tile, never a group.

With 32 bands of 4 rows, a pair of similarity 0.8 is missed with probability
(1 - 0.8^4)^32 < 1e-7.

Defined results: documents without words or text have empty sets and link with
nothing; with fewer words than a shingle has, the whole sequence is the one
shingle; rows that repeat an id and its text share their result (an id with
different texts gets a row for each, and links of any of them may join them);
a null doc_id stays alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismspark.llm.components import components
from prismspark.llm.storage import fresh, small_batches, written

WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100
BANDS, ROWS, UNIVERSE, SEED = 32, 4, 1 << 20, 6
HELD_WORDS = 300_000
#: Pairs of one class that a task compares with it.
CHUNK = 1_024
#: Shingles that a tile of a group of several components holds, and the least
#: number of them that pass by in one chunk.
TILE, CHUNK_SHINGLES = 1 << 21, 1 << 18
#: Ids up to which texts are looked up by a broadcast (some 8 MB); beyond it the
#: join shuffles.
BROADCAST_DOCS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each number (shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of distinct shingle hashes; word hashes are kept within a bound."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        missing = set(words).difference(self.known)
        if len(self.known) + len(missing) > HELD_WORDS:
            self.known, missing = {}, set(words)
        for w in missing:
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(hashes))
        out = np.full(len(hashes) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - width + 1 + k])
        return np.unique(out)


class Circulant:
    """Signatures by two permutations of the universe."""

    def __init__(self, size: int, universe: int, seed: int):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(universe).astype(np.int32)
        values = rng.permutation(universe).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: size - 1]]), size)
        self.mask, self.size = np.uint64(universe - 1), size

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for at in range(0, len(hashes), 4096):
            part = self.windows[self.scatter[hashes[at : at + 4096] & self.mask]].min(axis=0)
            out = part if out is None else np.minimum(out, part)
        return out


def _signatures(width: int, bands: int, rows: int, universe: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, circulant = Shingler(width), Circulant(bands * rows, universe, seed)
        salts = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingler.set_of(text)
                sizes.append(len(own))
                if not len(own):
                    digests.append(b"\0" * 16)
                    keys.append([])
                    continue
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                key = salts
                for column in circulant.signature(own).reshape(bands, rows).T:
                    key = _mix(key + column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys.append(key.view(np.int64))
            high = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
            low = [int.from_bytes(d[8:], "little", signed=True) for d in digests]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(sizes, pa.int64()), "d1": pa.array(high, pa.int64()), "d2": pa.array(low, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.set_of(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return run


def _streamed(df: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """``df`` dealt by the columns ``by`` and sent to ``run`` in order of them
    and of ``role``, a batch at a time: no group is ever held whole."""
    return df.repartition(*by).sortWithinPartitions(*by, "role").mapInArrow(run, schema)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column, each in (unsigned) order as ``_sets`` made it."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return (flat[end - n : end] for end, n in zip(ends.tolist(), sizes.tolist(), strict=True))


def _similar(both, nx, ny):
    return both * DENOMINATOR >= (nx + ny - both) * NUMERATOR


def _against_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of members with their head, whose row comes first (role 0; a row
    for each text of its id)."""
    heads: list[np.ndarray] = []
    first = None
    for batch in batches:
        a, chunk, role, rep = (batch.column(k).to_numpy() for k in range(4))
        out = []
        for k, own in enumerate(_lists(batch.column(4))):
            if (a[k], chunk[k]) != first:
                heads, first = [], (a[k], chunk[k])
            if not role[k]:
                heads.append(own)
                continue
            for head in heads if len(own) else []:
                at = np.minimum(np.searchsorted(head, own), max(len(head) - 1, 0))
                if len(head) and _similar(int((head[at] == own).sum()), len(head), len(own)):
                    out.append(k)
                    break
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[out], pa.int64()), "b": pa.array(rep[out], pa.int64())})


class Index:
    """Shingles of held sets and the sets that have each."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.values, self.bounds = flat[new], np.concatenate([new, [len(flat)]])

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many shingles each held set shares with ``own``."""
        if not len(self.values):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        start, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        place = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
        return np.bincount(self.owner[place], minlength=self.n)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, of a tile of sets that are held (role 0, a
    bounded number of shingles) with those that pass by (role 1): only the
    links that join two components are returned."""
    tile: tuple = ()
    sets: list[np.ndarray] = []
    parts: list[int] = []
    root: dict[int, int] = {}
    index = size = label = None

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        role, part = batch.column(3).to_numpy(), batch.column(4).to_pylist()
        out: list[tuple[int, int]] = []
        for k, own in enumerate(_lists(batch.column(5))):
            if keys[k] != tile:
                tile, sets, parts, root, index = keys[k], [], [], {}, None
            if not role[k]:
                sets.append(own)
                parts.append(part[k])
                continue
            if index is None:
                index, size, label = Index(sets), np.array([len(s) for s in sets], np.int64), np.array(parts, np.int64)
            if (label == part[k]).all():
                continue
            near = _similar(index.shared(own), size, len(own)) & (label != part[k])
            for other in np.unique(label[near]).tolist():
                x, y = top(part[k]), top(other)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(part[k], other), max(part[k], other)))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _with_sets(roles: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``roles`` (rep and others) with the shingles of each rep; a text is
    shingled once, whatever number of roles it has."""
    wanted = written(roles.select(F.col("rep").alias("doc_id")).distinct(), "near-wanted")
    few = wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(width), "doc_id long, shingles array<long>")
    return roles.join(sets, roles["rep"] == sets["doc_id"]).drop("doc_id")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  The pairs of an
    ``a`` are dealt into ``chunk``s by their number, and each chunk gets a copy
    of its set, which the others then pass by."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a")
    one = dealt.select("a", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("role"), F.col("b").alias("rep"))
    heads = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("a").alias("rep"))
    rows = _with_sets(one.unionAll(heads), docs, width).select("a", "chunk", "role", "rep", "shingles")
    return _streamed(rows, ["a", "chunk"], _against_head, "a long, b long")


def _joining(rest: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links (a, b) between the components of each group of ``rest``: rows (a:
    the group, rep, part: its component, n: its shingles).  Sets outside the
    group's largest component are held in tiles of some TILE shingles, and all
    the group's sets pass by each tile in chunks of no less than a tile, so
    that what is copied stays within twice the number of tiles."""
    sums = rest.groupBy("a", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    sums = sums.groupBy("a").agg(F.max(F.struct("k", "part"))["part"].alias("most"), F.sum("n").alias("whole"), F.max(F.struct("k", "part", "n"))["n"].alias("held"))
    minor = F.col("whole") - F.col("held")
    chunk = F.greatest(F.lit(CHUNK_SHINGLES), F.least(minor, F.lit(TILE)))
    plan = sums.select("a", "most", F.greatest(F.ceil(minor / TILE), F.lit(1)).cast("int").alias("tiles"), F.ceil(F.col("whole") / chunk).cast("int").alias("chunks"))
    dealt = rest.join(plan, "a")
    h = F.xxhash64("rep")
    tiles, chunks = F.sequence(F.lit(0), F.col("tiles") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
    held = dealt.filter("part != most").select("a", F.pmod(h, "tiles").cast("int").alias("tile"), F.explode(chunks).alias("chunk"), F.lit(0).alias("role"), "part", "rep")
    passing = dealt.select("a", F.explode(tiles).alias("tile"), F.pmod(F.xxhash64("rep", F.lit(1)), "chunks").cast("int").alias("chunk"), F.lit(1).alias("role"), "part", "rep")
    rows = _with_sets(held.unionAll(passing), docs, width).select("a", "tile", "chunk", "role", "part", "shingles")
    return _streamed(rows, ["a", "tile", "chunk"], _across, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, universe: int = UNIVERSE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    signed = docs.select("doc_id", "text").mapInArrow(_signatures(width, bands, rows, universe, seed), "doc_id long, n long, d1 long, d2 long, keys array<long>")
    signed = written(signed, "near-signatures")
    classes = signed.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
    # Equal sets have equal keys, so any row's will do.
    classes = written(classes.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "near-classes")
    placed = classes.select("rep", "n", F.explode("keys").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = written(placed.join(buckets, "key").select("key", "rep", "n", "a", "members"), "near-members")
    pairs = shared.filter("rep > a").select("a", F.col("rep").alias("b")).distinct()
    reached = components(_confirmed(pairs, docs, width))
    # Buckets of more than two classes that are not one component yet; those
    # with the same smallest class are one group.
    parts = shared.filter("members > 2").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    parts = parts.select("key", "rep", "n", "a", F.coalesce("component", "rep").alias("part"))
    mixed = parts.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo != hi").select("key")
    rest = written(parts.join(mixed, "key").select("a", "rep", "n", "part").distinct(), "near-rest")
    known = classes.join(reached, F.col("rep") == F.col("node"), "left")
    known = known.select("d1", "d2", "n", "rep", "copies", F.coalesce("component", "rep").alias("component"))
    if rest.limit(1).count():
        again = components(_joining(rest, docs, width)).select("node", F.col("component").alias("joined"))
        known = known.join(again, F.col("component") == F.col("node"), "left").withColumn("component", F.coalesce("joined", "component"))
    # Only rows of other classes than their own have to be told.
    known = known.filter("copies > 1 or component != rep").select("d1", "d2", "n", "component")
    out = signed.select("doc_id", "d1", "d2", "n").join(known, ["d1", "d2", "n"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without those that ``near_duplicates`` does not keep; rows that
    repeat an id are folded into one.  All columns are kept."""
    found, gone, twice = near_duplicates(docs, width), fresh(docs, "__gone"), fresh(docs, "__twice")
    out = written(found.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct(), "near-gone")
    kept = docs.join(out, F.col("doc_id") == F.col(gone), "left_anti")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias(twice + "n"))
    repeated = written(repeated.filter(F.col(twice + "n") > 1).select(F.col("doc_id").alias(twice)), "near-repeated")
    if not repeated.limit(1).count():
        return kept
    rank = fresh(docs, "__rank")
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    once = kept.join(repeated, F.col("doc_id") == F.col(twice), "left_semi").withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)
    return kept.join(repeated, F.col("doc_id") == F.col(twice), "left_anti").unionByName(once)
