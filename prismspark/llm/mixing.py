"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words that the mix takes are cut into blocks of equal size.  Blocks go to
the sources by highest quotients (target / (2k + 1)), each source's blocks go to
groups of its shards the same way, and each group's to its shards, which gives
an integer quota per shard; within a shard the quota is met by a seeded choice
among the blocks of its word stream.

A shard holds documents of one source, dealt by a hash of the row, so a source
with most of the rows spreads over many shards; their size stays the same
whatever the table's.  A block may be taken at most as often as the source's
cap allows.  Rows are numbers and keys until all is decided; only then the words
are cut from the texts.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; rows that are alike in all columns
are numbered copies, each with its own place in a word stream; an empty table
gives an empty result; sources that are empty get target 0.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.llm.storage import map_rows, small_batches, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2
BLOCK_WORDS = 64
#: Words that a shard aims at, and shards that a group of them aims at.
SHARD_WORDS, GROUP_SHARDS = 65_536, 1024
#: Sources are read by the driver, one row each; more than this is refused.
MAX_SOURCES = 100_000
SEED = 20


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight, none above ``cap`` times its
    size; what is cut off goes to the others by weight until none is above."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def apportion(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Laguë: ``seats`` to the highest quotients votes / (2k + 1), none
    above its cap; ties to the earlier one.  Bisection finds a quotient that
    not too many seats reach; the rest are handed out one by one."""
    if sum(caps) <= seats:
        return list(caps)
    caps = [c if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]

    def reach(t: float) -> list[int]:
        return [min(c, int((v / t + 1) / 2)) for v, c in zip(votes, caps, strict=True)]

    low, high = 0.0, 2 * max(votes, default=0.0) + 1
    for _ in range(100):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if sum(reach(mid)) <= seats else (mid, high)
    out = reach(high)
    heap = [(-v / (2 * k + 1), i) for i, (v, k, c) in enumerate(zip(votes, out, caps, strict=True)) if k < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _quotas(by: str, cap: int):
    """Adds quota: the seats of a group of rows, apportioned among them by
    words; none gets more than ``cap`` times its blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by)
        quota = apportion([float(w) for w in rows["words"]], int(rows["seats"].iloc[0]), [cap * int(b) for b in rows["blocks"]])
        return rows.drop(columns=["words", "seats"]).assign(quota=quota)

    return run


def _size():
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")


def _row_key(docs: DataFrame, seed: int) -> Column:
    """A hash of the whole row (maps aside, which have no hash)."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, row, copies) of all different rows, written once:
    texts are read once.  row: a hash of the row."""
    rows = docs.select("doc_id", "source", _size().alias("size"), _row_key(docs, seed).alias("row"))
    return written(rows.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")


def allocated(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: int, block: int, seed: int) -> DataFrame:
    """(doc_id, source, size, row, copy, copies, source_size, target, s, g,
    shard, start, quota, blocks, taken_blocks) of every copy of every row.
    taken_blocks: an array of (first, stop, times), the row's words in each
    block and how often they are taken; start: its place in the shard's words."""
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # by code point
    n = [int(r["n"]) for r in rows]
    aim = targets(n, [weights[i % len(weights)] for i in range(len(n))], share, cap)
    seats = apportion(aim, round(sum(aim) / block), [cap * -(-x // block) for x in n])
    groups = [max(1, -(-x // (SHARD_WORDS * GROUP_SHARDS))) for x in n]
    plan = spark.createDataFrame(
        [(i, r["source"], x, a, q, g, max(1, -(-x // (SHARD_WORDS * g)))) for i, (r, x, a, q, g) in enumerate(zip(rows, n, aim, seats, groups, strict=True))],
        "s int, name string, source_size long, target double, seats long, groups long, shards long",
    )
    each = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    named = each.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name")))  # MAX_SOURCES rows
    named = named.withColumn("h", F.xxhash64("row", "copy"))
    dealt = named.withColumns({"g": F.pmod("h", "groups"), "shard": F.pmod(F.xxhash64("h"), "shards")})
    per_shard = dealt.groupBy("s", "g", "shard", "seats").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    # A source has a group for each SHARD_WORDS * GROUP_SHARDS words.
    per_group = per_shard.groupBy("s", "g", "seats").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
    per_group = per_group.groupBy("s").applyInPandas(_quotas("g", cap), "s int, g long, blocks long, quota long")
    per_shard = per_shard.drop("seats").join(per_group.select("s", "g", F.col("quota").alias("seats")), ["s", "g"])
    per_shard = per_shard.select("s", "g", "shard", "words", "blocks", "seats").groupBy("s", "g").applyInPandas(_quotas("shard", cap), "s int, g long, shard long, blocks long, quota long")
    # One word stream a shard, its documents in seeded order.
    stream = Window.partitionBy("s", "g", "shard").orderBy("h", "doc_id", "row", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("stop", F.sum("size").over(stream)).withColumn("start", F.col("stop") - F.col("size"))
    chosen = placed.join(per_shard, ["s", "g", "shard"])
    # Block b is taken quota div blocks times, and once more if its place in a
    # seeded order of the shard's blocks, pmod(step * b + turn, blocks), is
    # under the remainder; step is prime and above any number of blocks.
    turn = F.pmod(F.xxhash64(F.lit(seed), "s", "g", "shard", F.lit("turn")), F.lit(1 << 30))
    step = F.lit(2_147_483_647).cast("long")
    blocks = F.greatest(F.col("blocks"), F.lit(1))
    every = F.expr("quota div greatest(blocks, 1)")
    rest = F.col("quota") - every * F.col("blocks")

    def words_of(b):
        place = F.pmod(b * F.pmod(step, blocks) + turn, blocks)
        return F.struct(
            (F.greatest("start", b * block) - F.col("start")).alias("first"),
            (F.least("stop", (b + 1) * block) - F.col("start")).alias("stop"),
            (every + F.when(place < rest, 1).otherwise(0)).alias("times"),
        )

    held = F.transform(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}")), words_of)
    none = F.array().cast("array<struct<first:bigint,stop:bigint,times:bigint>>")
    own = ["doc_id", "source", "size", "row", "copy", "copies", "source_size", "target", "s", "g", "shard", "start", "quota", "blocks"]
    return chosen.select(*own, F.when(F.col("size") > 0, held).otherwise(none).alias("taken_blocks"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row."""
    found = allocated(sized(docs, seed), weights, share, cap, block, seed)
    taken = F.aggregate("taken_blocks", F.lit(0).cast("long"), lambda acc, b: acc + (b["stop"] - b["first"]) * b["times"])
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _texts(cap: int, at: int, spans: int):
    """The taken words of each row, once for each time they are taken: blocks
    that follow one another stay as they stand in the text."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for k, (text, blocks) in enumerate(zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True)):
                if not blocks:
                    continue
                ends = None
                for time in range(1, cap + 1):
                    taken: list[list[int]] = []
                    for b in blocks:
                        if b["times"] >= time:
                            if taken and taken[-1][1] == b["first"]:
                                taken[-1][1] = b["stop"]
                            else:
                                taken.append([b["first"], b["stop"]])
                    if not taken:
                        break
                    rows.append(k)
                    if taken == [[0, blocks[-1]["stop"]]]:
                        texts.append(text)
                        continue
                    ends = ends or [m.span() for m in word.finditer(text)]
                    texts.append("\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in taken))
            out = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(out.columns) if i != spans]
            names = [c for i, c in enumerate(batch.schema.names) if i != spans]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each row's taken words, and
    a further row for each time that words are taken again.  Rows of which
    nothing is taken go."""
    small_batches(docs.sparkSession)
    sizes = sized(docs, seed)
    found = allocated(sizes, weights, share, cap, block, seed)
    found = found.filter(F.exists("taken_blocks", lambda b: b["times"] > 0)).select(F.col("doc_id").alias("__id"), F.col("row").alias("__key"), "copies", F.col("taken_blocks").alias("__blocks"))
    keyed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keyed = keyed.withColumn("__row", _row_key(keyed, seed))
    same = (F.col("__row") == F.col("__key")) & F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("__id"))
    flat = keyed.join(found.filter("copies = 1"), same).drop("__row", "__id", "__key", "copies")
    if sizes.filter("copies > 1").limit(1).count():
        # Rows that are alike in all columns: one text, and the blocks of each copy.
        alike = sizes.filter("copies > 1").select(F.col("row").alias("__twice"))
        once = keyed.join(alike, F.col("__row") == F.col("__twice"), "left_semi").dropDuplicates([f"c{docs.columns.index('doc_id')}", "__row"])
        flat = flat.unionByName(once.join(found.filter("copies > 1"), same).drop("__row", "__id", "__key", "copies"))
    return map_rows(flat, _texts(cap, docs.columns.index("text"), len(docs.columns)), docs.schema.fields)
