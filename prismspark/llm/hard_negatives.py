"""Hard negatives by lists that the anchors of a cluster share.

Anchors of one label are put to the nearest of a few centroids.  For a cluster
and a block of candidates, the angle between a candidate and the centroid, less
the widest angle between a member and the centroid, bounds the candidate's
inner product with every member from above, up to the member's own length; the
block is sorted by that bound once, and all members walk the same list.  A
member leaves it when the bound of what is left cannot reach what it still
wants: for positives the k-th best score, for negatives also the floor of each
positive's window.  The candidates of the cluster's label are walked for the
positives, and the others, once the blocks' positives are merged, for the
negatives; so each candidate is sorted and scored once a cluster.

Candidates are dealt into blocks by hash, anchors into groups by cluster, and
each pair of a block and a group is a task's work; only the winners leave it.

Defined results: rows whose label or vector is null, or whose vector holds null
or non-finite components, take no part, nor do rows without an id; rows that
repeat an id are rows of their own; a missing component weighs 0, so vectors of
different length still score; an anchor without another row of its label has no
rows, and a positive with a score below 0 has no negatives, as its window is
empty; scores are whole numbers of up to 38 digits (larger ones are cut to
that), and those beyond a long are returned as its last value; other columns
are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.llm.storage import written
from prismspark.llm.topk_search import finite

SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 5, (80, 100)
#: Components of the vectors of one block of candidates, and the most rows in it.
BLOCK_CELLS, BLOCK_ROWS = 2 << 20, 32_768
#: Anchors of one group, members that share a list, and centroids at most.
GROUP, MEMBERS, CENTROIDS = 4_096, 512, 256
#: Anchors that centroids are fitted on; all anchors are assigned.
FIT_ROWS, FIT_ROUNDS, SEED = 4_096, 6, 13
#: List entries scored at a time.
STRIDE = 1_024
_SLACK = 1e-6


def _dense(column: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, bool]:
    """Whole numbers floor(scale * x), padded with 0, and whether doubles hold
    100 times any inner product of them exactly."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    exact = float(np.abs(values).max(initial=0.0)) ** 2 * max(1, out.shape[1]) * 100 < 2.0**53
    return out, exact


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector keeps zeros.  Scaled first, so
    that no square leaves the range of doubles."""
    top = np.abs(rows).max(axis=1, initial=0.0)[:, None]
    scaled = np.divide(rows, top, out=np.zeros_like(rows), where=top > 0)
    norm = np.sqrt((scaled * scaled).sum(axis=1))[:, None]
    return np.divide(scaled, norm, out=np.zeros_like(rows), where=norm > 0), (top * norm)[:, 0]


def shared_list(members: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates' order for a cluster, their bounds in that order, and the
    members' lengths: a member's length times a bound is at least its score.

    With centroid c, a member m and a candidate x, the angle between m and x is
    at least angle(x, c) - angle(m, c)."""
    unit, length = _units(members)
    centre = _units(unit.sum(axis=0, keepdims=True))[0][0]
    angles = np.arccos(np.clip(unit @ centre, -1, 1))
    widest = float(angles[length > 0].max(initial=0.0))
    other, far = _units(candidates)
    apart = np.arccos(np.clip(other @ centre, -1, 1))
    bound = far * np.minimum(1.0, np.cos(np.maximum(0.0, apart - widest)) + _SLACK)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order], length


def _walk(members: np.ndarray, candidates: np.ndarray, wanted, take, exact: bool) -> int:
    """Scores the shared list in strides for members that still want more.
    ``wanted(member)`` is the least score that could still count; ``take(member,
    places, scores)`` gets the scores of a stride.  Returns how many were scored."""
    if not len(candidates):
        return 0
    order, bound, length = shared_list(members, candidates)
    active, scored = np.arange(len(members)), 0
    whole = candidates if exact else None
    for at in range(0, len(order), STRIDE):
        # Bounds are of doubles, so they are let out a little.
        reach = length[active] * bound[at]
        reach = reach + np.abs(reach) * _SLACK + _SLACK
        active = active[[r >= wanted(m) for m, r in zip(active.tolist(), reach.tolist(), strict=True)]]
        if not len(active):
            break
        places = order[at : at + STRIDE]
        if exact:
            scores = members[active] @ whole[places].T
        else:
            own = [[int(x) for x in row] for row in members[active]]
            others = [[int(x) for x in row] for row in candidates[places]]
            scores = np.array([[sum(a * b for a, b in zip(p, q, strict=True)) for q in others] for p in own], object).reshape(len(active), len(places))
        scored += scores.size
        for row, m in enumerate(active.tolist()):
            take(m, places, scores[row])
    return scored


class _Best:
    """The k first by score, then by id, of scores met in pieces."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> float:
        return -self.rows[-1][0] if len(self.rows) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.rows) == self.k:
            keep = scores >= self.least
            scores, ids = scores[keep], ids[keep]
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= least
            scores, ids = scores[keep], ids[keep]
        if len(scores):
            order = np.lexsort((ids, -scores))[: self.k]
            more = [(-int(s), int(i)) for s, i in zip(scores[order], ids[order], strict=True)]
            self.rows = sorted(self.rows + more)[: self.k]


#: Scores between tasks.
WHOLE = 10**38 - 1


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table({n: pa.array([Decimal(max(-WHOLE, min(WHOLE, x))) for x in c] if pa.types.is_decimal(k) else c, k) for c, (n, k) in zip(columns, kinds.items(), strict=True)})


SCORE = pa.decimal128(38, 0)


def _parts(group: pa.Table, scale: int):
    rows, exact = _dense(group["vector"], scale)
    anchor = group["anchor"].to_numpy(zero_copy_only=False)
    get = lambda name: group[name].to_numpy(zero_copy_only=False)
    held, asked = np.flatnonzero(~anchor), np.flatnonzero(anchor)
    cluster = get("cluster")[asked]
    labels, order = get("label"), np.argsort(cluster, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1) if len(order) else []:
        for at in range(0, len(part), MEMBERS):
            members = asked[part[at : at + MEMBERS]]
            same = labels[held] == labels[members[0]]
            yield rows, exact, members, held[same], held[~same]


def _positives(k: int, scale: int):
    """A block's and a group's rows to the block's k first positives an anchor."""

    def run(group: pa.Table) -> pa.Table:
        row, ids, out = group["row"].to_numpy(), group["id"].to_numpy(), []
        for rows, exact, members, same, _ in _parts(group, scale):
            best = [_Best(k) for _ in members]

            def take(m: int, places: np.ndarray, scores: np.ndarray, members=members, same=same, best=best) -> None:
                other = row[same[places]] != row[members[m]]
                best[m].add(scores[other], ids[same[places]][other])

            _walk(rows[members], rows[same], lambda m, best=best: best[m].least, take, exact)
            out += [(int(row[a]), i, -s) for a, b in zip(members.tolist(), best, strict=True) for s, i in b.rows]
        return _table(out, row=pa.int64(), positive_id=pa.int64(), positive_score=SCORE)

    return run


def _negatives(k: int, scale: int, low: int, high: int):
    """A block's and a group's rows to the block's k first negatives of each
    anchor and positive."""

    def run(group: pa.Table) -> pa.Table:
        row, ids, out = group["row"].to_numpy(), group["id"].to_numpy(), []
        scores_of = group["positives"].combine_chunks()
        for rows, exact, members, _, others in _parts(group, scale):
            windows = []
            for a in members.tolist():
                found = sorted({int(p) for p in scores_of[a].as_py() or []})
                # low * p <= 100 * n <= high * p, in whole numbers
                windows.append([(p, -((-low * p) // 100), (high * p) // 100, _Best(k)) for p in found if low * p <= high * p])

            def wanted(m: int, windows=windows) -> float:
                return min((max(floor, b.least) for _, floor, _, b in windows[m]), default=np.inf)

            def take(m: int, places: np.ndarray, scores: np.ndarray, windows=windows, others=others) -> None:
                for _, floor, top, best in windows[m]:
                    keep = (scores >= floor) & (scores <= top)
                    if keep.any():
                        best.add(scores[keep], ids[others[places[keep]]])

            _walk(rows[members], rows[others], wanted, take, exact)
            out += [(int(row[a]), p, i, -s) for a, w in zip(members.tolist(), windows, strict=True) for p, _, _, b in w for s, i in b.rows]
        return _table(out, row=pa.int64(), positive_score=SCORE, negative_id=pa.int64(), negative_score=SCORE)

    return run


def centroids(vectors: np.ndarray, n: int, rounds: int = FIT_ROUNDS, seed: int = SEED) -> np.ndarray:
    """``n`` unit centroids of the rows by spherical k-means."""
    unit, length = _units(vectors)
    unit = unit[length > 0]
    if not len(unit):
        return np.zeros((1, vectors.shape[1]))
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:n]]
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        moved, size = _units(sums)
        centres = np.where(size[:, None] > 0, moved, centres)
    return centres


def _nearest(centres: np.ndarray, scale: int):
    """Adds to each anchor the centroid that it is nearest to."""

    def run(batches):
        for batch in batches:
            rows, _ = _dense(pa.chunked_array([batch.column("vector")]), scale)
            unit, wide = _units(rows)[0], min(rows.shape[1], centres.shape[1])
            near = np.argmax(unit[:, :wide] @ centres[:, :wide].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "cluster"])

    return run


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for each row of ``vectors`` (vec_id, embedding, label) that
    ``is_anchor`` names, by inner product of floor(scale * component).  The two
    columns may use ``id`` and ``label``; ``label`` is a row's label as taken."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))
    rows = rows.select("id", "vector", label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "mining-vectors")
    n, asked, labels, dims = rows.agg(F.count(F.lit(1)), F.sum(F.col("asked").cast("long")), F.approx_count_distinct("label"), F.max(F.size("vector"))).first()
    dims, asked = max(1, dims or 1), asked or 0
    sample = rows.filter("asked").orderBy(F.xxhash64("id", "row")).limit(FIT_ROWS).select("vector").toArrow()
    fitted = _dense(sample["vector"], scale)[0] if len(sample) else np.zeros((1, dims))
    # Clusters of some MEMBERS anchors of one label.
    centres = centroids(fitted, max(1, min(CENTROIDS, asked // (MEMBERS * max(1, labels)))))
    kind = rows.schema["vector"].dataType.simpleString()
    anchors = rows.filter("asked").select("row", "id", "vector", "label").mapInArrow(_nearest(centres, scale), f"row long, id long, vector {kind}, label long, cluster int")
    # Clusters of one label: a number of their own, dealt to groups whole unless
    # they would fill several.
    groups = max(1, -(-asked // GROUP))
    # A cluster may be dealt over several groups: it then is several smaller ones.
    own = F.xxhash64("label", "cluster")
    spread = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(max(1, -(-groups // max(1, len(centres) * max(1, labels))))))
    anchors = anchors.withColumn("g", F.pmod(own + spread, F.lit(groups)).cast("int")).withColumn("cluster", own)
    anchors = written(anchors, "mining-anchors")
    tasks = spark.sparkContext.defaultParallelism
    size = max(256, min(BLOCK_ROWS, BLOCK_CELLS // dims, -(-n // (2 * tasks))))
    blocks = max(1, -(-n // size))
    c = F.pmod(F.xxhash64("row"), F.lit(blocks))
    held = rows.select("row", "id", "vector", "label", F.lit(False).alias("anchor"), F.lit(None).cast("long").alias("cluster"), c.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.select("*", F.lit(True).alias("anchor"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("c"))

    # As many partitions as pairs, within bounds: by their bytes few tasks would get them all.
    parts = int(max(1, min(blocks * groups, max(4 * tasks, blocks * groups // 8))))
    found = held.unionByName(dealt(anchors)).repartition(parts, "c", "g").groupBy("c", "g").applyInArrow(_positives(positives, scale), "row long, positive_id long, positive_score decimal(38,0)")
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    found = written(found.withColumn("p", F.row_number().over(first)).filter(F.col("p") <= positives), "mining-positives")
    scores = found.groupBy("row").agg(F.collect_list("positive_score").alias("positives"))  # ``positives`` a row at most
    seeking = written(anchors.join(scores, "row"), "mining-anchors")
    held = held.withColumn("positives", F.lit(None).cast("array<decimal(38,0)>"))
    low, high = window
    near = held.unionByName(dealt(seeking)).repartition(parts, "c", "g").groupBy("c", "g").applyInArrow(_negatives(negatives, scale, low, high), "row long, positive_score decimal(38,0), negative_id long, negative_score decimal(38,0)")
    # Positives of equal score have the same negatives.
    best = Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    out = found.join(near, ["row", "positive_score"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    cut = lambda name: F.greatest(F.least(F.col(name), F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long").alias(name)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", cut("positive_score"), cut("negative_score"))
