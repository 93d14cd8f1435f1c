"""Complexity of a set of spectra, from sums by channel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismspark.operators.evaluate import usable


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "y", F.posexplode("x").alias("ch", "v"))


def mean_spectrum(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., ch, value)."""
    return _long(rows).groupBy(*keys, F.col("ch").cast("long").alias("ch")).agg(F.avg("v").alias("value"))


def fisher_ratio(rows: DataFrame) -> DataFrame:
    """One row: sum of squares between classes over that within them."""
    per = _long(rows).groupBy("y", "ch").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.var_pop("v").alias("var"))
    all_ = per.groupBy("ch").agg((F.sum("s") / F.sum("n")).alias("mean"))
    both = per.join(all_, "ch").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("mean"), 2)).alias("b"), F.sum(F.col("n") * F.col("var")).alias("w"))
    return both.select(F.try_divide("b", "w").alias("fisher_ratio"))


def spectral_entropy(rows: DataFrame) -> DataFrame:
    """One row: entropy (nats) of the normalised mean absolute spectrum."""
    per = _long(rows).groupBy("ch").agg(F.avg(F.abs("v")).alias("a"))
    p = per.crossJoin(F.broadcast(per.agg(F.sum("a").alias("t")))).select(F.try_divide("a", "t").alias("p"))  # one row
    return p.agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")))).alias("spectral_entropy"))


def covariance(rows: DataFrame) -> DataFrame:
    """(i, j, c): sample covariance of channels, of the spectra that hold finite
    numbers alone and are of the most frequent length.  Each task multiplies its
    batches, centred on the overall mean, into one matrix, and sends the part
    from the diagonal on as one array a channel; the arrays are added by place."""
    n, mean, _ = moments(rows)
    k = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for _, _, x in usable(batch, 0, 1):
                if x.shape[1] == k:
                    total += (x - mean).T @ (x - mean)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(k)), "s": pa.array([total[i, i:] for i in range(k)], pa.list_(pa.float64()))})

    parts = rows.select(F.lit(0).alias("y"), "x").mapInArrow(products, "i long, s array<double>")

    def added(group: pa.Table) -> pa.Table:
        i, total = group["i"][0].as_py(), sum(np.array(v) for v in group["s"].to_pylist())
        other, c = np.arange(i, k), total / (n - 1) if n > 1 else np.full(k - i, np.nan)
        both = np.concatenate([np.arange(k - i), np.arange(1, k - i)])  # the diagonal once
        left = np.concatenate([np.full(k - i, i), other[1:]])
        right = np.concatenate([other, np.full(k - i - 1, i)])
        return pa.table({"i": left, "j": right, "c": pa.array(c[both], mask=np.isnan(c[both]))})

    return parts.groupBy("i").applyInArrow(added, "i long, j long, c double")  # an array a task


def participation_ratio(rows: DataFrame) -> DataFrame:
    """One row: tr(C)^2 / sum C_ij^2, which is (sum of eigenvalues)^2 over the
    sum of their squares."""
    c = covariance(rows)
    return c.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))), 2) / F.sum(F.col("c") * F.col("c"))).alias("participation_ratio"))


def roughness(rows: DataFrame) -> DataFrame:
    """One row: mean squared first difference along the axis."""
    from prismspark.functions.native import differences

    steps = rows.select(F.explode(differences(F.col("x"))).alias("d"))
    return steps.agg(F.avg(F.col("d") * F.col("d")).alias("roughness"))


#: Directions that the sketch of ``leading_variances`` keeps beyond those asked
#: for, the passes that sharpen it, and the seed of its first directions.
OVERSAMPLE, PASSES, SKETCH_SEED = 16, 3, 11
#: Channels up to which all directions are taken at once.
NARROW = 128


def _shares(rows: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sum over spectra of (x - mean) (x - mean)' basis.  A task multiplies its
    batches into one matrix of channels by directions, whose rows are added by
    channel: no matrix of channels by channels is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for batch in batches:
            for _, _, x in usable(batch, 0, 1):
                if x.shape[1] == len(mean):
                    part = x - mean
                    total += part.T @ (part @ basis)
        yield pa.RecordBatch.from_pydict({"ch": pa.array(np.arange(len(mean))), "s": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select(F.lit(0).alias("y"), "x").mapInArrow(run, "ch long, s array<double>")

    def added(group: pa.Table) -> pa.Table:
        return pa.table({"ch": group["ch"].slice(0, 1), "s": pa.array([sum(np.array(v) for v in group["s"].to_pylist())], pa.list_(pa.float64()))})

    # An array a task for each channel; a row a channel comes to the driver.
    sums = parts.groupBy("ch").applyInArrow(added, "ch long, s array<double>").orderBy("ch").toArrow()
    return np.array(sums["s"].to_pylist(), float).reshape(basis.shape)


def moments(rows: DataFrame) -> tuple[int, np.ndarray, float]:
    """Number of spectra that hold finite numbers alone and are of the most
    frequent length (ties to the longer), their mean, and their summed squared
    distance from it; a row a length and task moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, _, x in usable(batch, 0, 1):
                n, mean, spread = held.get(x.shape[1], (0, np.zeros(x.shape[1]), 0.0))
                own = x.mean(axis=0)
                gap, both = own - mean, n + len(x)
                spread += float(((x - own) ** 2).sum() + gap @ gap * n * len(x) / both)
                held[x.shape[1]] = (both, mean + gap * len(x) / both, spread)
        out = sorted(held.items())
        yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in out], pa.int64()), "n": pa.array([v[0] for _, v in out], pa.int64()), "m": pa.array([v[1] for _, v in out], pa.list_(pa.float64())), "q": pa.array([v[2] for _, v in out], pa.float64())})

    parts = rows.select(F.lit(0).alias("y"), "x").mapInArrow(run, "k long, n long, m array<double>, q double")
    best = parts.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("k")).first()
    if best is None or not best["k"]:
        return 0, np.zeros(0), 0.0
    own = parts.filter(F.col("k") == best["k"])
    mean = own.select("n", F.posexplode("m").alias("ch", "v")).groupBy("ch").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).orderBy("ch").toArrow()["v"].to_numpy()
    means = F.array(*[F.lit(float(v)) for v in mean])
    square = F.aggregate(F.zip_with("m", means, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    total = own.agg(F.sum(F.col("q") + F.col("n") * square)).first()[0]
    return best["n"], mean, float(total)


def leading_variances(rows: DataFrame, directions: int, passes: int = PASSES, seed: int = SKETCH_SEED, known: tuple[int, np.ndarray, float] | None = None) -> tuple[np.ndarray, float, int]:
    """The largest variances along principal directions, the total variance, and
    how many channels there are, by a randomised range finder: seeded directions
    are multiplied with the spectra's covariance, made orthogonal, and multiplied
    again; each pass reads the spectra once.  ``known`` are their moments."""
    n, mean, total = known or moments(rows)
    k = min(len(mean), directions + OVERSAMPLE)
    if n < 2 or not k:
        return np.zeros(0), 0.0, len(mean)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(mean), k)))[0]
    for _ in range(passes if k < len(mean) else 1):
        basis = np.linalg.qr(_shares(rows, basis, mean))[0]
    small = basis.T @ _shares(rows, basis, mean) / (n - 1)
    return np.maximum(np.linalg.eigvalsh((small + small.T) / 2)[::-1], 0), total / (n - 1), len(mean)


def cumulative_share(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """(component, variance, cumulative): principal variances until they explain
    ``share`` of the total, and that running share.  The sketch is widened until
    it is reached, so work grows with the dimension found, not with the square
    of the channels."""
    known = moments(rows)
    # So few channels are no more than a sketch: all directions in one pass.
    spark, wanted = rows.sparkSession, len(known[1]) if len(known[1]) <= NARROW else 16
    while True:
        variances, total, channels = leading_variances(rows, wanted, known=known)
        # A sketch's last directions are rough: those asked for count.
        kept = variances if len(variances) == channels else variances[:wanted]
        if len(kept) == channels or total <= 0 or kept.sum() >= share * total:
            break
        wanted *= 2
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(kept, 1)], "component long, variance double")
    before = F.sum("variance").over(Window.orderBy("component"))  # a row a component
    found = table.withColumn("cumulative", F.try_divide(before, F.lit(float(total))))
    return found.filter(F.coalesce(F.col("cumulative") - F.try_divide("variance", F.lit(float(total))), F.lit(0.0)) < share * (1 - 1e-12))


def intrinsic_dimension(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: components that explain ``share`` of the variance.  Spectra that
    are null, hold nulls or numbers that are not finite, or are of another length
    than most take no part; without a spread there is no dimension (0)."""
    found = cumulative_share(rows, share).filter("variance > 0")
    return found.agg(F.count(F.lit(1)).alias("dimension"))


def report(rows: DataFrame) -> DataFrame:
    """(measure, value) of the measures above; each reads the spectra on its own,
    the participation ratio twice."""
    frames = [fisher_ratio(rows), spectral_entropy(rows), participation_ratio(rows), roughness(rows)]
    out = None
    for f in frames:
        row = f.select(F.lit(f.columns[0]).alias("measure"), F.col(f.columns[0]).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
