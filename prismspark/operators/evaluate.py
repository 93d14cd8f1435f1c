"""Evaluation of predictions: accuracies, confusion, learning curves, pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.functions.kernels import fit_power_law, power_law_deviations
from prismspark.operators.sampling import fresh


def hit(pred: str = "pred", truth: str = "gt") -> Column:
    return F.when(F.col(pred) == F.col(truth), F.lit(1.0)).otherwise(F.lit(0.0))


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, accuracy)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(hit()).alias("accuracy"))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: mean, least, largest and population deviation of a value that
    may be missing, and how many rows have it or not."""
    v = F.when(~F.isnan(value), F.col(value))
    return rows.agg(
        F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("largest"), F.stddev_pop(v).alias("std"),
        F.count(v).alias("n_ok"), (F.count(F.lit(1)) - F.count(v)).alias("n_failed"),
    )


def by_size(rows: DataFrame) -> DataFrame:
    """(n, trials, mean, std): accuracy of trials of each size, over trials."""
    per = rows.groupBy("n", "seed", "arm").agg(F.avg(hit()).alias("accuracy"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("trials"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def learning_curve(rows: DataFrame) -> DataFrame:
    """(arm, n, trials, error, std): error of an arm's trials of each size, and
    the population deviation of their accuracy, over trials."""
    per = rows.groupBy("arm", "n", "seed").agg(F.avg(hit()).alias("accuracy"))
    return per.groupBy("arm", "n").agg(F.count(F.lit(1)).alias("trials"), F.avg(1 - F.col("accuracy")).alias("error"), F.stddev_pop("accuracy").alias("std"))


def scaling_law(curve: DataFrame) -> DataFrame:
    """(arm, a, alpha, b): power law of the error over the number of training
    rows, sizes weighted by 1 / (std + 1e-5); each group is one row a size."""

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        a, alpha, b = fit_power_law(pdf["n"].to_numpy(float), pdf["error"].to_numpy(float), 1 / (pdf["std"].to_numpy(float) + 1e-5))
        return pd.DataFrame({"arm": [pdf["arm"].iloc[0]], "a": [a], "alpha": [alpha], "b": [b]})

    return curve.groupBy("arm").applyInPandas(fit, "arm long, a double, alpha double, b double")


def scaling_law_deviations(curve: DataFrame) -> DataFrame:
    """(arm, a, alpha, b, a_std, alpha_std, b_std): the laws of ``scaling_law``
    with the standard deviations of their parameters."""

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        n, error, weight = pdf["n"].to_numpy(float), pdf["error"].to_numpy(float), 1 / (pdf["std"].to_numpy(float) + 1e-5)
        law = fit_power_law(n, error, weight)
        return pd.DataFrame([(pdf["arm"].iloc[0], *law, *power_law_deviations(n, error, law, weight))], columns=["arm", "a", "alpha", "b", "a_std", "alpha_std", "b_std"])

    return curve.groupBy("arm").applyInPandas(fit, "arm long, a double, alpha double, b double, a_std double, alpha_std double, b_std double")


def exponent_difference(curve: DataFrame, base: int = 0) -> DataFrame:
    """(arm, difference, std): each other arm's exponent less that of the base
    arm, and its standard deviation, the arms being independent."""
    laws = scaling_law_deviations(curve)
    against = laws.filter(F.col("arm") == base).select(F.col("alpha").alias("alpha0"), F.col("alpha_std").alias("std0"))  # one row
    found = laws.filter(F.col("arm") != base).crossJoin(F.broadcast(against))
    return found.select("arm", (F.col("alpha") - F.col("alpha0")).alias("difference"), F.sqrt(F.col("alpha_std") * F.col("alpha_std") + F.col("std0") * F.col("std0")).alias("std"))


def normalised_law(curve: DataFrame) -> DataFrame:
    """(arm, n, normalised_error): (f(n) - b) / (f(n0) - b) of each arm's fitted
    law f, with n0 the smallest of the arms' largest sizes; null where f is flat
    because a is 0."""
    last = curve.groupBy("arm").agg(F.max("n").alias("n")).agg(F.min("n").alias("n0"))  # one row
    excess = lambda n: F.col("a") * F.pow(F.col(n).cast("double"), -F.col("alpha"))
    found = curve.join(F.broadcast(scaling_law(curve)), "arm").crossJoin(F.broadcast(last))  # a row an arm
    return found.select("arm", "n", F.try_divide(excess("n"), excess("n0")).alias("normalised_error"))


def paired_delta(rows: DataFrame) -> DataFrame:
    """(n, pairs, mean_delta, std_delta): arm 1 less arm 0 of the same size and
    seed; the sample deviation is null for a single pair."""
    per = rows.groupBy("n", "seed", "arm").agg(F.avg(hit()).alias("accuracy"))
    base = per.filter("arm = 0").select("n", "seed", F.col("accuracy").alias("a0"))
    other = per.filter("arm = 1").select("n", "seed", F.col("accuracy").alias("a1"))
    delta = base.join(other, ["n", "seed"]).withColumn("delta", F.col("a1") - F.col("a0"))
    std = F.when(F.count("delta") > 1, F.stddev_samp("delta"))
    return delta.groupBy("n").agg(F.count("delta").alias("pairs"), F.avg("delta").alias("mean_delta"), std.alias("std_delta"))


def confusion(rows: DataFrame) -> DataFrame:
    """(gt, pred, n, pct): share of each prediction among a class's rows."""
    counts = rows.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("gt")))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, pct) of each value."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (100 * F.col("n") / F.col("__all")).alias("pct"))  # one row


def dominant_class(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, dominant, n): the most frequent value, ties to the smallest."""
    counts = rows.groupBy(group, column).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), column)
    return counts.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(group, F.col(column).alias("dominant"), "n")


#: Rows of one range of a series, about, and ranges that quantiles tell apart.
SPAN, MAX_RANGES = 4_096, 10_000


def in_order(log: DataFrame, series: str, step: str, place: str = "__i", part: str = "__c") -> DataFrame:
    """``log`` with ``place``, the place of each row in its series by step from 1
    (rows of equal steps by their other columns), and ``part``, its range of
    steps.  Ranges lie between quantiles of all steps; rows are numbered within
    them, and what comes before a range is counted, so that no task holds a
    series, however its steps are spaced."""
    rows = log.count()
    cuts = sorted(set(log.approxQuantile(step, [k / n for k in range(1, n)], 0.25 / n))) if (n := min(MAX_RANGES, -(-rows // SPAN))) > 1 else []
    value = F.col(f"`{step}`").cast("double")
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    # Null steps come first, as they sort.
    ranged = log.withColumn(part, F.when(value.isNull(), F.lit(-1)).otherwise(width(value, edges)))
    s, r, o, k, n_ = (fresh(ranged, x) for x in ("s", "r", "o", "k", "n"))
    counts = ranged.groupBy(F.col(f"`{series}`").alias(s), F.col(part).alias(r)).agg(F.count(F.lit(1)).alias(n_))
    before = F.sum(n_).over(Window.partitionBy(s).orderBy(r)) - F.col(n_)
    ties = [F.col(f"`{c}`") for c, kind in log.dtypes if c not in (series, step) and not kind.startswith("map")]
    within = F.row_number().over(Window.partitionBy(f"`{series}`", part).orderBy(f"`{step}`", *ties))
    found = ranged.withColumn(k, within).join(counts.select(s, r, before.alias(o)), F.col(f"`{series}`").eqNullSafe(F.col(s)) & F.col(part).eqNullSafe(F.col(r)))
    return found.select(*[F.col(f"`{c}`") for c in log.columns], (F.col(o) + F.col(k)).alias(place), part)


def width(value: Column, edges: Column) -> Column:
    """How many of the sorted ``edges`` a value reaches, by halving."""
    low_high = F.struct(F.lit(0).alias("l"), F.size(edges).alias("h"))
    rounds = F.sequence(F.lit(1), F.lit(MAX_RANGES.bit_length()))

    def halve(acc: Column, _: Column) -> Column:
        at = F.shiftright(acc["l"] + acc["h"], 1)
        up = F.coalesce(F.get(edges, at) <= value, F.lit(False))
        return F.when(acc["l"] >= acc["h"], acc).otherwise(F.struct(F.when(up, at + 1).otherwise(acc["l"]).alias("l"), F.when(up, acc["h"]).otherwise(at).alias("h")))

    return F.aggregate(rounds, low_high, halve, lambda acc: acc["l"])


def early_stop_wait(log: DataFrame, series: str, step: str, value: str) -> DataFrame:
    """(series, step, value, best, wait): steps since the best value so far.
    The best value and the step of the last improvement are carried from range
    to range of a series."""
    log = log.select(F.col(f"`{series}`").alias(series), F.col(f"`{step}`").alias(step), F.col(f"`{value}`").alias(value))
    i, c = fresh(log, "i"), fresh(log, "c")
    rows = in_order(log, series, step, i, c)

    def carried(frame: DataFrame, column: str, name: str) -> DataFrame:
        """``frame`` with the largest value of a column in earlier ranges."""
        s, r, m = (fresh(frame, x) for x in ("s", "r", "m"))
        per = frame.groupBy(F.col(series).alias(s), F.col(c).alias(r)).agg(F.max(column).alias(m))
        earlier = Window.partitionBy(s).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(s, r, F.max(m).over(earlier).alias(name))
        return frame.join(per, F.col(series).eqNullSafe(F.col(s)) & F.col(c).eqNullSafe(F.col(r))).drop(s, r)

    order = Window.partitionBy(series, c).orderBy(i)
    past, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    top, old, hit_, last, best = (fresh(rows, x) for x in ("top", "old", "hit", "last", "best_so_far"))
    rows = carried(rows, value, top)
    rows = rows.withColumns({best: F.greatest(top, F.max(value).over(past)), old: F.greatest(top, F.max(value).over(before))})
    rows = carried(rows.withColumn(hit_, F.when(F.col(old).isNull() | (F.col(value) > F.col(old)), F.col(i))), hit_, last)
    at = F.greatest(last, F.max(hit_).over(past))
    return rows.select(series, step, value, F.col(best).alias("best"), (F.col(i) - at).cast("long").alias("wait"))


def boxcar(log: DataFrame, series: str, step: str, value: str, half: int) -> DataFrame:
    """``log`` with ``smooth``, the mean of a row and its ``half`` neighbours on
    either side in its series (of those that have a value).  Rows lie in ranges
    as long as a window or ``SPAN``, whichever is more, and visit the ranges
    whose rows have them in their windows."""
    i, c, own = fresh(log, "i"), fresh(log, "c"), fresh(log, "own")
    rows, span = in_order(log, series, step, i, c), max(SPAN, half)
    rows = rows.withColumn(own, F.floor((F.col(i) - 1) / span))
    at = F.pmod(F.col(i) - 1, F.lit(span))
    visits = F.array_compact(F.array(F.col(own), F.when(at < half, F.col(own) - 1), F.when(at >= span - half, F.col(own) + 1)))
    dealt = rows.withColumn(c, F.explode(visits))
    near = Window.partitionBy(f"`{series}`", c).orderBy(i).rowsBetween(-half, half)
    return dealt.withColumn("smooth", F.avg(f"`{value}`").over(near)).filter(F.col(c) == F.col(own)).drop(i, c, own)


def filter_trials(trials: DataFrame, **wanted: list | None) -> DataFrame:
    """Trials whose attributes are among the wanted ones; an attribute with None
    is not asked for.  A trial without a flag (null, or there is no such column)
    has it as False; another attribute that no trial has is an error."""
    flags = {name for name, values in wanted.items() if values and all(isinstance(v, bool) for v in values)}
    lacking = sorted(name for name, values in wanted.items() if name not in trials.columns and name not in flags)
    if lacking:
        raise KeyError(f"trials have no {lacking}; they have {sorted(trials.columns)}")
    for name, values in wanted.items():
        if name in flags:
            held = F.col(f"`{name}`") if name in trials.columns else F.lit(None).cast("boolean")
            trials = trials.filter(F.coalesce(held, F.lit(False)).isin(values))
        elif values is not None:
            trials = trials.filter(F.col(f"`{name}`").isin(values))
    return trials


def paired_by_token(rows: DataFrame, size: str, token: str, arm: str, value: str, order: str, whole: str | None = None) -> DataFrame:
    """(size, pairs, mean_delta): arm 1 less arm 0 of trials that share size and
    token; of several trials of one arm and token the last by order counts.  A
    trial without a token (null or empty) goes by its ``whole`` id, if given."""
    held = F.when(F.col(token) != "", F.col(token).cast("string")) if dict(rows.dtypes)[token] == "string" else F.col(token).cast("string")
    rows = rows.select(F.col(size).alias(size), F.coalesce(held, F.col(whole).cast("string") if whole else held).alias("t"), F.col(arm).alias("arm"), F.col(value).alias("v"), F.col(order).alias("o"))
    last = rows.filter("t is not null").groupBy(size, "t").agg(*[F.max_by(F.when(F.col("arm") == a, F.col("v")), F.when(F.col("arm") == a, F.col("o"))).alias(f"a{a}") for a in (0, 1)])
    return last.filter("a0 is not null and a1 is not null").groupBy(size).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("a1") - F.col("a0")).alias("mean_delta"))


#: Classes that a nearest-centroid classifier may have.
MAX_CLASSES = 1_000


def usable(batch: pa.RecordBatch, y: int, x: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, labels, spectra) by length of the spectra that hold finite numbers
    alone and have a label; ``rows`` are places in the batch."""
    column = batch.column(x)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends, flat = np.cumsum(sizes), column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
    odd = np.cumsum(np.concatenate([[0], ~np.isfinite(values)]))
    whole = (odd[ends] == odd[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False) & batch.column(y).is_valid().to_numpy(zero_copy_only=False)
    labels = batch.column(y).fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[whole]).tolist():
        rows = np.flatnonzero(whole & (sizes == size))
        yield rows, labels[rows], values[(ends[rows] - size)[:, None] + np.arange(size)]


def class_means(rows: DataFrame) -> DataFrame:
    """(cls, ch, m): mean spectrum of each class, of the spectra that hold finite
    numbers alone.  A task adds its spectra up, so a row a class, channel and
    task is all that moves.  Spectra of different length are an error."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, y, values in usable(batch, 0, 1):
                for cls in np.unique(y).tolist():
                    own = held.setdefault((cls, values.shape[1]), [np.zeros(values.shape[1]), 0])
                    own[0] += values[y == cls].sum(axis=0)
                    own[1] += int((y == cls).sum())
        yield pa.RecordBatch.from_pydict({"cls": pa.array([k for k, _ in held], pa.int64()), "s": pa.array([v[0] for v in held.values()], pa.list_(pa.float64())), "n": pa.array([v[1] for v in held.values()], pa.int64())})

    found = rows.select(F.col("y").cast("long"), "x").mapInArrow(sums, "cls long, s array<double>, n long")
    long = found.select("cls", "n", F.size("s").alias("k"), F.posexplode("s").alias("ch", "s"))
    means = long.groupBy("cls", "ch").agg((F.sum("s") / F.sum("n")).alias("m"), F.min("k").alias("low"), F.max("k").alias("high"))
    # Every class and channel is seen with all lengths that its class has.
    uneven = F.raise_error(F.concat(F.lit("spectra of "), F.col("low").cast("string"), F.lit(" and of "), F.col("high").cast("string"), F.lit(" channels have no common mean")))
    return means.select("cls", "ch", F.when(F.col("low") != F.col("high"), uneven.cast("double")).otherwise(F.col("m")).alias("m"))


def nearest_centroid(rows: DataFrame) -> DataFrame:
    """(vec_id, gt, pred): the class whose mean spectrum lies nearest, ties to
    the smaller class; null for spectra that hold a null or a number that is not
    finite, or are of another length than the means.  Null spectra are left out.
    The means go to every task: an array a class, at most MAX_CLASSES of them,
    which is checked."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ch", "m"))), lambda s: s["m"])
    found = class_means(rows).groupBy("cls").agg(ordered.alias("c")).orderBy("cls").limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if len(lengths := {len(r["c"]) for r in found}) > 1:
        raise ValueError(f"classes have spectra of {sorted(lengths)} channels")
    classes, centres = np.array([r["cls"] for r in found], np.int64), np.array([r["c"] for r in found], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for at, _, x in usable(batch, 3, 2):
                if len(classes) and x.shape[1] == centres.shape[1]:
                    near = [np.round(((x[k : k + 256, None] - centres) ** 2).sum(axis=2), 9).argmin(axis=1) for k in range(0, len(x), 256)]
                    pred[at], known[at] = classes[np.concatenate(near)], True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, mask=~known)], names=["vec_id", "gt", "pred"])

    known = rows.filter(F.col("x").isNotNull())
    return known.select("vec_id", F.col("y").cast("long").alias("gt"), "x", F.lit(0).alias("any")).mapInArrow(run, "vec_id long, gt long, pred long")


def matched(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(image, px, gt, pred, count_differs): predictions joined to truth by
    pixel; an image with more truth than predictions is marked."""
    n = truth.groupBy("image").agg(F.count(F.lit(1)).alias("__n"))
    k = pred.groupBy("image").agg(F.count(F.lit(1)).alias("__k"))
    counts = n.join(k, "image").select("image", (F.col("__n") != F.col("__k")).alias("count_differs"))
    return pred.join(truth, ["image", "px"]).join(counts, "image").select("image", "px", "gt", "pred", "count_differs")
