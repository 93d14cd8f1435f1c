"""Exact quota sampling, splits and balanced batches.

All quotas are row numbers in a seeded order, so they are exact, repeatable and
need no driver loop.  Where a quota is a budget, the engine cuts each group to it
before it shuffles (window group limit); where it is a share of the group, rows
are numbered by ranges of their order, so that a label with most of the rows
spreads over many tasks.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismspark.functions.hashrand import MODULUS, order_key, place_key, text_key


def fresh(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until ``rows`` has no such column."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ranges that the order of a group is dealt into.
RANGES = 65_536


def ident_key(rows: DataFrame, ident: str) -> Column:
    """What draws are keyed by: whole-number ids as they are, others (names) by
    64 bits of their text."""
    kind, column = dict(rows.dtypes)[ident], F.col(f"`{ident}`")
    return column if kind in ("tinyint", "smallint", "int", "bigint") else text_key(column)


def seeded(rows: DataFrame, ident: str, seed: int) -> Column:
    return order_key(ident_key(rows, ident), seed)


def numbered(rows: DataFrame, group: list[str], ident: str, seed: int = 0, place: str = "__i", size: str = "__n") -> DataFrame:
    """``rows`` with ``place``, the place in the seeded order of the group from
    0, and ``size``, the group's rows.  Places are the rows of earlier ranges of
    the order, which are counted, and the place within the own range."""
    h, b = fresh(rows, "h"), fresh(rows, "b")
    keyed = rows.withColumn(h, seeded(rows, ident, seed)).withColumn(b, F.expr(f"`{h}` div {MODULUS // RANGES}"))
    keys = [F.col(f"`{g}`") for g in group]
    counts = keyed.groupBy(*keys, b).agg(F.count(F.lit(1)))
    renamed = counts.toDF(*[fresh(keyed, f"g{k}") for k in range(len(group))], fresh(keyed, "r"), fresh(keyed, "c"))
    *own, r, c = renamed.columns
    o, n, k = fresh(keyed, "o"), fresh(keyed, "n"), fresh(keyed, "k")
    whole = Window.partitionBy(*own)  # at most RANGES rows of a group
    renamed = renamed.withColumns({n: F.sum(c).over(whole), o: F.sum(c).over(whole.orderBy(r)) - F.col(c)})
    same = F.col(b).eqNullSafe(F.col(r))
    for key, name in zip(keys, own, strict=True):
        same &= key.eqNullSafe(F.col(name))
    within = Window.partitionBy(*keys, b).orderBy(h, f"`{ident}`")
    placed = keyed.withColumn(k, F.row_number().over(within)).join(renamed, same)
    return placed.select(*[F.col(f"`{x}`") for x in rows.columns], (F.col(o) + F.col(k) - 1).alias(place), F.col(n).alias(size))


def water_fill(rows: DataFrame, label: str, core: str, ident: str, budget: int, seed: int = 0) -> DataFrame:
    """At most ``budget`` rows of each label, as even over its cores as their
    capacities allow; what is left over goes to cores in seeded order."""
    h, r, k = fresh(rows, "h"), fresh(rows, "r"), fresh(rows, "k")
    label = f"`{label}`"
    within = Window.partitionBy(label, f"`{core}`").orderBy(h, f"`{ident}`")
    first = rows.withColumn(h, seeded(rows, ident, seed)).withColumn(r, F.row_number().over(within)).filter(F.col(r) <= budget)
    across = Window.partitionBy(label).orderBy(r, seeded(rows, core, seed), f"`{core}`")
    return first.withColumn(k, F.row_number().over(across)).filter(F.col(k) <= budget).drop(h, r, k)


def water_fill_quotas(rows: DataFrame, label: str, core: str, ident: str, budget: int, seed: int = 0) -> DataFrame:
    """(label, core, quota) of ``water_fill``."""
    return water_fill(rows, label, core, ident, budget, seed).groupBy(label, core).agg(F.count(F.lit(1)).alias("quota"))


def pools(rows: DataFrame, value: Column, signal_above: float, background_below: float) -> DataFrame:
    """Rows in the pool 'signal' (value above its threshold) and in the pool
    'bkg' (below the other); a row may be in both or none, and NaN is in none."""
    known = value.isNotNull() & ~F.isnan(value)
    names = F.array_compact(F.array(F.when(known & (value > signal_above), F.lit("signal")), F.when(known & (value < background_below), F.lit("bkg"))))
    return rows.withColumn("pool", F.explode(names))


def hyperspectral_sample(rows: DataFrame, label: str, core: str, ident: str, value: str, budget: int, signal_above: float, background_below: float, seed: int = 0) -> DataFrame:
    """Even samples of every label's signal rows, and of the background rows of
    all labels as a class of their own, ``bkg``."""
    pooled = pools(rows, F.col(value), signal_above, background_below)
    named = pooled.withColumn("class", F.when(F.col("pool") == "bkg", F.lit("bkg")).otherwise(F.col(label).cast("string")))
    return water_fill(named, "class", core, ident, budget, seed)


def label_split(items: DataFrame, label: str, ident: str, train_ratio: float, seed: int = 0) -> DataFrame:
    """``items`` with ``part`` (train or test) by seeded order within each label; the train
    share is rounded half to even."""
    i, n = fresh(items, "i"), fresh(items, "n")
    part = F.when(F.col(i) < F.bround(F.col(n) * F.lit(train_ratio)), "train").otherwise("test")
    return numbered(items, [label], ident, seed, i, n).withColumn("part", part).drop(i, n)


def patient_split(items: DataFrame, patient: str, test_ratio: float, seed: int = 0) -> DataFrame:
    """``part`` by patient: max(1, round(P * ratio)) patients are for testing,
    and no patient is on both sides.  Rows without a patient are refused."""
    if items.filter(F.col(patient).isNull()).limit(1).count():
        raise ValueError("rows without a patient cannot be split by patient")
    tests = F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(test_ratio)))  # half to even
    chosen = numbered(items.select(patient).distinct(), [], patient, seed).filter(F.col("__i") < tests).select(patient, F.lit("test").alias("part"))
    return items.join(chosen, patient, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def split_cores(cores: DataFrame, pixels: DataFrame, patient: str, core: str, cls: str, classes: list[str] | None, test_ratio: float, seed: int = 0) -> DataFrame:
    """``cores`` with ``dominant``, the most frequent of the wanted classes among
    its pixels (core, cls; ties to the smallest), and ``part`` by patient.  Cores
    without any of the wanted classes go before patients are dealt."""
    wanted = pixels if classes is None else pixels.filter(F.col(cls).isin(classes))
    counts = wanted.groupBy(core, cls).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(core).orderBy(F.desc("__n"), cls)
    best = counts.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(core, F.col(cls).alias("dominant"))
    return patient_split(cores.join(best, core), patient, test_ratio, seed)


def sample_classes(rows: DataFrame, label: str, core: str, ident: str, known: list, classes: list | None = None, per_class: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of the wanted classes with ``new_y``, their place among these, and
    ``place``, that in a seeded order of the sample from 0.  ``per_class`` rows
    of each class, even over its cores; all of them if None.  A class that is not
    known is an error, one without rows a warning."""
    active = list(known if classes is None else classes)
    if unknown := [c for c in active if c not in known]:
        raise ValueError(f"Unknown classes {unknown}; known: {known}")
    index = F.array_position(F.array(*[F.lit(c) for c in active]), F.col(label)) - 1
    found = rows.filter(F.col(label).isin(active))
    present = {r[0] for r in found.select(label).distinct().collect()}  # at most a row a class
    if missing := [c for c in active if c not in present]:
        warnings.warn(f"no spectra of the classes {missing}", stacklevel=2)
    if per_class is not None:
        found = water_fill(found, label, core, ident, per_class, seed)
    n = fresh(found, "n")
    return numbered(found, [], ident, seed + 1, "place", n).withColumn("new_y", index).drop(n)


def test_subsample(items: DataFrame, label: str, ident: str, ratio: float, seed: int = 0) -> DataFrame:
    """max(1, round(n * ratio)) rows of each label."""
    i, n = fresh(items, "i"), fresh(items, "n")
    keep = F.greatest(F.lit(1), F.bround(F.col(n) * F.lit(ratio)))
    return numbered(items, [label], ident, seed, i, n).filter(F.col(i) < keep).drop(i, n)


def balanced_batches(rows: DataFrame, label: str, ident: str, batches: int, per_class: int, seed: int = 0, extra: int = 0, first: int = 0) -> DataFrame:
    """(batch, slot, label, ident): each batch draws ``per_class`` rows of every
    class with replacement and ``extra`` rows of all (what is left of its size),
    and shuffles them: slot is the place in the batch, from 0.  Batches are
    numbered from ``first``, and each depends on its number and the seed alone."""
    places = numbered(rows.select(label, ident), [label], ident, seed).select(label, ident, "__i")
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))  # a row a class
    order = Window.orderBy(label)
    sizes = sizes.withColumns({"__class": F.row_number().over(order) - 1, "__start": F.sum("__n").over(order) - F.col("__n"), "__all": F.sum("__n").over(Window.partitionBy())})
    batch = F.explode(F.sequence(F.lit(first), F.lit(first + batches - 1))).alias("batch")
    draws = sizes.select("*", batch).select("*", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))).alias("__s"))
    draws = draws.select("batch", label, (F.col("__class") * per_class + F.col("__s")).alias("__d"), (order_key(F.col("batch").cast("long") * per_class + F.col("__s") + 1, seed) % F.col("__n")).alias("__i"))
    if extra:
        more = sizes.select("*", batch).select("*", F.explode(F.sequence(F.lit(0), F.lit(extra - 1))).alias("__s"))
        drawn = order_key(F.col("batch").cast("long") * extra + F.col("__s") + 1, seed + 1) % F.col("__all") - F.col("__start")
        more = more.withColumn("__i", drawn).filter("__i >= 0 and __i < __n")
        draws = draws.unionAll(more.select("batch", label, (-1 - F.col("__s")).alias("__d"), "__i"))
    mixed = Window.partitionBy("batch").orderBy(place_key(F.col("__d"), F.col("batch"), seed + 2), "__d")
    draws = draws.withColumn("slot", (F.row_number().over(mixed) - 1).cast("long"))
    return draws.join(places, [label, "__i"]).select(F.col("batch").cast("long").alias("batch"), "slot", label, ident)


def random_mask(ident: Column, ratio: float, seed: int, allowed: Column | None = None) -> Column:
    """Whether a row is perturbed: a seeded share of the allowed rows."""
    drawn = order_key(ident, seed) < F.lit(int(ratio * MODULUS))
    return drawn if allowed is None else drawn & allowed


def check_classes(wanted: list[str], known: DataFrame, column: str) -> None:
    """Unknown class names are an error that lists the known ones."""
    spark = known.sparkSession
    missing = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], f"{column} string").join(known.select(column).distinct(), column, "left_anti").orderBy(column).collect()]
    if missing:
        names = [r[0] for r in known.select(column).distinct().orderBy(column).limit(1000).collect()]
        raise ValueError(f"Unknown classes {missing}; known: {names}")


def check_class_count(rows: DataFrame, label: str, expected: int) -> None:
    """A number of classes other than the model's is an error."""
    found = rows.select(label).distinct().count()
    if found != expected:
        raise ValueError(f"the data have {found} classes, the model has {expected}")
