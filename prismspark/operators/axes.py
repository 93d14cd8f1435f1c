"""Joins of channel axes that live in tables, an axis a key (an image, a store).

``brackets`` finds, for every place of a target axis, the channels of the source
axis on either side: both are merged in order of wavenumber and each side's last
and next channel carried along, so axes may rise or fall, and differ from key to
key.  ``inside`` keeps the channels that lie in any of a key's windows: windows
are dealt to bins of the axis, so the join is by equal bins, and as a semi join
it counts a channel in overlapping windows once.  Spectra stay arrays: what is
found becomes one array a key and is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins that the span of all windows is dealt into.
BINS = 1_024


def brackets(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, ch, low, high, share): for each channel of ``target`` (key, ch, wn)
    the channels of ``source`` (key, ch, wn) that enclose it, and how far it lies
    from low to high; beyond an end both are the end's.  Of channels at one
    place the last counts as low.  Null places take no part; keys that the source
    lacks have no rows."""
    side = lambda frame, own: frame.filter("wn is not null and not isnan(wn)").select(F.col(key).alias("k"), F.col("ch").cast("int").alias("ch"), F.col("wn").cast("double").alias("wn"), F.lit(own).alias("own"))
    both = side(source, True).unionByName(side(target, False))
    held = F.when(F.col("own"), F.struct("ch", "wn"))
    order = Window.partitionBy("k").orderBy("wn", F.desc("own"), "ch")
    both = both.withColumns({
        "before": F.last(held, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "after": F.first(held, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    low, high = F.coalesce("before", "after"), F.coalesce("after", "before")
    gap = high["wn"] - low["wn"]
    share = F.when(F.abs(gap) < 1e-10, F.lit(0.0)).otherwise((F.col("wn") - low["wn"]) / F.when(F.abs(gap) < 1e-10, F.lit(1.0)).otherwise(gap))
    found = both.filter("not own").select("k", "ch", low["ch"].alias("low"), high["ch"].alias("high"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("share"))
    return found.filter("low is not null").withColumnRenamed("k", key)


def _per_key(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """One array a key, in order of channels."""
    listed = F.array_sort(F.collect_list(F.struct("ch", value.alias("v"))))
    return rows.groupBy(key).agg(F.transform(listed, lambda s: s["v"]).alias("__found"))


def resample(rows: DataFrame, source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, x, ...) with ``x`` interpolated from its key's source axis
    to its target axis; spectra of keys without axes go, and a channel that a
    spectrum lacks is null."""
    found = _per_key(brackets(source, target, key), key, F.struct("low", "high", "share"))
    at = lambda x, i: F.get(x, i)
    # The ends' own values where the share is 0 or 1, so that no null or NaN beside them counts.
    between = lambda s: F.when(s["share"] == 0, at(F.col("x"), s["low"])).when(s["share"] == 1, at(F.col("x"), s["high"])).otherwise(at(F.col("x"), s["low"]) + s["share"] * (at(F.col("x"), s["high"]) - at(F.col("x"), s["low"])))
    return rows.join(found, key).withColumn("x", F.transform("__found", between)).drop("__found")


def inside(axis: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Rows of ``axis`` (key, ch, wn) that lie in a window (key, low, high) of
    their key, ends included; each once."""
    low, high = windows.agg(F.min("low"), F.max("high")).first()
    width = max(((high or 0.0) - (low or 0.0)) / BINS, 1e-9)
    place = lambda v: F.floor((v - F.lit(float(low or 0.0))) / width)
    known = windows.filter("low <= high").select(F.col(key).alias("__k"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.explode(F.sequence(place(F.col("low")), place(F.col("high")))).alias("__bin"))
    dealt = axis.withColumn("__place", place(F.col("wn")))
    met = (F.col(key) == F.col("__k")) & (F.col("__place") == F.col("__bin")) & (F.col("wn") >= F.col("__low")) & (F.col("wn") <= F.col("__high"))
    return dealt.join(known, met, "left_semi").drop("__place")


def crop(rows: DataFrame, axis: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, x, ...) with the channels of ``inside``, in their order; a
    key without any is an error, as there would be nothing left of its spectra."""
    kept = inside(axis, windows, key)
    lacking = [r[0] for r in rows.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti").orderBy(key).limit(10).collect()]
    if lacking:
        raise ValueError(f"the windows of {lacking} hold no channel")
    found = _per_key(kept, key, F.col("ch").cast("int"))
    return rows.join(found, key).withColumn("x", F.transform("__found", lambda c: F.get("x", c))).drop("__found")
