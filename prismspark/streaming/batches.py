"""An endless stream of balanced batches.

The engine's own source of numbered rows gives every draw a number; a draw's
batch, class and row follow from its number and the seed, so a restart from a
checkpoint goes on where it stopped and a replayed micro-batch is the same.
Batches are those of ``sampling.balanced_batches``: equally many rows of each
class with replacement, and what is left of the size from all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismspark.functions.hashrand import order_key, place_key
from prismspark.operators.sampling import numbered


def balanced_stream(rows: DataFrame, label: str, ident: str, per_class: int, seed: int = 0, extra: int = 0, batches_at_once: int = 1) -> DataFrame:
    """(batch, mixed, label, ident and the other columns of ``rows``): the stream
    of draws from ``rows``, a table that does not change while it runs; within a
    batch rows go by ``mixed``.  ``batches_at_once`` come in a micro-batch."""
    spark, order = rows.sparkSession, Window.orderBy(label)
    places = numbered(rows, [label], ident, seed, "__place", "__size")
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))  # a row a class
    sizes = sizes.withColumns({"k": F.row_number().over(order) - 1, "start": F.sum("n").over(order) - F.col("n")}).orderBy("k").collect()
    if not sizes:
        raise ValueError("no rows to draw from")
    classes, total = len(sizes), sum(r["n"] for r in sizes)
    size = classes * per_class + extra
    starts = F.array(*[F.lit(r["start"]) for r in sizes])
    counts = F.array(*[F.lit(r["n"]) for r in sizes])
    labels = F.array(*[F.lit(r[label]) for r in sizes])
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", size * batches_at_once).option("numPartitions", max(1, min(64, size * batches_at_once // 1_024))).load()
    draws = stream.select((F.expr(f"value div {size}")).alias("batch"), (F.col("value") % size).cast("int").alias("d"))
    even, s = F.col("d") < classes * per_class, F.col("d") - classes * per_class
    own = F.expr(f"d div {max(1, per_class)}").cast("int")
    anyone = order_key(F.col("batch") * max(1, extra) + s + 1, seed + 1) % total
    k = F.when(even, own).otherwise(F.size(F.filter(starts, lambda v: v <= anyone)) - 1)
    draws = draws.withColumn("k", k)
    place = F.when(even, order_key(F.col("batch") * per_class + F.col("d") % max(1, per_class) + 1, seed) % F.get(counts, "k")).otherwise(anyone - F.get(starts, "k"))
    number = F.when(even, F.col("d")).otherwise(-1 - s)
    draws = draws.select("batch", place_key(number, F.col("batch"), seed + 2).alias("mixed"), F.get(labels, "k").alias("__label"), place.alias("__drawn"))
    found = draws.join(places, (F.col("__label") == F.col(label)) & (F.col("__drawn") == F.col("__place")))
    return found.select("batch", "mixed", *[F.col(f"`{c}`") for c in rows.columns])
