"""Tables of the spectral data model.

``spectra(image, patient, px, vec_id, y, x)`` has a row for each spectrum,
``x`` an array of channel intensities along ``AXIS``.  Where a data set brings
no image or patient of its own they follow from the row's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = 64
#: Wavenumbers of the channels, 1/cm.
AXIS = [400 + c * 3600 / (CHANNELS - 1) for c in range(CHANNELS)]
IMAGES, PATIENTS = 25, 7
#: Rows of ``lineitem`` that a task joins, about.
TASK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, patient, px, vec_id, y, x) from the table ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        (F.col("vec_id") % IMAGES).alias("image"),
        (F.col("vec_id") % IMAGES % PATIENTS).alias("patient"),
        F.expr(f"vec_id div {IMAGES}").alias("px"),
        "vec_id",
        F.col("label").cast("long").alias("y"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )


def long_form(rows: DataFrame, x: str = "x", *keys: str) -> DataFrame:
    """(keys..., ch, value): a row for each channel.  The outer form infers no
    filter on the array, into which the expression that makes it would go; the
    row of an array without channels goes after it."""
    return rows.select(*keys, F.posexplode_outer(x).alias("ch", "value")).filter("ch is not null").withColumn("ch", F.col("ch").cast("long"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, seed, arm, trial_id, gt, pred, event_id) from the table ``events``:
    predictions of trials with n samples a class, in two arms."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.pow(F.lit(2.0), 5 + F.col("event_id") % 5).cast("long").alias("n"),
        (F.col("user_id") % 3).cast("long").alias("seed"),
        (F.col("event_id") % 2).cast("long").alias("arm"),
        (F.floor(F.col("event_id") / 3.0).cast("long") % 4).alias("gt"),
        (F.col("event_id") % 4).cast("long").alias("pred"),
        F.col("event_id").cast("long").alias("event_id"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patient, image, px, class, value): patients, their cores and pixels from
    ``customer``, ``orders`` and ``lineitem``."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("patient"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("px"), F.col("l_returnflag").alias("class"), F.col("l_quantity").cast("double").alias("value")
    )
    # Spark sizes partitions by their bytes, which these narrow rows exceed many times once sorted and counted.
    if (rows := lines.count()) > TASK_ROWS:
        tasks = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
        lines, orders = lines.repartition(tasks, "image"), orders.repartition(tasks, "image")
    return lines.join(orders, "image")
