"""Prediction store: trial ids, records, commit marker, fitted state, metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.functions import native


def with_trial_ids(trials: DataFrame) -> DataFrame:
    """(n, seed, arm, trial_id, seed_token): arm 1 carries two perturbations."""
    tag = F.when(F.col("arm") == 1, F.array_join(F.array_sort(F.array(F.lit("shift"), F.lit("noise"))), "+")).otherwise("raw")
    named = trials.withColumn("trial_id", F.format_string("N%d_seed%02d_%s", "n", "seed", tag))
    return named.select("n", "seed", "arm", "trial_id", F.regexp_extract("trial_id", r"seed\d+", 0).alias("seed_token"))


def records(scored: DataFrame, k: int = 3) -> DataFrame:
    """(trial_id, image, px, argmax, bg_prob, top_k, true_label) of scored
    pixels (trial_id, image, px, probs, y); k is cut to the classes there are."""
    p = F.transform("probs", lambda v: v.cast("double"))
    best = F.transform(native.top_k(p, k), lambda s: F.struct(s["cls"].cast("short").alias("cls"), s["prob"].cast("float").alias("prob")))
    return scored.select("trial_id", "image", "px", native.argmax(p).cast("short").alias("argmax"), F.get("probs", F.lit(0)).cast("float").alias("bg_prob"), best.alias("top_k"), F.col("y").cast("int").alias("true_label"))


def save(predictions: DataFrame, trials: DataFrame, path: str) -> None:
    """Predictions first, each (trial, image) overwritten as a whole; the rows
    that mark their trials complete come last."""
    out = predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    out.partitionBy("trial_id", "image").parquet(f"{path}/predictions")
    trials.withColumn("complete", F.lit(True)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trial_id").parquet(f"{path}/trials")


def load(spark: SparkSession, path: str, top_k: bool = False) -> DataFrame:
    """Predictions of complete trials; the top-k column is read only if asked."""
    rows = spark.read.parquet(f"{path}/predictions")
    done = spark.read.parquet(f"{path}/trials").filter("complete").select("trial_id").distinct()
    return (rows if top_k else rows.drop("top_k")).join(done, "trial_id", "left_semi")


#: Rows of one file of a clustered store.
FILE_ROWS = 4_000_000


def save_clustered(predictions: DataFrame, trials: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Whole trials, dealt by ranges of trial, image and pixel into sorted files,
    so that many small images share a file and large ones have several; a table
    of what each file holds, and last the rows that mark trials complete."""
    spark = predictions.sparkSession
    out = lambda frame: frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("trial_id")
    n = predictions.count()
    keys = ["trial_id", "image", "px"]
    out(predictions.repartitionByRange(max(1, -(-n // file_rows)), *keys).sortWithinPartitions(*keys)).parquet(f"{path}/predictions")
    done = trials.select("trial_id").distinct()
    held = spark.read.schema(predictions.schema).parquet(f"{path}/predictions").select("trial_id", "image", "px", F.col("_metadata.file_path").alias("file"))
    held = held.join(F.broadcast(done), "trial_id", "left_semi")  # a row a trial
    ends = [F.min(F.struct("image", "px")).alias("first"), F.max(F.struct("image", "px")).alias("last"), F.count(F.lit(1)).alias("rows")]
    out(held.groupBy("trial_id", "file").agg(*ends)).parquet(f"{path}/files")
    out(trials.withColumn("complete", F.lit(True))).parquet(f"{path}/trials")


def clustered_files(spark: SparkSession, path: str, trial_id: str, image, start: int = 0, stop: int | None = None) -> list[str]:
    """Files of a clustered store that may hold pixels start <= px < stop of an
    image; a trial that is not complete has none."""
    done = spark.read.parquet(f"{path}/trials").filter((F.col("trial_id") == trial_id) & F.col("complete"))
    files = spark.read.parquet(f"{path}/files").join(F.broadcast(done.select("trial_id").distinct()), "trial_id", "left_semi")  # one row
    low = F.struct(F.lit(image).cast(files.schema["first"].dataType["image"].dataType).alias("image"), F.lit(start).cast("long").alias("px"))
    end = F.struct(low["image"].alias("image"), F.lit(2**63 - 1 if stop is None else stop - 1).cast("long").alias("px"))
    plain = lambda c: F.struct(F.col(c)["image"].alias("image"), F.col(c)["px"].cast("long").alias("px"))
    return sorted(r["file"] for r in files.filter((plain("last") >= low) & (plain("first") <= end)).select("file").collect())


def load_range(spark: SparkSession, path: str, trial_id: str, image, start: int = 0, stop: int | None = None) -> DataFrame:
    """Predictions of an image's pixels start <= px < stop, from the files that
    may hold them."""
    files = clustered_files(spark, path, trial_id, image, start, stop)
    schema = spark.read.parquet(f"{path}/predictions").schema
    rows = spark.read.schema(schema).option("basePath", f"{path}/predictions").parquet(*files) if files else spark.createDataFrame([], schema)
    rows = rows.filter((F.col("image") == image) & (F.col("px") >= start))
    return rows if stop is None else rows.filter(F.col("px") < stop)


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    rows = [(k, [float(x) for x in v]) for k, v in state.items()]
    spark.createDataFrame(rows, "key string, value array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict:
    """Fitted state, empty where none was saved."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("key string, value array<double>").parquet(path).collect()  # a row a named array
    except AnalysisException:
        return {}
    return {r["key"]: list(r["value"]) for r in rows}


class Tracker:
    """Metrics, parameters and tags as tables under a folder."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id, self.rows = spark, path, run_id, []

    def metric(self, key: str, value: float, step: int = 0) -> None:
        self.rows.append(("metric", key, float(value), None, step))

    def parameters(self, values: dict) -> None:
        self.rows += [("parameter", k, None, json.dumps(v, sort_keys=True), 0) for k, v in values.items()]

    def tag(self, key: str, value: str) -> None:
        self.rows.append(("tag", key, None, str(value), 0))

    def __enter__(self) -> Tracker:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.tag("status", "failed" if kind else "completed")
        frame = self.spark.createDataFrame([(self.run_id, *r) for r in self.rows], "run_id string, kind string, key string, value double, text string, step long")
        frame.coalesce(1).write.mode("append").parquet(self.path)
        return False  # errors go on


class NoTracker(Tracker):
    """Keeps nothing."""

    def __exit__(self, kind, error, trace) -> bool:
        return False


def make_tracker(backend: str, spark: SparkSession, path: str, run_id: str) -> Tracker:
    if backend not in ("table", "none"):
        raise ValueError(f"Unknown tracker {backend!r}; known: ['table', 'none']")
    return (Tracker if backend == "table" else NoTracker)(spark, path, run_id)
