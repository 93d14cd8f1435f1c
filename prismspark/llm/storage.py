"""Shared scratch tables and Arrow batch bounds for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """Folder shared by driver and executors, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a
    temporary folder is made and set as the context's checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_prism_scratch", None)
        if found is None:
            found = "file://" + tempfile.mkdtemp(prefix="prism-")
            spark.sparkContext.setCheckpointDir(found)
            spark._prism_scratch = found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is
    cut, and the rows outlive a lost executor."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold, so that long texts do not add up.
    All operators set the same bounds, as plans read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, run: Callable, fields: list[StructField]) -> DataFrame:
    """``df.mapInArrow(run)`` to ``fields`` by place, whatever the columns of
    ``df`` are called: dots and repeated names in them do no harm."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(fields)])
    return plain.mapInArrow(run, out).toDF(*[f.name for f in fields])
