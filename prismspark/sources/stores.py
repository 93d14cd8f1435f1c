"""Reading images and spectra: listings, shapes, pixel ranges, array files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_images(images: DataFrame) -> DataFrame:
    """(image, label) by name, with a dash for images without a label."""
    return images.select("image", F.coalesce("label", F.lit("—")).alias("label")).orderBy("image")


def resolve(asked: DataFrame, nested: DataFrame, top: DataFrame) -> DataFrame:
    """(image, layout) of the images asked for: nested where the store has them
    in its folder of images, else top; an image that it lacks is an error."""
    inner, outer = nested.select("image").distinct(), top.select("image").distinct()
    require_images(asked, inner.unionAll(outer))
    found = asked.select("image").distinct().join(inner.withColumn("__n", F.lit(1)), "image", "left")
    return found.select("image", F.when(F.col("__n") == 1, "nested").otherwise("top").alias("layout"))


def labelled(images: DataFrame, default: Column) -> DataFrame:
    """``images`` with the label that an image lacks: a word, its name, or what
    else the store tells of it."""
    return images.withColumn("label", F.coalesce("label", default))


def read_axis(spark: SparkSession, path: str) -> list[float] | None:
    """The axis kept beside a store (a row of one array ``wn``); None if none is."""
    try:
        row = spark.read.schema("wn array<double>").parquet(path).first()
    except AnalysisException:
        return None
    return list(row["wn"]) if row and row["wn"] else None


def require_images(asked: DataFrame, known: DataFrame) -> None:
    """Images that the store lacks are an error that lists what it has."""
    lacking = [r[0] for r in asked.select("image").join(known.select("image"), "image", "left_anti").orderBy("image").limit(100).collect()]
    if lacking:
        names = [r[0] for r in known.select("image").distinct().orderBy("image").limit(100).collect()]
        raise KeyError(f"images {lacking} are not in the store, which has {names}")


def shapes(pixels: DataFrame) -> DataFrame:
    """(image, pixels, last_px, layout): an image of one pixel row is flat."""
    n = F.count(F.lit(1))
    return pixels.groupBy("image").agg(n.alias("pixels"), F.max("px").alias("last_px"), F.when(n == 1, "flat").otherwise("spatial").alias("layout"))


def pixel_range(spectra: DataFrame, start: int, stop: int, width: int) -> DataFrame:
    """Spectra with start <= px < stop, with their row and column."""
    return spectra.filter((F.col("px") >= start) & (F.col("px") < stop)).withColumns({"row": F.expr(f"px div {int(width)}"), "col": F.col("px") % width})


#: Keys of an array file that are tried in this order, then its first array.
ARRAY_KEYS = ("spectra", "data", "X", "image", "arr_0")


def read_arrays(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(path, px, x) of .npy and .npz files; all but the last axis is pixels."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.load(io.BytesIO(blob), allow_pickle=False)
                if not isinstance(data, np.ndarray):
                    data = data[key or next((k for k in ARRAY_KEYS if k in data.files), data.files[0])]
                rows = data.reshape(-1, data.shape[-1]).astype(np.float64)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    yield pa.RecordBatch.from_pydict({"path": [name] * len(part), "px": pa.array(np.arange(at, at + len(part)), pa.int64()), "x": pa.array(list(part), pa.list_(pa.float64()))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, px long, x array<double>")
