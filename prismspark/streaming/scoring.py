"""Scoring of spectra as they arrive; beyond the batch queries.

The native steps are row-local, so the same expressions run on a stream.  A
windowed count of predictions closes by watermark: rows later than that are
left out, as the engine does for any windowed aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismspark.functions import native
from prismspark.operators.scoring import score


def scored_stream(spectra: DataFrame, weights: dict) -> DataFrame:
    """(image, px, ts, pred, prob) of a stream of (image, px, ts, x)."""
    ready = spectra.withColumn("x", native.standardized(F.col("x")))
    return score(ready, weights).select("image", "px", "ts", native.argmax(F.col("probs")).alias("pred"), F.array_max("probs").alias("prob"))


def predictions_per_window(scored: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, pred, n) of each closed window."""
    counted = scored.withWatermark("ts", late).groupBy(F.window("ts", window), "pred").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "pred", "n")


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append predictions to parquet; a restart goes on from the checkpoint."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
