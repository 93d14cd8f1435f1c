"""Folders for tables between jobs, shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset and Spark
    runs on this machine alone (tests), under a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_prism_folder", None)
        if found is None:
            found = spark._prism_folder = "file://" + tempfile.mkdtemp(prefix="prism-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
