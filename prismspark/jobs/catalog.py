"""Registry of all queries but the corpus operators', and of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismspark.jobs import learning, relational, spectral

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**spectral.QUERIES, **relational.QUERIES, **learning.QUERIES}
ORACLE_SQL: dict[str, str] = {**spectral.ORACLE_SQL, **relational.ORACLE_SQL, **learning.ORACLE_SQL}
