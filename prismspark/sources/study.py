"""Sweep studies kept in one SQLite file, as Spark sources and sinks.

The file has the tables ``trials`` (trial_id, number, state), ``trial_params``
(trial_id, param_name, param_value) and ``trial_values`` (trial_id, objective,
value).  Partitions are ranges of trial ids; a task reads the file's bytes from
wherever the store is and asks them for its range.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismspark.sources.array_store import _place

SCHEMA = "trial_id long, number long, state string, kind string, name string, value double"
#: Trials of one partition, and the most that one file is written with.
TRIALS, MAX_TRIALS = 10_000, 1_000_000

_ROWS = """select t.trial_id, t.number, t.state, r.kind, r.name, r.value from trials t left join (
    select trial_id, 'param' as kind, param_name as name, param_value as value from trial_params
    union all select trial_id, 'value', cast(objective as text), value from trial_values) r on r.trial_id = t.trial_id
  where t.trial_id >= ? and t.trial_id < ? order by t.trial_id, r.kind, r.name"""


def _opened(path: str) -> sqlite3.Connection:
    store, place = _place(path)
    with store.open_input_stream(place, compression=None) as f:
        data = f.read()
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return con


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class StudyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        low, high = _opened(self.path).execute("select min(trial_id), max(trial_id) from trials").fetchone()
        return [Range(0, 0)] if low is None else [Range(k, min(k + TRIALS, high + 1)) for k in range(low, high + 1, TRIALS)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = _opened(self.path).execute(_ROWS, (partition.low, partition.high))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
        while some := rows.fetchmany(10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=["trial_id", "number", "state", "kind", "name", "value"])


class Study(DataSource):
    """``spark.read.format("study").load(path)``: a row a parameter or value."""

    @classmethod
    def name(cls) -> str:
        return "study"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StudyReader:
        return StudyReader(self.options["path"])


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """(trial_id, number, state, params_..., value, value_1, ...): a row a trial,
    a column a parameter or objective; null where a trial has none."""
    spark.dataSource.register(Study)
    rows = spark.read.format("study").load(path)
    objective = F.when(F.col("name") == "0", "value").otherwise(F.concat(F.lit("value_"), "name"))
    named = rows.withColumn("column", F.when(F.col("kind") == "param", F.concat(F.lit("params_"), "name")).otherwise(objective))
    names = [r[0] for r in named.select("column").filter("column is not null").distinct().orderBy("column").limit(1_000).collect()]  # a row a parameter
    if not names:
        return rows.select("trial_id", "number", "state").distinct()
    return named.groupBy("trial_id", "number", "state").pivot("column", names).agg(F.first("value"))


def write_study(trials: DataFrame, path: str, parameters: list[str], objectives: list[str], state: str = "state") -> None:
    """Write trials (one row each, at most ``MAX_TRIALS``) as a study file; a
    null parameter or objective has no row of its own."""
    rows = trials.select(*[F.col(p).cast("double") for p in parameters], *[F.col(o).cast("double") for o in objectives], F.col(state) if state in trials.columns else F.lit("COMPLETE"))
    found = rows.limit(MAX_TRIALS + 1).collect()
    if len(found) > MAX_TRIALS:
        raise ValueError(f"more than {MAX_TRIALS} trials in one study file")
    con = sqlite3.connect(":memory:")
    con.executescript("create table trials (trial_id integer primary key, number integer, state text); create table trial_params (trial_id integer, param_name text, param_value real); create table trial_values (trial_id integer, objective integer, value real);")
    k = len(parameters)
    con.executemany("insert into trials values (?, ?, ?)", [(i + 1, i, r[-1]) for i, r in enumerate(found)])
    con.executemany("insert into trial_params values (?, ?, ?)", [(i + 1, p, r[j]) for i, r in enumerate(found) for j, p in enumerate(parameters) if r[j] is not None])
    con.executemany("insert into trial_values values (?, ?, ?)", [(i + 1, j, r[k + j]) for i, r in enumerate(found) for j in range(len(objectives)) if r[k + j] is not None])
    con.commit()
    store, place = _place(path)
    with store.open_output_stream(place, compression=None) as f:
        f.write(con.serialize())
