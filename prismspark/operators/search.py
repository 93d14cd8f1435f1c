"""Search of settings by tree-structured Parzen estimators over a trials table.

The best tenth of the finished trials (``GOOD`` at most) are good, the others
bad.  For every parameter, candidates are drawn from the good trials' density
and the one with the largest ratio of good to bad density is taken.  Densities
are kernels of equal width, cut at the range's ends, beside one share of the
plain range; ranges drawn by logarithm are searched in logarithms; choices have
counts beside one share of each.  The trials stay in their table: candidates, a
bounded number, go to the tasks, which add up the kernels of their trials.
"""

from __future__ import annotations

import dataclasses
import math
import random
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from prismspark.config import Config, draw_trials, override

GOOD, SHARE, STARTUP, CANDIDATES = 25, 0.1, 10, 24


@dataclasses.dataclass(frozen=True)
class Scale:
    """A parameter's range on the line that it is searched on."""

    low: float
    high: float
    log: bool

    @staticmethod
    def of(spec: tuple) -> Scale:
        return Scale(math.log(spec[1]), math.log(spec[2]), True) if spec[0] == "log" else Scale(float(spec[0]), float(spec[1]), False)

    def there(self, v: float) -> float:
        return math.log(v) if self.log else float(v)

    def back(self, v: float) -> float:
        return math.exp(v) if self.log else v

    def width(self, n: int) -> float:
        return max((self.high - self.low) * max(1, n) ** -0.2 / 4, (self.high - self.low) / 100)


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _kernels(x: np.ndarray, at: np.ndarray, width: float, s: Scale) -> np.ndarray:
    """Sum over points ``at`` of the kernels cut at the range's ends, at ``x``."""
    cut = np.array([max(_normal((s.high - p) / width) - _normal((s.low - p) / width), 1e-12) for p in at])
    return (np.exp(-0.5 * ((x[:, None] - at) / width) ** 2) / (width * math.sqrt(2 * math.pi) * cut)).sum(axis=1)


def _draw(rng: random.Random, points: list[float], width: float, s: Scale) -> float:
    """From the mixture of the range and the kernels at the points."""
    at = rng.randrange(len(points) + 1)
    if at == len(points):
        return rng.uniform(s.low, s.high)
    while True:
        if s.low <= (x := rng.gauss(points[at], width)) <= s.high:
            return x


def _sums(scales: dict[int, Scale], drawn: dict[int, np.ndarray], widths: dict[int, float]):
    """Trials (a column a parameter) to one row a parameter and candidate: the
    kernels of the task's trials, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(len(x)) for i, x in drawn.items()}
        for batch in batches:
            for i, x in drawn.items():
                at = batch.column(i).to_numpy(zero_copy_only=False)
                at = np.log(at) if scales[i].log else at
                for k in range(0, len(at), 1_024):
                    total[i] += _kernels(x, at[k : k + 1_024], widths[i], scales[i])
        for i, w in total.items():
            yield pa.RecordBatch.from_pydict({"i": np.full(len(w), i), "c": np.arange(len(w)), "w": w})

    return run


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def suggest(trials: DataFrame, space: Mapping, objective: str, n: int, seed: int = 0) -> list[dict]:
    """``n`` settings to try next, of the trials (a column a parameter, and the
    objective, which is to be large).  Trials that lack the objective or a
    parameter, or have a value out of its range, do not count; fewer than
    ``STARTUP`` others give plain draws.  Seeds repeat for the same trials."""
    names = sorted(space)
    if lacking := [name for name in names if name not in trials.columns]:
        raise KeyError(f"trials have no {lacking}; they have {sorted(trials.columns)}")
    scales = {i: Scale.of(space[name]) for i, name in enumerate(names) if not isinstance(space[name], list)}
    columns = [F.col(f"`{k}`").cast("double" if i in scales else "string").alias(f"p{i}") for i, k in enumerate(names)]
    done = trials.select(*columns, F.col(f"`{objective}`").cast("double").alias("o")).filter("o is not null and not isnan(o)")
    for i, name in enumerate(names):
        p = F.col(f"p{i}")
        ends = space[name][-2:]
        done = done.filter(p.between(float(ends[0]), float(ends[1])) if i in scales else p.isin([_text(v) for v in space[name]]))
    total = done.count()
    if total < STARTUP:
        return draw_trials(dict(space), n, seed)
    k = min(GOOD, math.ceil(SHARE * total))
    worse = total - k
    good = done.orderBy(F.desc("o"), *[f"p{i}" for i in range(len(names))]).limit(k).collect()
    rng = random.Random(f"{seed}:{total}")
    near = {i: np.array([scale.there(r[f"p{i}"]) for r in good]) for i, scale in scales.items()}
    drawn = {i: np.array([_draw(rng, near[i].tolist(), scale.width(k), scale) for _ in range(n * CANDIDATES)]) for i, scale in scales.items()}
    widths = {i: scale.width(worse) for i, scale in scales.items()}
    best: dict[int, list[float]] = {}
    if scales:
        sums = done.drop("o").mapInArrow(_sums(scales, drawn, widths), "i long, c long, w double").groupBy("i", "c").agg(F.sum("w").alias("w")).orderBy("i", "c").collect()  # n * CANDIDATES rows a parameter
        for i, scale in scales.items():
            flat = 1 / (scale.high - scale.low)
            # All trials less the good ones.
            bad = np.maximum(np.array([r["w"] for r in sums if r["i"] == i]) - _kernels(drawn[i], near[i], widths[i], scale), 0)
            ratio = (flat + _kernels(drawn[i], near[i], scale.width(k), scale)) / (k + 1) / ((flat + bad) / (worse + 1))
            picks = ratio.reshape(n, CANDIDATES).argmax(axis=1)
            best[i] = [scale.back(float(v)) for v in drawn[i].reshape(n, CANDIDATES)[np.arange(n), picks]]
    out: list[dict] = [{} for _ in range(n)]
    for i, name in enumerate(names):
        if i in scales:
            for row, value in zip(out, best[i], strict=True):
                row[name] = value
            continue
        choices = [_text(v) for v in space[name]]
        counts = {r[0]: r[1] for r in done.groupBy(f"p{i}").count().collect()}  # a row a choice
        own = [sum(g[f"p{i}"] == c for g in good) for c in choices]
        share = [(m + 1) / (k + len(choices)) for m in own]
        ratio = [g / ((counts.get(c, 0) - m + 1) / (worse + len(choices))) for g, c, m in zip(share, choices, own, strict=True)]
        for row in out:
            picks = rng.choices(range(len(choices)), share, k=CANDIDATES)
            row[name] = space[name][max(picks, key=lambda j: (ratio[j], -j))]
    return out


def _nested(settings: dict) -> dict:
    """``{"model.lr": 1}`` as ``{"model": {"lr": 1}}``."""
    out: dict = {}
    for key, value in settings.items():
        *path, last = key.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def search(spark: SparkSession, evaluate: Callable[[dict[str, Config]], DataFrame], config: Config, space: Mapping, trials: int, path: str, at_once: int = 4, seed: int = 0) -> DataFrame:
    """``trials`` configurations, ``at_once`` of them suggested and run together,
    each batch by all that is finished before it.  ``evaluate`` gives (trial,
    objective, error), as ``jobs.run.sweep`` does; names of the space are paths
    into the configuration (``model.lr``).  The trials are a table under
    ``path``, which a restarted search goes on from."""
    names = sorted(space)
    kinds = [StructField(k, StringType() if isinstance(space[k], list) else DoubleType()) for k in names]
    schema = StructType([StructField("trial", StringType()), *kinds, StructField("objective", DoubleType()), StructField("error", StringType())])
    while True:
        try:
            table = spark.read.schema(schema).parquet(path)
            n = table.count()
        except AnalysisException:
            table, n = spark.createDataFrame([], schema), 0
        if n >= trials:
            return table
        batch = suggest(table, space, "objective", min(at_once, trials - n), seed + n)
        found = {r["trial"]: r for r in evaluate({f"t{n + j}": override(config, _nested(row)) for j, row in enumerate(batch)}).collect()}
        rows = [(f"t{n + j}", *[_text(row[k]) if isinstance(space[k], list) else float(row[k]) for k in names], found[f"t{n + j}"]["objective"], found[f"t{n + j}"]["error"]) for j, row in enumerate(batch)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
