"""Batched scoring of spectra by a network's forward pass, and a trained
classifier on Spark."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from prismspark.functions.hashrand import order_key

Weights = dict[str, np.ndarray]


def seeded_network(channels: int, classes: int, heads: int = 4, width: int = 8, seed: int = 12) -> Weights:
    """Weights of three convolution-and-attention blocks and a dense head."""
    rng, out = np.random.default_rng(seed), {}
    make = lambda *s: (rng.standard_normal(s) / np.sqrt(np.prod(s[1:]) if len(s) > 1 else 1)).astype(np.float32)
    inputs = 1
    for b in range(3):
        out |= {f"conv{b}": make(width // 2, inputs, 7), f"qkv{b}": make(3 * width // 2, inputs, 1), f"mix{b}": make(width // 2, width // 2, 1)}
        inputs = width
    for k, (a, b) in enumerate(((95 * width, 32), (32, 16), (16, classes))):
        out |= {f"dense{k}": make(b, a), f"bias{k}": np.zeros(b, np.float32)}
    out["heads"] = np.array(heads)
    return out


def _convolve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    half = w.shape[2] // 2
    wide = np.pad(x, ((0, 0), (0, 0), (half, half)))
    windows = np.lib.stride_tricks.sliding_window_view(wide, w.shape[2], axis=2)
    return np.einsum("bclk,ock->bol", windows, w, optimize=True)


def _attend(x: np.ndarray, qkv: np.ndarray, mix: np.ndarray, heads: int) -> np.ndarray:
    """Self-attention over channels; the heads are laid end to end as they
    stand, without swapping the axes, before the last product."""
    q, k, v = np.split(_convolve(x, qkv), 3, axis=1)
    n, depth, length = q.shape
    split = lambda t: t.reshape(n, heads, depth // heads, length)
    q, k, v = split(q) * (depth // heads) ** -0.5, split(k), split(v)
    logits = np.einsum("bhdi,bhdj->bhij", q, k, optimize=True)
    weight = np.exp(logits - logits.max(axis=-1, keepdims=True))
    weight /= weight.sum(axis=-1, keepdims=True)
    seen = np.einsum("bhij,bhdj->bhid", weight, v, optimize=True).reshape(n, heads, depth // heads, length)
    return _convolve(seen.reshape(n, depth, length), mix)


def _leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, 0.01 * x)


def forward(x: np.ndarray, w: Weights) -> np.ndarray:
    """Class probabilities of a batch of spectra (float32)."""
    h = x.astype(np.float32)
    h = ((h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5))[:, None]
    for b in range(3):
        y = _leaky(np.concatenate([_convolve(h, w[f"conv{b}"]), _attend(h, w[f"qkv{b}"], w[f"mix{b}"], int(w["heads"]))], axis=1))
        y = y + h if y.shape == h.shape else y
        h = y[:, :, : y.shape[2] // 2 * 2].reshape(*y.shape[:2], -1, 2).max(axis=3)
    edges = np.arange(96) * h.shape[2] / 95
    h = np.stack([h[:, :, int(np.floor(edges[i])) : max(int(np.ceil(edges[i + 1])), int(np.floor(edges[i])) + 1)].mean(axis=2) for i in range(95)], axis=2)
    h = h.reshape(len(h), -1)
    for k in range(3):
        h = h @ w[f"dense{k}"].T + w[f"bias{k}"]
        h = _leaky(h) if k < 2 else h
    e = np.exp(h - h.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def read_network(spark: SparkSession, path: str) -> Weights:
    """Weights of an .npz file, read where Spark reads."""
    found = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()  # one file
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} files, not one")
    with np.load(io.BytesIO(found[0]["content"]), allow_pickle=False) as data:
        return {k: data[k] for k in data.files}


def score(rows: DataFrame, weights: Weights, network: Callable[[np.ndarray, Weights], np.ndarray] = forward, batch: int = 512, channels: int | None = None) -> DataFrame:
    """``rows`` with ``probs``: weights are broadcast once, batches of spectra
    go through the network.  A spectrum that is null, holds nulls, has another
    length than ``channels`` (any, if None) or makes the network fail or give
    numbers that are not finite has null ``probs``; the others are scored."""
    sent, at = rows.sparkSession.sparkContext.broadcast(weights), rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, out = b.column(at), np.full(b.num_rows, None, object)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends, flat = np.cumsum(sizes), column.flatten()
            lacking = np.cumsum(np.concatenate([[0], flat.is_null().to_numpy(zero_copy_only=False)]))
            whole = lacking[ends] == lacking[ends - sizes]
            values = flat.to_numpy(zero_copy_only=False)
            for size in set(sizes.tolist()) & ({channels} if channels else set(sizes.tolist())) - {0}:
                fit = np.flatnonzero((sizes == size) & whole)
                for k in range(0, len(fit), batch):
                    some = fit[k : k + batch]
                    x = values[(ends[some] - size)[:, None] + np.arange(size)].astype(float)
                    try:
                        probs = network(x, sent.value).astype(np.float32)
                    except (ValueError, IndexError):  # a length that the network does not take
                        continue
                    for i, p in zip(some, probs, strict=True):
                        out[i] = p if np.isfinite(p).all() else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.float32()))], names=[*b.schema.names, "probs"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("probs", ArrayType(FloatType()))]))


def failed_images(scored: DataFrame, image: str = "image") -> DataFrame:
    """(image, pixels, failed) of images with pixels that have no probabilities."""
    counts = scored.groupBy(image).agg(F.count(F.lit(1)).alias("pixels"), F.count(F.when(F.col("probs").isNull(), 1)).alias("failed"))
    return counts.filter("failed > 0")


def train_and_evaluate(rows: DataFrame, test_share: float = 0.25, seed: int = 3) -> DataFrame:
    """(part, n, accuracy) of a logistic classifier on standardised spectra,
    fitted on the rows that a seeded order puts in training."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from prismspark.functions.native import standardized

    held = order_key(F.col("vec_id"), seed) < int(test_share * 4_294_967_296)
    frame = rows.select(array_to_vector(standardized(F.col("x"))).alias("features"), F.col("y").cast("double").alias("label"), F.when(held, "test").otherwise("train").alias("part"))
    model = LogisticRegression(maxIter=40, regParam=0.01).fit(frame.filter("part = 'train'"))
    scored = model.transform(frame)
    return scored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def parameter_importance(trials: DataFrame, parameters: list[str], objective: str, seed: int = 5) -> DataFrame:
    """(parameter, importance) by a forest of the objective on the parameters."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    frame = VectorAssembler(inputCols=parameters, outputCol="features", handleInvalid="skip").transform(trials.filter(F.col(objective).isNotNull()))
    model = RandomForestRegressor(labelCol=objective, featuresCol="features", numTrees=20, maxDepth=4, seed=seed).fit(frame)
    return trials.sparkSession.createDataFrame([(p, float(v)) for p, v in zip(parameters, model.featureImportances.toArray(), strict=True)], "parameter string, importance double")


def box_shares(boxes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Share of a step function's variance that each parameter explains alone.
    ``boxes`` (leaf, parameter, 2) cut the unit cube into pieces on which the
    function has ``values``."""
    sides = boxes[:, :, 1] - boxes[:, :, 0]
    volume = sides.prod(axis=1)
    mean = float(volume @ values)
    total = float(volume @ (values - mean) ** 2)
    out = np.zeros(boxes.shape[1])
    for j in range(boxes.shape[1]):
        cuts = np.unique(boxes[:, j])
        middle, length = (cuts[1:] + cuts[:-1]) / 2, np.diff(cuts)
        rest = np.delete(sides, j, axis=1).prod(axis=1)
        within = (boxes[:, j, 0, None] < middle) & (middle < boxes[:, j, 1, None])
        marginal = (values * rest) @ within
        out[j] = float(length @ (marginal - mean) ** 2)
    return out / total if total > 0 else out


def functional_anova(trials: DataFrame, parameters: list[str], objective: str, path: str, trees: int = 32, depth: int = 8, seed: int = 5) -> DataFrame:
    """(parameter, importance, deviation): the share of the objective's variance
    that each parameter explains alone over its whole range, as a forest of the
    trials sees it: worked out from every tree's leaves, mean and deviation over
    trees.  Trials without an objective or a parameter do not count.  The forest
    is kept under ``path``; its trees go through tasks, one row a tree."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    spark = trials.sparkSession
    known = trials.select(*[F.col(f"`{p}`").cast("double").alias(f"p{i}") for i, p in enumerate(parameters)], F.col(f"`{objective}`").cast("double").alias("o")).dropna()
    names = [f"p{i}" for i in range(len(parameters))]
    ends = known.agg(*[f(n) for n in names for f in (F.min, F.max)]).first()
    if ends[0] is None:
        raise ValueError("no finished trials")
    low, high = np.array(ends[0::2], float), np.array(ends[1::2], float)
    frame = VectorAssembler(inputCols=names, outputCol="features").transform(known)
    model = RandomForestRegressor(labelCol="o", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=1, featureSubsetStrategy="all", seed=seed).fit(frame)
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    nodes = nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"))
    span = np.where(high > low, high - low, 1.0)

    def shares(group: pa.Table) -> pa.Table:
        rows = {r["id"]: r for r in group.to_pylist()}
        boxes, values, open_ = [], [], [(0, np.stack([np.zeros(len(low)), np.ones(len(low))], axis=1))]
        while open_:
            at, box = open_.pop()
            node = rows[at]
            if node["leftChild"] < 0:
                boxes.append(box)
                values.append(node["prediction"])
                continue
            j = node["feature"]
            cut = min(max((node["cut"] - low[j]) / span[j], box[j, 0]), box[j, 1])
            left, right = box.copy(), box.copy()
            left[j, 1] = right[j, 0] = cut
            open_ += [(node["leftChild"], left), (node["rightChild"], right)]
        found = box_shares(np.array(boxes), np.array(values))
        return pa.table({"place": np.arange(len(found)), "share": found})

    per = nodes.groupBy("treeID").applyInArrow(shares, "place long, share double")
    label = F.get(F.array(*[F.lit(p) for p in parameters]), F.col("place").cast("int"))
    return per.groupBy("place").agg(F.avg("share").alias("importance"), F.stddev_pop("share").alias("deviation")).select(label.alias("parameter"), "importance", "deviation")
