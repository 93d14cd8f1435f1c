"""Training of a classifier by synchronous steps over the cluster.

Balanced batches of the next epochs (at least one, up to ``AHEAD`` rows) are
drawn, their spectra joined, perturbed and preprocessed, and written once in
``SHARDS`` shards a batch; every task of a step adds up the gradients of its
shards, and the driver adds these few rows and moves the parameters (AdamW,
gradients clipped by their norm).  Small batches are dealt once to partitions of
their own, ``TASK_ROWS`` rows in each, and a step runs on its partitions alone;
batches of over ``SMALL_ROWS`` rows are read from a folder each.  What moves is a
row of parameters a shard; spectra stay in the tasks.

After each epoch one row with the parameters, the optimiser's moments and the
score so far is written: the checkpoint.  A run that finds checkpoints goes on
after the last; draws depend on the seed and a batch's number, and shards are
added in a fixed order, so it ends where an unbroken run would, to the bit.
Epochs end when the score has not risen for ``patience`` validations.

The score is the mean over classes of the share of validation rows that are
called right, since batches hold all classes alike.  Spectra that are null,
hold null or non-finite channels or differ in length from the axis, and rows
without a label take no part.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.config import Model, Trainer
from prismspark.operators import sampling
from prismspark.operators.evaluate import usable

#: Shards of a batch: tasks of a step, and rows that the driver adds.
SHARDS = 16
#: Rows that are drawn at once, if an epoch has fewer.
AHEAD = 100_000
#: Numbers of gradients that one step may bring to the driver.
MAX_VALUES = 16 << 20
#: Rows of a batch up to which it is dealt to partitions of its own, and rows of
#: such a partition, about.
SMALL_ROWS, TASK_ROWS = 8_192, 1_024
#: Classes that a model may have.
MAX_CLASSES = 1_000
#: Rows that a task multiplies at once.
ROWS = 2_048
BETAS, EPSILON = (0.9, 0.999), 1e-8
PACKED = "batch long, shard long, y binary, x binary"

Parameters = dict[str, np.ndarray]


# -- the model ---------------------------------------------------------------


def initial(channels: int, classes: int, model: Model, seed: int = 0) -> Parameters:
    """Zeros for a linear model; with hidden units, seeded uniform weights of
    the usual width."""
    if not model.hidden:
        return {"w": np.zeros((classes, channels)), "b": np.zeros(classes)}
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.uniform(-1, 1, shape) / math.sqrt(shape[-1])
    return {"v": draw(model.hidden, channels), "c": np.zeros(model.hidden), "w": draw(classes, model.hidden), "b": np.zeros(classes)}


def _logits(x: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """What enters the last layer, and what leaves it."""
    if "v" in p:
        x = x @ p["v"].T + p["c"]
        x = np.where(x > 0, x, 0.01 * x)
    return x, x @ p["w"].T + p["b"]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(x: np.ndarray, p: Parameters) -> np.ndarray:
    """Class probabilities of a batch, as ``scoring.score`` wants a network's."""
    if x.shape[1] != p["v" if "v" in p else "w"].shape[1]:
        raise ValueError(f"spectra of {x.shape[1]} channels")
    return _softmax(_logits(x, p)[1])


def losses(x: np.ndarray, y: np.ndarray, p: Parameters, gamma: float = 0.0) -> tuple[np.ndarray, np.ndarray, Parameters]:
    """Focal losses of the rows, whether each is called right, and the sum of
    their gradients."""
    last, z = _logits(x, p)
    probs = _softmax(z)
    own = np.clip(probs[np.arange(len(y)), y], 1e-300, 1.0)
    ce, rest = -np.log(own), 1 - own
    loss = rest**gamma * ce
    # d loss / d z_j = pull * ([j = y] - probs_j)
    pull = -(rest**gamma)
    if gamma:
        pull = pull - gamma * np.where(rest > 0, rest, 1.0) ** (gamma - 1) * own * ce * (rest > 0)
    dz = -probs * pull[:, None]
    dz[np.arange(len(y)), y] += pull
    grads = {"w": dz.T @ last, "b": dz.sum(axis=0)}
    if "v" in p:
        dh = dz @ p["w"] * np.where(last > 0, 1.0, 0.01)
        grads |= {"v": dh.T @ x, "c": dh.sum(axis=0)}
    return loss, probs.argmax(axis=1) == y, grads


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


# -- steps -------------------------------------------------------------------


def _sums(params: Parameters, channels: int, gamma: float):
    """Rows (shard, slot, y, x) to one row a shard: loss, hits, rows, gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            shards, slots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, labels, x in usable(batch, 2, 3):
                for own in np.unique(shards[at]).tolist() if x.shape[1] == channels else []:
                    rows = np.flatnonzero(shards[at] == own)
                    total = held.setdefault(own, [int(slots[at[rows[0]]]), 0.0, 0, 0, 0.0])
                    for k in range(0, len(rows), ROWS):
                        some = rows[k : k + ROWS]
                        loss, hits, grads = losses(x[some], labels[some], params, gamma)
                        for place, more in enumerate((loss.sum(), int(hits.sum()), len(hits), flat(grads)), 1):
                            total[place] = total[place] + more
        out = sorted(held.items())
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([k for k, _ in out], pa.int64()), "slot": pa.array([v[0] for _, v in out], pa.int64()), "loss": pa.array([v[1] for _, v in out], pa.float64()),
            "hits": pa.array([v[2] for _, v in out], pa.int64()), "n": pa.array([v[3] for _, v in out], pa.int64()), "g": pa.array([v[4] for _, v in out], pa.list_(pa.float64())),
        })

    return run


def gradient(batch: DataFrame, params: Parameters, channels: int, gamma: float) -> tuple[float, int, int, np.ndarray]:
    """Sum of losses, hits, rows and sum of gradients of a batch (shard, slot,
    y, x): at most a row a shard and task comes to the driver."""
    found = batch.select("shard", "slot", "y", "x").mapInArrow(_sums(params, channels, gamma), "shard long, slot long, loss double, hits long, n long, g array<double>").collect()
    if not found:
        return 0.0, 0, 0, np.zeros(sum(v.size for v in params.values()))
    found.sort(key=lambda r: (r["shard"], r["slot"]))
    g = np.zeros(len(found[0]["g"]))
    for r in found:
        g += r["g"]
    return sum(r["loss"] for r in found), sum(r["hits"] for r in found), sum(r["n"] for r in found), g


@dataclasses.dataclass
class State:
    """What a checkpoint holds."""

    params: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0
    epoch: int = -1
    best: float = -1.0
    best_epoch: int = -1
    wait: int = 0
    stopped: bool = False

    def move(self, g: np.ndarray, model: Model, clip: float) -> float:
        """One step of AdamW on the mean gradient; returns its norm."""
        norm = float(np.sqrt(g @ g))
        if clip:
            g = g * min(1.0, clip / (norm + 1e-6))
        self.step += 1
        self.m = BETAS[0] * self.m + (1 - BETAS[0]) * g
        self.v = BETAS[1] * self.v + (1 - BETAS[1]) * g * g
        m, v = self.m / (1 - BETAS[0] ** self.step), self.v / (1 - BETAS[1] ** self.step)
        self.params = self.params * (1 - model.lr * model.weight_decay) - model.lr * m / (np.sqrt(v) + EPSILON)
        return norm


def _shards(batches: Iterator[pa.RecordBatch], channels: int) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """((batch, shard), labels, spectra) of rows (batch, shard, y, x) that lie
    together."""
    last, ys, xs = None, [], []
    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        for at, labels, x in usable(batch, 2, 3):
            if x.shape[1] != channels:
                continue
            own = keys[at]
            for some in np.split(np.arange(len(own)), np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1):
                key = tuple(own[some[0]].tolist())
                if last not in (None, key):
                    yield last, np.concatenate(ys), np.concatenate(xs)
                    ys, xs = [], []
                last = key
                ys.append(labels[some])
                xs.append(x[some])
    if last is not None:
        yield last, np.concatenate(ys), np.concatenate(xs)


def _packed(channels: int):
    """Rows (batch, shard, y, x) that lie together to one row a batch and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch, shard), labels, x in _shards(batches, channels):
            yield pa.RecordBatch.from_pylist([{"batch": batch, "shard": shard, "y": labels.astype(np.int64).tobytes(), "x": np.ascontiguousarray(x).tobytes()}])

    return run


def dealt(packed: DataFrame, first: int, batches: int, tasks: int) -> RDD:
    """(shard, labels, spectra) of so many batches from number ``first``; the
    partitions from ``tasks`` times a batch's place on are its own."""
    keyed = packed.rdd.map(lambda r: ((r["batch"] - first) * tasks + r["shard"] % tasks, (r["shard"], bytes(r["y"]), bytes(r["x"]))))
    return keyed.partitionBy(batches * tasks, lambda k: k).values().persist(StorageLevel.DISK_ONLY)


def small_gradient(held: RDD, place: int, tasks: int, params: Parameters, channels: int, gamma: float) -> tuple[float, int, int, np.ndarray]:
    """``gradient`` of the batch at a place of ``dealt``."""

    def run(shards: Iterator[tuple[int, bytes, bytes]]) -> list:
        out = []
        for shard, y, x in shards:
            labels, spectra, total = np.frombuffer(y, np.int64), np.frombuffer(x).reshape(-1, channels), [0.0, 0, 0, 0.0]
            for k in range(0, len(labels), ROWS):
                loss, hits, grads = losses(spectra[k : k + ROWS], labels[k : k + ROWS], params, gamma)
                total = [a + b for a, b in zip(total, (float(loss.sum()), int(hits.sum()), len(hits), flat(grads)), strict=True)]
            out.append((shard, *total))
        return out

    found = sorted(held.context.runJob(held, run, range(place * tasks, (place + 1) * tasks)), key=lambda r: r[0])
    g = np.zeros(sum(v.size for v in params.values()))
    for r in found:
        g += r[4]
    return sum(r[1] for r in found), sum(r[2] for r in found), sum(r[3] for r in found), g


# -- epochs ------------------------------------------------------------------


def draw_batches(rows: DataFrame, ident: str, classes: int, batch_size: int, first: int, batches: int, seed: int, shards: int = SHARDS) -> DataFrame:
    """(batch, slot, shard, draw, y, x and the other columns of ``rows``): so many
    batches from number ``first``, equally many rows of each class and what is
    left of the size from all; ``draw`` numbers every row drawn."""
    per_class, extra = max(1, batch_size // classes), batch_size % classes if batch_size >= classes else 0
    drawn = sampling.balanced_batches(rows, "y", ident, batches, per_class, seed, extra, first).drop("y")
    out = drawn.join(rows, ident)
    return out.withColumns({"shard": F.col("slot") % shards, "draw": F.col("batch") * (per_class * classes + extra) + F.col("slot")})


def _last(spark: SparkSession, path: str) -> dict | None:
    try:
        found = spark.read.parquet(f"{path}/checkpoints").orderBy(F.desc("epoch")).first()
    except AnalysisException:
        return None
    return found.asDict() if found else None


def _restored(row: dict) -> State:
    fields = {f.name: row[f.name] for f in dataclasses.fields(State)}
    return State(**{k: np.array(v, float) if isinstance(v, list) else v for k, v in fields.items()})


def read_model(spark: SparkSession, path: str, best: bool = True) -> tuple[Parameters, list]:
    """Parameters of the best (or last) checkpoint, and the labels of classes."""
    found = _last(spark, path)
    if found is None:
        raise ValueError(f"{path} holds no checkpoints")
    if best and found["best_epoch"] not in (-1, found["epoch"]):
        found = spark.read.parquet(f"{path}/checkpoints").filter(F.col("epoch") == found["best_epoch"]).first().asDict()
    like = {k: np.zeros(tuple(int(s) for s in shape)) for k, shape in zip(found["names"], found["shapes"], strict=True)}
    return shaped(np.array(found["params"], float), like), list(found["classes"])


def history(spark: SparkSession, path: str) -> DataFrame:
    """A row an epoch: loss, accuracy and gradient norm of its steps, loss and
    score of the validation (null where it was not run), their gaps, the
    validations since the best score and what share of patience that is."""
    gap = lambda k: F.abs(F.col(f"train_{k}") - F.col(f"val_{k}")).alias(f"{k}_gap")
    return spark.read.parquet(f"{path}/checkpoints").select("epoch", "step", "train_loss", "train_acc", "grad_norm", "lr", "val_loss", "val_acc", gap("loss"), gap("acc"), "best", "best_epoch", "wait", "patience_used_pct", "stopped")


def validate(rows: DataFrame, params: Parameters, channels: int, classes: int, gamma: float) -> tuple[float, float]:
    """Mean loss of the rows (y, x), and mean over classes of the share called
    right; a row a class comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, hits, n = np.zeros(classes), np.zeros(classes, int), np.zeros(classes, int)
        for batch in batches:
            for _, labels, x in usable(batch, 0, 1):
                if x.shape[1] != channels:
                    continue
                part, right, _ = losses(x, labels, params, gamma)
                loss, hits, n = loss + np.bincount(labels, part, classes), hits + np.bincount(labels[right], minlength=classes), n + np.bincount(labels, minlength=classes)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"y": at, "loss": loss[at], "hits": hits[at], "n": n[at]})

    found = rows.select("y", "x").mapInArrow(run, "y long, loss double, hits long, n long")
    found = found.groupBy("y").agg(F.sum("loss").alias("loss"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).orderBy("y").collect()
    if not found:
        return math.nan, math.nan
    return sum(r["loss"] for r in found) / sum(r["n"] for r in found), sum(r["hits"] / r["n"] for r in found) / len(found)


def train(
    rows: DataFrame,
    held_out: DataFrame,
    ident: str,
    channels: int,
    path: str,
    model: Model | None = None,
    trainer: Trainer | None = None,
    seed: int = 0,
    prepare: Callable[[DataFrame], DataFrame] = lambda drawn: drawn,
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    class_labels: Sequence | None = None,
    batches: int | None = None,
) -> DataFrame:
    """Train on ``rows`` (ident, y, x), validate on ``held_out`` (y, x), keep
    checkpoints under ``path``; returns ``history``.

    ``prepare`` perturbs drawn rows (keyed by ``draw``, a number of every row
    of all epochs; an epoch has as many batches as fill the rows, or ``batches``)
    and ``finish`` preprocesses these and the held-out rows, to ``channels``."""
    model, trainer, spark = model or Model(), trainer or Trainer(), rows.sparkSession
    rows, held_out = rows.filter("y is not null and x is not null"), held_out.filter("y is not null and x is not null")
    if class_labels is None:
        class_labels = [r[0] for r in rows.select("y").distinct().orderBy("y").limit(MAX_CLASSES + 1).collect()]
        if len(class_labels) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
    if not class_labels:
        raise ValueError("no rows to train on")
    # Every epoch draws from these rows: once written, no epoch works them out anew.
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    classes = len(class_labels)
    like = initial(channels, classes, model, seed)
    size = sum(v.size for v in like.values())
    shards = max(1, min(SHARDS, MAX_VALUES // max(1, size)))
    place = F.array_position(F.array(*[F.lit(c) for c in class_labels]), F.col("y")) - 1
    held_path = f"{path}/held-out"
    # No filter on what ``finish`` makes: it would be worked out once more for that.
    finish(held_out.withColumn("y", place).filter("y >= 0")).select(F.col("y").cast("long"), "x").write.mode("overwrite").parquet(held_path)
    held = spark.read.parquet(held_path)
    found = _last(spark, path)
    state = _restored(found) if found else State(flat(like), np.zeros(size), np.zeros(size))
    batches = batches or max(1, rows.count() // trainer.batch_size)
    patience = max(trainer.least_patience, trainer.early_stopping_patience // trainer.val_every_n_epochs)
    last = max(trainer.max_epochs, trainer.min_epochs)
    schema = "params array<double>, m array<double>, v array<double>, step long, epoch long, best double, best_epoch long, wait long, stopped boolean, train_loss double, train_acc double, grad_norm double, lr double, val_loss double, val_acc double, patience_used_pct double, names array<string>, shapes array<array<long>>, classes array<string>"
    small, parts = trainer.batch_size <= SMALL_ROWS, max(1, min(shards, -(-trainer.batch_size // TASK_ROWS)))
    ready, own = 0, None
    while state.epoch + 1 < last and not state.stopped:
        epoch = state.epoch + 1
        if epoch >= ready:
            first, ready = epoch * batches, min(last, epoch + max(1, AHEAD // (batches * trainer.batch_size)))
            drawn = finish(prepare(draw_batches(rows, ident, classes, trainer.batch_size, first, ready * batches - first, seed, shards)))
            drawn = drawn.select("batch", "shard", "slot", place.cast("long").alias("y"), "x")
            folder = f"{path}/batches-{first}"
            tasks = min((ready * batches - first) * shards, 4 * spark.sparkContext.defaultParallelism)
            ordered = drawn.repartition(tasks, "batch", "shard").sortWithinPartitions("batch", "shard", "slot")
            if small:
                ordered.select("batch", "shard", "y", "x").mapInArrow(_packed(channels), PACKED).write.mode("overwrite").parquet(folder)
                if own is not None:
                    own.unpersist()
                own = dealt(spark.read.schema(PACKED).parquet(folder), first, ready * batches - first, parts)
            else:
                ordered.write.mode("overwrite").partitionBy("batch").parquet(folder)
        loss = hits = n = norm = 0.0
        for step in range(batches):
            if small:
                part, right, count, g = small_gradient(own, epoch * batches + step - first, parts, shaped(state.params, like), channels, model.gamma)
            else:
                batch = spark.read.schema("shard long, slot long, y long, x array<double>").parquet(f"{folder}/batch={epoch * batches + step}")
                part, right, count, g = gradient(batch, shaped(state.params, like), channels, model.gamma)
            if count:
                norm += state.move(g / count, model, trainer.gradient_clip_val) / batches
                loss, hits, n = loss + part, hits + right, n + count
        state.epoch = epoch
        checked = (epoch + 1) % trainer.val_every_n_epochs == 0
        val_loss, val_acc = validate(held, shaped(state.params, like), channels, classes, model.gamma) if checked else (None, None)
        if checked:
            if val_acc > state.best:  # not so for NaN, where no rows are held out
                state.best, state.best_epoch, state.wait = val_acc, epoch, 0
            else:
                state.wait += 1
            state.stopped = state.wait >= patience and epoch + 1 >= trainer.min_epochs
        log = (loss / n if n else None, hits / n if n else None, norm, model.lr, val_loss, val_acc, 100.0 * state.wait / patience)
        names = sorted(like)
        row = (state.params.tolist(), state.m.tolist(), state.v.tolist(), state.step, state.epoch, float(state.best), state.best_epoch, state.wait, state.stopped, *log, names, [list(like[k].shape) for k in names], [str(c) for c in class_labels])
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{path}/checkpoints")
    if own is not None:
        own.unpersist()
    return history(spark, path)
