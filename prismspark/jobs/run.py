"""One run from spectra to evaluated, stored predictions."""

from __future__ import annotations

import dataclasses
import platform
import time
from concurrent.futures import ThreadPoolExecutor

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.config import Config
from prismspark.operators import evaluate, perturb, preprocess, sampling, scoring, training
from prismspark.sources import predictions

SPLITS = ("patient", "label", "test")


def split(rows: DataFrame, config: Config) -> DataFrame:
    """``rows`` with ``part``; with the split 'test' the rows bring their own."""
    kind = config.data.split
    if kind not in SPLITS:
        raise ValueError(f"Unknown split {kind!r}; known: {list(SPLITS)}")
    if kind == "test":
        if "part" not in rows.columns:
            raise ValueError("the split 'test' needs rows with a column part (train or test)")
        return rows
    if kind == "patient":
        return sampling.patient_split(rows, "patient", 1 - config.data.train_ratio, config.seed)
    return sampling.label_split(rows, "y", "vec_id", config.data.train_ratio, config.seed)


def steps(config: Config) -> list[dict]:
    """Preprocessing, and the z-score after it if the run wants one."""
    return preprocess.resolve(config.data.preprocessing) + [{"type": "z_normalize"}] * config.data.z_normalize


def training_sample(rows: DataFrame, config: Config) -> tuple[DataFrame, Column | None]:
    """An even sample of the training rows, and what tells its background rows.
    Rows that have a ``value`` are drawn from the pools of signal and background,
    the latter as class 'bkg'."""
    train = rows.filter("part = 'train'")
    if "value" not in rows.columns:
        return sampling.water_fill(train, "y", "image", "vec_id", config.data.per_class, config.seed), None
    train = sampling.hyperspectral_sample(train, "y", "image", "vec_id", "value", config.data.per_class, config.data.signal_above, config.data.background_below, config.seed)
    # A pixel may be in both pools, so its id alone is not its row's.
    train = train.withColumns({"y": F.col("class"), "vec_id": 2 * F.col("vec_id") + (F.col("class") == "bkg").cast("long")})
    return train.drop("class", "pool"), F.col("y") == "bkg"


def train(spark: SparkSession, parts: DataFrame, axis: list[float], config: Config, out: str, log: predictions.Tracker) -> DataFrame:
    """Fit the preprocessing and the perturbations' backgrounds on the sample as
    it is, then train on drawn, perturbed and preprocessed batches of its
    training share; the state is kept under ``out``/state, checkpoints under
    ``out``/model.  Returns the perturbed and preprocessed sample."""
    sample, background = training_sample(parts, config)
    if config.model.num_classes:
        sampling.check_class_count(sample, "y", config.model.num_classes)
    shares = sampling.label_split(sample, "y", "vec_id", 1 - config.data.val_share, config.seed + 1)
    kept, held = shares.filter("part = 'train'").drop("part"), shares.filter("part = 'test'").drop("part")
    state = preprocess.fit(kept, axis, steps(config))
    predictions.save_state(spark, state, f"{out}/state")
    entries = config.data.augmentations if config.data.augment_train else []
    basis = perturb.fit(kept, entries, parts.filter("part = 'train'"), core="image")

    def perturbed(rows: DataFrame, ident: str) -> DataFrame:
        return perturb.perturb(rows, ident, axis, entries, config.seed, 1.0, background, basis)

    def finish(rows: DataFrame) -> DataFrame:
        return preprocess.apply(rows, axis, steps(config), state)[0]

    began = time.monotonic()
    channels = len(preprocess.apply(kept.limit(0), axis, steps(config), state)[1])
    epochs = training.train(kept, held, "vec_id", channels, f"{out}/model", config.model, config.trainer, config.seed, lambda drawn: perturbed(drawn, "draw"), finish)
    took, last = max(time.monotonic() - began, 1e-9), epochs.orderBy(F.desc("epoch")).first()
    parameters, _ = training.read_model(spark, f"{out}/model")
    log.parameters({"n_params": sum(v.size for v in parameters.values())})
    done = last["epoch"] + 1
    for key, value in {"epochs_per_second": done / took, "samples_per_second": last["step"] * config.trainer.batch_size / took, "best_val_acc": last["best"], "final_epoch": last["epoch"]}.items():
        log.metric(key, value, last["step"])
    log.tag("stopped_early", last["stopped"])
    log.tag("ckpt_path", f"{out}/model/checkpoints epoch {last['best_epoch']}")
    return finish(perturbed(sample, "vec_id"))


def run(spark: SparkSession, rows: DataFrame, axis: list[float], config: Config, out: str, weights: dict | None = None, mode: str = "all") -> DataFrame:
    """Train on an even sample, keep the state of the preprocessing and the
    model, score the test rows and save predictions (``mode`` train, infer or
    all).  ``weights`` of a network are scored instead of the trained model.
    Returns accuracy per class of the pixels that are not called background, or
    the perturbed and preprocessed sample in mode train.  A spectrum that cannot
    be scored does not stop others: it has no probabilities, and its image is
    listed under ``failed``.  Settings, versions, minutes, throughput and the
    best validation score are logged."""
    if mode not in ("train", "infer", "all"):
        raise ValueError(f"Unknown mode {mode!r}; known: ['train', 'infer', 'all']")
    trial = f"N{config.data.per_class}_seed{config.seed:02d}_raw"
    with predictions.make_tracker("table", spark, f"{out}/log", trial) as log:
        log.parameters(dataclasses.asdict(config))
        log.parameters({"mode": mode, "spark": pyspark.__version__})
        log.tag("host", platform.node())
        parts, began = split(rows, config), time.monotonic()
        if mode in ("train", "all"):
            sample = train(spark, parts, axis, config, out, log)
            log.metric("train_minutes", (time.monotonic() - began) / 60)
            if mode == "train":
                return sample
        began = time.monotonic()
        state = predictions.load_state(spark, f"{out}/state")
        test, after = preprocess.apply(parts.filter("part = 'test'"), axis, steps(config), state)
        network = scoring.forward
        if weights is None:
            weights, classes = training.read_model(spark, f"{out}/model")
            network = training.probabilities
            # Places of the model's classes, as predictions have them.
            test = test.withColumn("y", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y").cast("string")) - 1)
        scored = scoring.score(test, weights, network, batch=config.inference.batch, channels=len(after))
        kept = predictions.records(scored.withColumn("trial_id", F.lit(trial)), config.inference.top_k)
        predictions.save(kept, spark.createDataFrame([(trial, config.data.per_class, config.seed)], "trial_id string, n int, seed int"), out)
        saved = predictions.load(spark, out).filter(F.col("trial_id") == trial)
        failed = saved.withColumn("probs", F.when(F.col("argmax").isNotNull(), F.array("bg_prob")))
        scoring.failed_images(failed).write.mode("overwrite").parquet(f"{out}/failed")
        minutes = (time.monotonic() - began) / 60
        log.metric("infer_minutes", minutes)
        log.metric("spectra_per_second", saved.count() / max(60 * minutes, 1e-9))
        signal = saved.filter(F.col("bg_prob") <= config.inference.background_threshold)
        return evaluate.accuracy(signal.select(F.col("true_label").alias("gt"), F.col("argmax").cast("int").alias("pred")), "gt")


def best_score(spark: SparkSession, out: str) -> float | None:
    """Best validation score of the runs logged under ``out``."""
    return spark.read.parquet(f"{out}/log").filter("kind = 'metric' and key = 'best_val_acc'").agg(F.max("value")).first()[0]


def sweep(spark: SparkSession, rows: DataFrame, axis: list[float], configs: dict[str, Config], out: str, weights: dict | None = None, parallel: int = 4) -> DataFrame:
    """(trial, objective, error) of every configuration: the best validation
    score of its training, or the mean accuracy of its run with given weights.
    ``parallel`` trials run at a time, so that the cluster stays busy; one that
    fails has no objective and its error, and does not stop others."""

    def trial(item: tuple[str, Config]) -> tuple[str, float | None, str | None]:
        name, config = item
        try:
            accuracy = run(spark, rows, axis, config, f"{out}/{name}", weights, "all" if weights else "train")
            return name, accuracy.agg(F.avg("accuracy")).first()[0] if weights else best_score(spark, f"{out}/{name}"), None
        except Exception as error:  # noqa: BLE001 - the trial's, and it is kept
            return name, None, f"{type(error).__name__}: {error}"[:500]

    with ThreadPoolExecutor(parallel) as pool:
        return spark.createDataFrame(list(pool.map(trial, configs.items())), "trial string, objective double, error string")
