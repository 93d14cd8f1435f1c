"""Training against a plain loop, and across a break."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismspark.config import Model, Trainer
from prismspark.operators import training


#: Rows that can be learnt from.
WHOLE = "coalesce(size(x) = 6 and not exists(x, v -> v is null or isnan(v)), false)"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((3, 6))
    data = [(i, "abc"[i % 3], (centres[i % 3] + 0.8 * rng.standard_normal(6)).tolist()) for i in range(90)]
    data += [(100, "a", None), (101, None, [1.0] * 6), (102, "b", [1.0] * 5), (103, "c", [float("nan")] * 6), (104, "a", [None] * 6)]
    return spark.createDataFrame(data, "id long, y string, x array<double>").repartition(3).cache()


@pytest.mark.parametrize(("hidden", "gamma"), [(0, 0.0), (0, 1.0), (5, 0.0), (5, 2.0)])
def test_gradients_are_slopes(hidden, gamma):
    rng = np.random.default_rng(1)
    p = {k: v + 0.3 * rng.standard_normal(v.shape) for k, v in training.initial(4, 3, Model(hidden=hidden)).items()}
    x, y, values = rng.standard_normal((7, 4)), rng.integers(0, 3, 7), training.flat(p)
    g = training.flat(training.losses(x, y, p, gamma)[2])
    for k in range(len(values)):
        ends = []
        for h in (1e-6, -1e-6):
            moved = values.copy()
            moved[k] += h
            ends.append(training.losses(x, y, training.shaped(moved, p), gamma)[0].sum())
        assert g[k] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def test_equals_a_plain_loop(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "AHEAD", 170)  # two epochs, then one
    model, trainer = Model(lr=0.05, gamma=1.0, weight_decay=0.01), Trainer(batch_size=20, max_epochs=3, min_epochs=1, gradient_clip_val=0.3)
    got = training.train(rows, rows, "id", 6, str(tmp_path), model, trainer, 4).orderBy("epoch").collect()
    batches = rows.filter("y is not null and x is not null").count() // 20
    state, like = None, training.initial(6, 3, model)
    state = training.State(training.flat(like), np.zeros(21), np.zeros(21))
    whole = rows.filter(WHOLE).filter("y is not null").collect()
    for epoch in range(3):
        drawn = training.draw_batches(rows.filter("y is not null and x is not null"), "id", 3, 20, epoch * batches, batches, 4).filter(WHOLE).collect()
        assert len({r["draw"] for r in drawn}) == len(drawn)
        loss = n = 0
        for b in range(batches):
            own = [r for r in drawn if r["batch"] == epoch * batches + b]
            part, _, g = training.losses(np.array([r["x"] for r in own]), np.array(["abc".index(r["y"]) for r in own]), training.shaped(state.params, like), 1.0)
            state.move(training.flat(g) / len(own), model, 0.3)
            loss, n = loss + part.sum(), n + len(own)
        right = training.losses(np.array([r["x"] for r in whole]), np.array(["abc".index(r["y"]) for r in whole]), training.shaped(state.params, like))[1]
        score = np.mean([right[[r["y"] == c for r in whole]].mean() for c in "abc"])
        assert got[epoch]["train_loss"] == pytest.approx(loss / n) and got[epoch]["val_acc"] == pytest.approx(score)
    assert got[2]["train_loss"] < got[0]["train_loss"] and got[2]["step"] == 3 * batches
    params, classes = training.read_model(spark, str(tmp_path), best=False)
    assert classes == list("abc") and np.allclose(training.flat(params), state.params, atol=1e-12)


def test_resumed_run_equals_an_unbroken_one(spark, rows, tmp_path):
    noisy = lambda drawn: drawn.withColumn("x", F.transform("x", lambda v: v + (F.col("draw") % 7 - 3) * 0.01))
    go = lambda path, epochs: training.train(rows, rows, "id", 6, str(tmp_path / path), Model(hidden=4), Trainer(batch_size=30, max_epochs=epochs, min_epochs=1), 2, noisy)
    whole = go("a", 4).orderBy("epoch").collect()
    go("b", 2)
    assert go("b", 4).orderBy("epoch").collect() == whole
    assert training.flat(training.read_model(spark, str(tmp_path / "b"))[0]).tolist() == training.flat(training.read_model(spark, str(tmp_path / "a"))[0]).tolist()
    assert go("b", 4).count() == 4  # nothing is left to do


def test_stops_early_and_keeps_the_best(spark, rows, tmp_path):
    still = Trainer(batch_size=90, max_epochs=9, min_epochs=3, early_stopping_patience=1, least_patience=1)
    log = training.train(rows, rows, "id", 6, str(tmp_path / "a"), Model(lr=0.0), still).orderBy("epoch").collect()
    assert len(log) == 3 and log[-1]["stopped"] and log[-1]["best_epoch"] == 0 and log[-1]["wait"] == 2 and log[-1]["patience_used_pct"] == 200
    every = training.train(rows, rows, "id", 6, str(tmp_path / "b"), Model(), Trainer(batch_size=90, max_epochs=4, min_epochs=1, val_every_n_epochs=2)).orderBy("epoch").collect()
    assert [r["val_acc"] is None for r in every] == [True, False, True, False]
    best, _ = training.read_model(spark, str(tmp_path / "b"))
    at = max((r["val_acc"], -r["epoch"]) for r in every if r["val_acc"] is not None)
    found = spark.read.parquet(str(tmp_path / "b" / "checkpoints")).filter(F.col("epoch") == -at[1]).first()
    assert training.flat(best).tolist() == found["params"]


def test_no_rows(spark, rows, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        training.train(rows.limit(0), rows, "id", 6, str(tmp_path))
    with pytest.raises(ValueError, match="no checkpoints"):
        training.read_model(spark, str(tmp_path / "nowhere"))


def test_small_steps_read_no_folder_each(spark, rows, tmp_path, monkeypatch):
    trainer = Trainer(batch_size=20, max_epochs=2, min_epochs=2, gradient_clip_val=0.3)
    go = lambda path: training.train(rows, rows, "id", 6, str(tmp_path / path), Model(hidden=4, gamma=1.0), trainer, 2, batches=3).orderBy("epoch").collect()
    monkeypatch.setattr(training, "TASK_ROWS", 8)
    small = go("small")
    assert small[-1]["step"] == 6 and not list((tmp_path / "small").glob("batches-*/batch=*"))
    monkeypatch.setattr(training, "SMALL_ROWS", 0)
    assert go("large") == small  # to the bit
