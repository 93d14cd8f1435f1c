"""Axes in tables, streams of batches, clustered files, forests, laws."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismspark.functions import kernels
from prismspark.operators import axes, evaluate, sampling, scoring
from prismspark.sources import predictions


def test_brackets_equal_interpolation(spark):
    rng = np.random.default_rng(2)
    axis = {k: np.sort(rng.uniform(0, 100, 12)) for k in ("up", "down", "tied")}
    axis["down"], axis["tied"][5] = axis["down"][::-1], axis["tied"][4]
    goal = {k: np.concatenate([rng.uniform(-20, 120, 9), axis[k][:3]]) for k in axis}
    table = lambda found: spark.createDataFrame([(k, c, float(v)) for k, w in found.items() for c, v in enumerate(w)] + [("none", 0, None)], "image string, ch int, wn double")
    rows = [(i, k, rng.standard_normal(12).tolist()) for i, k in enumerate(["up", "down", "tied"] * 4)] + [(99, "lacking", [1.0])]
    got = {r["id"]: r["x"] for r in axes.resample(spark.createDataFrame(rows, "id int, image string, x array<double>"), table(axis), table(goal), "image").collect()}
    assert sorted(got) == list(range(12))
    for i, k, x in rows[:12]:
        order = np.argsort(axis[k], kind="stable")
        for have, at in zip(got[i], goal[k], strict=True):
            if k != "tied" or at != axis[k][4]:
                assert have == pytest.approx(np.interp(at, axis[k][order], np.array(x)[order]))


def test_windows_count_channels_once(spark):
    axis = spark.createDataFrame([(k, c, float(c * (k + 1))) for k in (0, 1) for c in range(200)], "image int, ch int, wn double")
    windows = spark.createDataFrame([(0, 5.0, 20.0), (0, 10.0, 30.5), (0, 10.0, 30.5), (0, 199.0, 1e6), (1, 7.0, 7.0), (1, 9.0, 8.0), (1, 50.0, 52.0)], "image int, low double, high double")
    found = {k: sorted(r["ch"] for r in axes.inside(axis, windows, "image").collect() if r["image"] == k) for k in (0, 1)}
    assert found == {0: [*range(5, 31), 199], 1: [25, 26]}
    plan = axes.inside(axis, windows, "image")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = spark.createDataFrame([(1, [float(c) for c in range(200)])], "image int, x array<double>")
    assert axes.crop(rows, axis, windows, "image").first()["x"] == [25.0, 26.0]
    with pytest.raises(ValueError, match="no channel"):
        axes.crop(rows, axis, windows.filter("image = 0"), "image")
    assert axes.inside(axis, windows.limit(0), "image").count() == 0


def test_stream_of_batches_goes_on_after_a_stop(spark, tmp_path):
    from prismspark.streaming.batches import balanced_stream

    rows = spark.range(60).select("id", (F.col("id") % 3 * F.col("id") % 4).alias("y"), (F.col("id") * 2).alias("v"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))

    def go(batches):
        query = balanced_stream(rows, "y", "id", 4, 9, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
        until = time.time() + 90
        while time.time() < until and (query.lastProgress or {}).get("batchId", -1) < batches:
            time.sleep(0.2)
        query.stop()

    go(1)
    first = spark.read.parquet(str(tmp_path / "out")).agg(F.max("batch")).first()[0]
    go(first + 2)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    last = max(r["batch"] for r in out)
    assert last >= first + 1
    want = sampling.balanced_batches(rows, "y", "id", last + 1, 4, 9, 2).collect()
    order = {}
    for r in sorted(out, key=lambda r: (r["batch"], r["mixed"])):
        order.setdefault(r["batch"], []).append(r["id"])
    for b in range(last + 1):
        assert sorted(order[b]) == sorted(r["id"] for r in want if r["batch"] == b) and len(order[b]) == 4 * rows.select("y").distinct().count() + 2


def test_clustered_files_are_pruned(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("t").alias("trial_id"), F.format_string("im%02d", F.when(F.col("id") < 700, F.lit(5)).otherwise(F.col("id") % 30)).alias("image"), F.col("id").alias("px"), F.lit(1).alias("argmax"))
    path, trial = str(tmp_path), rows.select("trial_id").distinct()
    predictions.save_clustered(rows.repartition(5), trial, path, 50)
    every = {r["file"] for r in spark.read.parquet(f"{path}/files").collect()}
    assert 15 <= len(every) <= 24
    files = predictions.clustered_files(spark, path, "t", "im05", 100, 150)
    assert 1 <= len(files) <= 3 and set(files) < every
    got = predictions.load_range(spark, path, "t", "im05", 100, 150)
    assert {f.rsplit("/", 1)[1] for f in got.inputFiles()} == {f.rsplit("/", 1)[1] for f in files} and sorted(r["px"] for r in got.collect()) == list(range(100, 150))
    assert predictions.load_range(spark, path, "t", "im29").count() == rows.filter("image = 'im29'").count()
    assert predictions.load_range(spark, path, "t", "nowhere").count() == predictions.load_range(spark, path, "u", "im05").count() == 0
    predictions.save_clustered(rows.filter("px < 10"), trial, path)  # the trial as a whole
    assert predictions.load_range(spark, path, "t", "im05").count() == 10


def test_box_shares_equal_a_grid():
    """Random boxes by cutting, against means over a fine grid."""
    rng = np.random.default_rng(4)
    boxes = [np.array([[0.0, 1.0]] * 3)]
    for _ in range(25):
        box, j = boxes.pop(rng.integers(len(boxes))), rng.integers(3)
        cut = np.round(rng.uniform(*box[j]) * 32) / 32
        left, right = box.copy(), box.copy()
        left[j, 1] = right[j, 0] = cut
        boxes += [b for b in (left, right) if (b[:, 1] > b[:, 0]).all()]
    boxes, values = np.array(boxes), rng.standard_normal(len(boxes))
    mids = (np.arange(32) + 0.5) / 32
    grid = np.zeros((32, 32, 32))
    for b, v in zip(boxes, values, strict=True):
        grid[np.ix_(*[(mids > lo) & (mids < hi) for lo, hi in b])] = v
    want = [grid.mean(axis=tuple(set(range(3)) - {j})).var() / grid.var() for j in range(3)]
    assert scoring.box_shares(boxes, values) == pytest.approx(want)
    # An additive function is explained by its parameters alone.
    cells = np.array([[[i / 4, (i + 1) / 4], [j / 4, (j + 1) / 4]] for i, j in itertools.product(range(4), repeat=2)])
    added = np.array([3.0 * i + j for i, j in itertools.product(range(4), repeat=2)])
    assert scoring.box_shares(cells, added) == pytest.approx([0.9, 0.1])


def test_forest_explains_an_additive_function(spark, tmp_path):
    rows = [(i / 10, j / 10, 0.5, 3.0 * (i >= 5) + 1.0 * (j >= 5)) for i in range(10) for j in range(10)] + [(None, 1.0, 0.5, 9.0), (0.1, 0.1, 0.5, None)]
    trials = spark.createDataFrame(rows, "lr double, width double, idle double, score double")
    got = {r["parameter"]: r["importance"] for r in scoring.functional_anova(trials, ["lr", "width", "idle"], "score", str(tmp_path / "f"), trees=8).collect()}
    assert got["lr"] == pytest.approx(0.9, abs=0.02) and got["width"] == pytest.approx(0.1, abs=0.02) and got["idle"] == 0
    with pytest.raises(ValueError, match="finished"):
        scoring.functional_anova(trials.limit(0), ["lr"], "score", str(tmp_path / "g"))


def test_deviations_equal_those_of_refits(spark):
    rng, n = np.random.default_rng(5), np.array([8.0, 16, 32, 64, 128, 256, 512, 1024, 2048])
    std = 0.004 + 0.02 * n**-0.5
    weight = 1 / (std + 1e-5)
    fits, stated = [], []
    for _ in range(150):
        error = 1.2 * n**-0.6 + 0.1 + std * rng.standard_normal(9)
        fits.append(kernels.fit_power_law(n, error, weight))
        stated.append(kernels.power_law_deviations(n, error, fits[-1], weight))
    assert np.median(stated, axis=0) == pytest.approx(np.std(fits, axis=0), rel=0.25)
    curve = [(arm, int(k), 3, float(1.2 * k**-alpha + 0.1 + s * rng.standard_normal()), float(s)) for arm, alpha in ((0, 0.4), (1, 0.6)) for k, s in zip(n, std / 10, strict=True)]
    frame = spark.createDataFrame(curve, "arm long, n long, trials long, error double, std double")
    found = evaluate.exponent_difference(frame).first()
    assert found["arm"] == 1 and abs(found["difference"] - 0.2) < 4 * found["std"] < 0.2
    assert np.isnan(kernels.power_law_deviations(n[:2], n[:2], (1.0, 0.5, 0.1))).all() and kernels.power_law_deviations(n, n * 0, (0.0, 0.3, 0.0)).tolist()[0] == 0


def test_sql_functions(spark):
    from prismspark.functions import sql

    assert {"spectrum_snv", "top_channels"} <= set(sql.register(spark))
    rows = spark.createDataFrame([(1, [1.0, 3.0, 3.0, None, float("nan")]), (2, None), (3, [])], "i int, x array<double>")
    found = spark.sql("select i, t.* from {rows}, lateral top_channels(x, 2) t", rows=rows).collect()
    assert [tuple(r) for r in found] == [(1, 1, 1, 3.0), (1, 2, 2, 3.0)]
    wide = spark.sql("select i, t.* from {rows}, lateral resampled(x, 0D, 1D, 3) t order by i", rows=rows)
    assert wide.columns == ["i", "w0", "w1", "w2"] and [tuple(r) for r in wide.collect()] == [(1, 1.0, 2.0, 3.0), (2, None, None, None), (3, None, None, None)]
    for text in ("select * from {rows}, lateral top_channels(x, i) t", "select * from top_channels(1, 2)", "select * from {rows}, lateral top_channels(x, -1) t"):
        with pytest.raises(Exception, match="top_channels takes"):
            spark.sql(text, rows=rows).collect()
    assert "ArrowEvalPython" not in spark.sql("select spectrum_snv(x) from {rows}", rows=rows)._jdf.queryExecution().executedPlan().toString()
