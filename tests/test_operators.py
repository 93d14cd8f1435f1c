from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prismspark.config import Config, draw_trials, load, override, preset
from prismspark.functions import hashrand, native
from prismspark.jobs.run import run, sweep
from prismspark.operators import augment, evaluate, perturb, preprocess, sampling, scoring
from prismspark.sources import predictions, stores
from prismspark.sources.tables import AXIS, spectra

SF_DIR = "/root/testdata/sf0.001"


def arrays(spark, *rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, x array<double>")


def test_constant_spectrum_has_no_spread(spark):
    r = arrays(spark, [2, 2, 2]).select(native.standardized(F.col("x")).alias("z"), native.unit_norm(F.col("x")).alias("u")).first()
    assert r["z"] == [0, 0, 0] and abs(sum(v * v for v in r["u"]) - 1) < 1e-9


def test_missing_channels_fall_back(spark):
    frame = arrays(spark, [1, math.nan, 3], [1, 2, math.inf])
    assert all(r[0] for r in frame.select(F.exists(native.finite_or_zero(F.col("x")), lambda v: v == 0)).collect())
    kept = frame.select(native.finite_or(F.col("x"), F.array(F.lit(9.0))).alias("k")).collect()
    assert [r["k"] for r in kept] == [[9.0], [9.0]]


def test_ties_go_to_the_first(spark):
    r = arrays(spark, [0.3, 0.4, 0.4, 0.1]).select(native.argmax(F.col("x")).alias("a"), native.top_k(F.col("x"), 3).alias("t"), native.lower_median(F.col("x")).alias("m")).first()
    assert r["a"] == 1 and [t["cls"] for t in r["t"]] == [1, 2, 0] and r["m"] == 0.3


@pytest.mark.parametrize("budget", [1, 7, 50, 1000])
def test_water_fill_is_even(spark, budget):
    sizes = {0: 3, 1: 40, 2: 11, 3: 1}
    rows = spark.createDataFrame([("a", c, c * 1000 + i) for c, n in sizes.items() for i in range(n)], "label string, core long, id long")
    got = {r["core"]: r["quota"] for r in sampling.water_fill_quotas(rows, "label", "core", "id", budget).collect()}
    assert sum(got.values()) == min(budget, sum(sizes.values()))
    level = max(got.values())
    assert all(n >= min(sizes[c], level - 1) for c, n in got.items())


def test_patients_stay_on_one_side(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, patient long")
    parts = sampling.patient_split(rows, "patient", 0.3).select("patient", "part").distinct().collect()
    assert len(parts) == 5 and sum(r["part"] == "test" for r in parts) == 2  # 1.5 rounds to even
    with pytest.raises(ValueError):
        sampling.patient_split(spark.createDataFrame([(1, None)], "id long, patient long"), "patient", 0.3)


def test_pools_leave_out_nan(spark):
    rows = spark.createDataFrame([(1, math.nan), (2, 5.0), (3, None), (4, 0.5)], "id long, v double")
    assert {(r["id"], r["pool"]) for r in sampling.pools(rows, F.col("v"), 1.0, 1.0).collect()} == {(2, "signal"), (4, "bkg")}


def test_unknown_classes_are_named(spark):
    with pytest.raises(ValueError, match="known: \\['a'\\]"):
        sampling.check_classes(["a", "z"], spark.createDataFrame([("a",)], "c string"), "c")


def test_chain_is_fused_and_fitted(spark):
    rows = spectra(spark, SF_DIR).limit(40)
    steps = [{"type": "crop", "keep": [[800, 3600]]}, {"type": "savgol", "window": 5, "polyorder": 2}, {"type": "emsc"}, {"type": "snv", "enabled": False}]
    state = preprocess.fit(rows, AXIS, steps)
    out, axis = preprocess.apply(rows, AXIS, steps, state)
    assert len(axis) == len(state["reference"]) and out.count() == 40
    assert len(out.first()["x"]) == len(axis)
    with pytest.raises(RuntimeError):
        preprocess.apply(rows, AXIS, [{"type": "emsc"}])
    with pytest.raises(KeyError):
        preprocess.resolve({"enabled": False, "steps": [{"type": "nothing"}]})


def test_empty_and_null_spectra(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1.0, 2.0])], "vec_id long, x array<double>")
    got = {r["vec_id"]: r["x"] for r in preprocess.map_spectra(rows, lambda x: x * 2).collect()}
    assert got[3] == [2.0, 4.0] and not got[1] and not got[2]


def test_cosmic_rays_are_rare_and_high(spark):
    rows = spectra(spark, SF_DIR)
    before = {r["vec_id"]: np.array(r["x"]) for r in rows.collect()}
    after = {r["vec_id"]: np.array(r["x"]) for r in augment.cosmic_rays(rows, "vec_id", rate=0.01, seed=3).collect()}
    changed = np.array([(np.abs(after[k] - v) > 1e-12).sum() for k, v in before.items()])
    assert 0.3 < changed.mean() < 1.2  # 0.64 spikes a row are expected, nearly all on one channel


def test_noise_repeats_by_seed(spark):
    rows = spectra(spark, SF_DIR).limit(20)
    noisy = rows.select("vec_id", augment.shot_noise(F.col("x"), F.lit(0.1), 0.01, 4, F.col("vec_id")).alias("x"))
    assert sorted(noisy.collect()) == sorted(noisy.collect())
    assert noisy.subtract(rows.select("vec_id", "x")).count() == 20


def test_mask_off_keeps_rows(spark):
    rows = spectra(spark, SF_DIR).limit(5)
    kept = rows.select(augment.masked(F.col("x"), F.transform("x", lambda v: v + 1), F.lit(False)).alias("k"), "x")
    assert all(r["k"] == r["x"] for r in kept.collect())


def test_network_gives_probabilities(spark):
    net = scoring.seeded_network(64, 4)
    rows = scoring.score(spectra(spark, SF_DIR).limit(30), net, batch=7).collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-4 and len(r["probs"]) == 4 for r in rows)


def test_single_pair_has_no_deviation(spark):
    rows = spark.createDataFrame([(32, 0, 0, 1, 1), (32, 0, 1, 1, 0)], "n long, seed long, arm long, gt long, pred long")
    r = evaluate.paired_delta(rows).first()
    assert r["pairs"] == 1 and r["mean_delta"] == -1.0 and r["std_delta"] is None


def test_normalised_error_is_of_the_fitted_law(spark):
    """Trials of unequal size count alike, wide sizes weigh little, the floor is
    taken off, and the base is the smaller of the largest sizes."""
    law = lambda n: 6.4 * n**-0.5 + 0.1
    rows = []
    for arm, sizes in ((0, (64, 256, 1024, 4096)), (1, (64, 256, 1024, 4096, 16384))):
        for n in sizes:
            for seed, (total, off) in enumerate(((1000, 0.0), (3000, 0.0)) if n != 1024 else ((1000, -0.1), (3000, 0.1))):
                wrong = round(total * (law(n) + off))
                rows += [(n, seed, arm, 1, int(k >= wrong)) for k in range(total)]
    curve = evaluate.learning_curve(spark.createDataFrame(rows, "n long, seed long, arm long, gt long, pred long")).cache()
    assert {(r["arm"], r["n"]): round(r["error"], 6) for r in curve.collect()}[1, 1024] == 0.3
    for r in evaluate.scaling_law(curve).collect():
        assert abs(r["a"] - 6.4) < 0.05 and abs(r["alpha"] - 0.5) < 0.005 and abs(r["b"] - 0.1) < 0.005
    got = {(r["arm"], r["n"]): r["normalised_error"] for r in evaluate.normalised_law(curve).collect()}
    assert len(got) == 9 and got[0, 4096] == got[1, 4096] == 1.0
    assert abs(got[0, 64] - 8) < 0.2 and abs(got[1, 64] - 8) < 0.2 and abs(got[1, 16384] - 0.5) < 0.02


def test_store_round_trip(spark, tmp_path):
    data = np.arange(24.0).reshape(2, 3, 4)
    np.savez(tmp_path / "a.npz", other=np.zeros((1, 4)), data=data)
    got = stores.read_arrays(spark, str(tmp_path)).orderBy("px").collect()
    assert [r["x"] for r in got] == data.reshape(-1, 4).tolist()
    predictions.save_state(spark, {"reference": [1.0, 2.0]}, str(tmp_path / "state"))
    assert predictions.load_state(spark, str(tmp_path / "state")) == {"reference": [1.0, 2.0]}
    assert predictions.load_state(spark, str(tmp_path / "none")) == {}


def test_tracker_marks_failures(spark, tmp_path):
    with pytest.raises(RuntimeError), predictions.make_tracker("table", spark, str(tmp_path / "log"), "r1") as t:
        t.metric("accuracy", 0.5, 1)
        raise RuntimeError("stop")
    rows = {r["key"]: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert rows["status"]["text"] == "failed" and rows["accuracy"]["value"] == 0.5
    with pytest.raises(ValueError):
        predictions.make_tracker("elsewhere", spark, "", "")


def test_run_end_to_end(spark, tmp_path):
    config = override(Config(), {"data": {"per_class": 5, "preprocessing": [{"type": "snv"}, {"type": "emsc", "poly_order": 1}]}})
    acc = run(spark, spectra(spark, SF_DIR), AXIS, config, str(tmp_path))
    assert acc.count() > 0
    assert "top_k" in predictions.load(spark, str(tmp_path), top_k=True).columns


def test_config_refuses_unknown_keys():
    with pytest.raises(KeyError):
        override(Config(), {"data": {"colour": 1}})
    assert preset("milk").data.per_class == 512
    trials = draw_trials({"lr": ("log", 1e-5, 1e-2), "depth": [1, 2]}, 20, 1)
    assert trials == draw_trials({"lr": ("log", 1e-5, 1e-2), "depth": [1, 2]}, 20, 1)
    assert all(1e-5 <= t["lr"] <= 1e-2 and t["depth"] in (1, 2) for t in trials)


def test_stream_counts_predictions(spark, tmp_path):
    from prismspark.streaming.scoring import predictions_per_window, scored_stream, write_stream

    source = str(tmp_path / "in")
    rows = spectra(spark, SF_DIR).limit(30).select("image", "px", F.timestamp_seconds(F.lit(0) + F.col("vec_id") * 60).alias("ts"), "x")
    rows.write.parquet(source)
    stream = scored_stream(spark.readStream.schema(rows.schema).parquet(source), scoring.seeded_network(64, 3))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    assert predictions_per_window(stream).isStreaming


def test_order_keys_of_large_ids_and_of_seeds(spark, duck):
    ids = [0, 1, -1, 2**31, 4_000_000_000, 2**40 + 3, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(i,) for i in ids], "i long")
    got = [tuple(r) for r in frame.select(hashrand.order_key(F.col("i"), 7), hashrand.place_key(F.col("i"), 3, 7)).collect()]
    want = [duck.execute(f"select {hashrand.order_key_sql(f'({i})', 7)}, {hashrand.place_key_sql(f'({i})', '3', 7)}").fetchone() for i in ids]
    assert got == want and all(0 <= k < 2**32 for r in got for k in r)
    keys = np.array([tuple(r) for r in spark.range(4000).select(*[hashrand.order_key(F.col("id"), s) for s in range(4)], hashrand.gaussian(F.col("id"), 5, 1)).collect()], float)
    assert np.abs(np.corrcoef(keys.T) - np.eye(5)).max() < 0.06
    assert np.abs(np.corrcoef(keys[1:].T, keys[:-1].T)).min() < 0.06 and len(np.unique((keys[:, 0] - keys[:, 1]) % 2**32)) > 3900
    assert abs(keys[:, 4].mean()) < 0.06 and abs(keys[:, 4].std() - 1) < 0.05


def test_numbers_equal_plain_windows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGES", 16)
    rows = spark.range(700).select("id", F.when(F.col("id") % 50 > 0, "hot").when(F.col("id") % 100 == 0, "rare").alias("y"))
    got = {r["id"]: (r["__i"], r["__n"]) for r in sampling.numbered(rows, ["y"], "id", 3).collect()}
    w = Window.partitionBy("y").orderBy(hashrand.order_key(F.col("id"), 3), "id")
    want = {r["id"]: (r["i"], r["n"]) for r in rows.select("id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("y")).alias("n")).collect()}
    assert got == want
    assert sampling.label_split(rows.limit(0), "y", "id", 0.5).count() == 0


def test_series_equal_plain_windows(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SPAN", 7)
    log = spark.range(200).select((F.col("id") % 2).alias("s"), (F.col("id") * 3 + F.col("id") % 5 * 11).alias("t"), F.when(F.col("id") % 9 > 0, F.pmod(F.hash("id"), F.lit(50)).cast("double")).alias("v")).dropDuplicates(["s", "t"])
    rows = sorted((r["s"], r["t"], r["v"]) for r in log.collect())
    want, smooth = {}, {}
    for s in (0, 1):
        own = [r for r in rows if r[0] == s]
        best, at = None, 0
        for i, (_, t, v) in enumerate(own):
            if best is None or (v is not None and v > best):
                at = i
            best = v if best is None else max(best, v) if v is not None else best
            want[s, t] = (best, i - at)
            near = [x[2] for x in own[max(0, i - 2) : i + 3] if x[2] is not None]
            smooth[s, t] = round(sum(near) / len(near), 9)
    assert {(r["s"], r["t"]): (r["best"], r["wait"]) for r in evaluate.early_stop_wait(log, "s", "t", "v").collect()} == want
    assert {(r["s"], r["t"]): round(r["smooth"], 9) for r in evaluate.boxcar(log, "s", "t", "v", 2).collect()} == smooth


def test_batches_have_their_size_and_are_shuffled(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("y"))
    got = sampling.balanced_batches(rows, "y", "id", 4, 5, 1, extra=2).collect()
    for b in range(4):
        own = sorted((r["slot"], r["y"]) for r in got if r["batch"] == b)
        assert [s for s, _ in own] == list(range(17)) and [y for _, y in own] != sorted(y for _, y in own)
        assert all(sum(y == k for _, y in own) >= 5 for k in range(3))


def test_spikes_of_long_spectra_are_not_capped(spark):
    rows = spark.range(12).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(1.0), 4000).alias("x"))
    after = augment.cosmic_rays(rows, "vec_id", rate=0.05, widest=1, seed=1).collect()
    changed = [sum(v != 1.0 for v in r["x"]) for r in after]  # 200 are expected, some on one channel
    assert 170 < np.mean(changed) < 215 and np.std(changed) > 4


def test_broken_spectra_do_not_stop_others(spark):
    rows = spark.createDataFrame([(1, "a", [1.0] * 64), (2, "a", None), (3, "b", [1.0, 2.0]), (4, "b", [1.0] * 63 + [None]), (5, "c", [0.5] * 63 + [float("nan")]), (6, "d", [])], "vec_id long, image string, x array<double>")
    net = scoring.seeded_network(64, 3)
    got = scoring.score(rows, net, channels=64)
    assert {r["vec_id"]: r["probs"] is not None for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert {r["image"]: (r["pixels"], r["failed"]) for r in scoring.failed_images(got).collect()} == {"a": (2, 1), "b": (2, 2), "c": (1, 1), "d": (1, 1)}
    assert scoring.score(rows, net).filter("vec_id = 1 and probs is not null").count() == 1


def test_run_lists_failed_images_and_logs(spark, tmp_path):
    rows = spectra(spark, SF_DIR).withColumn("x", F.when(F.col("image") == 3, None).otherwise(F.col("x")))
    entries = [{"type": "noise", "max_level": 0.1, "ratio": 0.5}, {"type": "polynomial_baseline"}]
    config = override(Config(), {"data": {"per_class": 5, "split": "test", "augmentations": entries, "preprocessing": [{"type": "snv"}]}})
    with pytest.raises(ValueError, match="part"):
        run(spark, rows, AXIS, config, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="split"):
        run(spark, rows, AXIS, override(config, {"data": {"split": "moon"}}), str(tmp_path / "a"))
    parts = rows.withColumn("part", F.when((F.col("vec_id") % 2 == 0) | (F.col("image") == 3), "test").otherwise("train"))
    assert run(spark, parts, AXIS, config, str(tmp_path / "a")).count() > 0
    failed = spark.read.parquet(str(tmp_path / "a" / "failed")).collect()
    assert [r["image"] for r in failed] == [3] and failed[0]["failed"] == failed[0]["pixels"]
    log = {r["key"]: r for r in spark.read.parquet(str(tmp_path / "a" / "log")).collect()}
    assert log["infer_minutes"]["value"] > 0 and "augmentations" in log["data"]["text"]
    assert run(spark, parts, AXIS, config, str(tmp_path / "a"), mode="train").count() > 20
    trials = sweep(spark, parts, AXIS, {"good": config, "bad": override(config, {"data": {"split": "moon"}})}, str(tmp_path / "s"))
    assert {r["trial"]: (r["objective"] is not None, r["error"] is not None) for r in trials.collect()} == {"good": (True, False), "bad": (False, True)}


def test_perturbations_keep_to_their_rows(spark):
    rows = spectra(spark, SF_DIR).select("vec_id", "y", "image", "x")
    before = {r["vec_id"]: r for r in rows.collect()}
    background = F.col("y") == 0
    changed = {}
    for mask in ("signal_only", "background_only"):
        got = perturb.perturb(rows, "vec_id", AXIS, {"a": {"type": "wavenumber_shift", "ratio": 0.5, mask: True}}, 2, background=background).collect()
        changed[mask] = {r["vec_id"] for r in got if r["x"] != before[r["vec_id"]]["x"]}
        assert all((before[i]["y"] == 0) == (mask == "background_only") for i in changed[mask])
    assert 0.4 < len(changed["signal_only"]) / sum(r["y"] != 0 for r in before.values()) < 0.6
    bad = rows.limit(3).withColumn("x", F.transform("x", lambda v: v * 1e308))
    same = perturb.perturb(bad, "vec_id", AXIS, [{"type": "polynomial_baseline", "p1_min": 9, "p1_max": 9}], 1)
    assert all(np.isfinite(r["x"]).all() for r in same.collect())
    with pytest.raises(KeyError, match="Unknown perturbation"):
        perturb.resolve({"nothing": {"enabled": False}})
    with pytest.raises(RuntimeError):
        perturb.perturb(rows, "vec_id", AXIS, {"fluorescence": {}})
    every = [{"type": t, "max_level": 0.1, "params": [2330, 2370, 4, 0.05, 0.01, 20, 3, 2]} for t in perturb.PERTURBATIONS]
    some = rows.limit(8).select("vec_id", "y", F.transform("x", lambda v: v + 1).alias("x"))
    out = perturb.perturb(some, "vec_id", AXIS, every, 4, basis=perturb.fit(some, every)).collect()
    assert len(out) == 8 and all(np.isfinite(r["x"]).all() and len(r["x"]) == 64 for r in out)
    assert perturb.raman_pipeline(some, "vec_id", AXIS, None, 0.0).collect() == some.collect()


@pytest.mark.parametrize("axis", [AXIS, AXIS[::-1]])
def test_row_shifts_equal_interpolation(spark, axis):
    rows = spectra(spark, SF_DIR).limit(20).select("vec_id", "x")
    before = {r["vec_id"]: np.array(r["x"]) for r in rows.collect()}
    after = augment.wavenumber_shift_rows(rows, axis, F.col("vec_id") % 7 * 13.5 - 40).collect()
    order = np.argsort(axis)
    for r in after:
        points, want = np.array(axis)[order], np.empty(64)
        want[order] = np.interp(points, points + r["vec_id"] % 7 * 13.5 - 40, before[r["vec_id"]][order])
        assert np.abs(np.array(r["x"]) - want).max() < 1e-12


def test_background_basis_covers_all_spectra(spark):
    from prismspark.functions.kernels import fluorescence_basis

    rows = spectra(spark, SF_DIR)
    got, want = augment.fit_background(rows, 4), fluorescence_basis(np.array([r["x"] for r in rows.collect()], float), 4)
    assert np.allclose(got["mean"], want["mean"]) and np.allclose(got["scale"], want["scale"])
    assert np.allclose(np.abs((got["basis"] * want["basis"]).sum(axis=1)), 1, atol=1e-6)


def test_weights_are_read_and_classes_counted(spark, tmp_path):
    np.savez(tmp_path / "net.npz", a=np.ones((2, 3)), b=np.zeros(2))
    got = scoring.read_network(spark, str(tmp_path / "net.npz"))
    assert got["a"].shape == (2, 3) and set(got) == {"a", "b"}
    with pytest.raises(ValueError, match="10 classes"):
        sampling.check_class_count(spectra(spark, SF_DIR), "y", 7)


def test_settings_come_from_files_in_order(tmp_path):
    (tmp_path / "a.json").write_text('{"domain": "milk", "seed": 4}')
    (tmp_path / "b.json").write_text('{"seed": 5, "data": {"train_ratio": 0.5}}')
    c = load(str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert (c.seed, c.data.per_class, c.data.train_ratio) == (5, 512, 0.5)


def test_trials_are_filtered_by_what_is_asked(spark):
    rows = spark.createDataFrame([(32, 0, "seed00", 0, 1.0, 1), (32, 0, "seed00", 0, 0.5, 2), (32, 0, "seed00", 1, 0.75, 3), (64, 1, "seed01", 1, 0.5, 4)], "n long, seed long, token string, arm long, a double, run long")
    assert evaluate.filter_trials(rows, n=[32], seed=None).count() == 3
    with pytest.raises(KeyError):
        evaluate.filter_trials(rows, colour=[1])
    assert [tuple(r) for r in evaluate.paired_by_token(rows, "n", "token", "arm", "a", "run").collect()] == [(32, 1, 0.25)]


def test_samples_name_unknown_and_missing_classes(spark):
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 5).alias("core"))
    with pytest.raises(ValueError, match="Unknown classes"):
        sampling.sample_classes(rows, "y", "core", "id", [0, 1, 2], [9])
    with pytest.warns(UserWarning, match="2"):
        got = sampling.sample_classes(rows, "y", "core", "id", [0, 1, 2], [2, 1]).collect()
    assert sorted(r["place"] for r in got) == list(range(30)) and {r["new_y"] for r in got} == {1} and [r["id"] for r in sorted(got, key=lambda r: r["place"])] != sorted(r["id"] for r in got)


def test_network_steps_are_loaded_and_checked(spark):
    rows = spectra(spark, SF_DIR).limit(30)
    step = {"type": "network", "load": lambda: lambda x: x * 3, "batch": 7, "planes": True, "expect_channels": 64}
    got = {r["vec_id"]: r["x"] for r in preprocess.apply(rows, AXIS, [step])[0].collect()}
    assert all(np.allclose(got[r["vec_id"]], np.array(r["x"]) * 3, atol=1e-6) for r in rows.collect())
    with pytest.raises(ValueError, match="channels"):
        preprocess.apply(rows, AXIS, [step | {"expect_channels": 9}])
    with pytest.raises(NotImplementedError):
        preprocess.apply(rows, AXIS, [{"type": "network"}])


def test_stores_tell_what_they_lack(spark, tmp_path):
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "image string")
    assert {tuple(r) for r in stores.resolve(names("a", "b"), names("a"), names("a", "b")).collect()} == {("a", "nested"), ("b", "top")}
    with pytest.raises(KeyError, match="c"):
        stores.resolve(names("c"), names("a"), names("b"))
    assert stores.read_axis(spark, str(tmp_path / "none")) is None
    spark.createDataFrame([([1.0, 2.0],)], "wn array<double>").write.parquet(str(tmp_path / "axis"))
    assert stores.read_axis(spark, str(tmp_path / "axis")) == [1.0, 2.0]
    with predictions.make_tracker("none", spark, str(tmp_path / "log"), "r") as t:
        t.metric("a", 1.0)
    assert not (tmp_path / "log").exists()


def test_windows_wider_than_ranges(spark):
    log = spark.range(20_000).select(F.lit(1).alias("s"), F.col("id").alias("t"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    got = {r["t"]: r["smooth"] for r in evaluate.boxcar(log, "s", "t", "v", 9_000).filter("t in (0, 10000, 19999)").collect()}
    squares = np.arange(20_000.0) ** 2
    assert got == {t: pytest.approx(squares[max(0, t - 9_000) : t + 9_001].mean()) for t in (0, 10_000, 19_999)}


def test_sparse_and_equal_steps(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SPAN", 50)
    log = spark.range(600).select((F.col("id") % 2).alias("i"), (F.floor(F.col("id") / 4) * 10_000).alias("t"), F.col("id").cast("double").alias("v"), F.lit(7).alias("c"))
    rows = evaluate.in_order(log, "i", "t", "place", "part").collect()
    for s in (0, 1):
        own = sorted((r["t"], r["v"], r["place"]) for r in rows if r["i"] == s)
        assert [p for *_, p in own] == list(range(1, 301))
    assert 5 < len({r["part"] for r in rows}) <= 12 and {r["c"] for r in rows} == {7}


def test_means_of_odd_spectra(spark):
    schema = "vec_id long, y long, x array<double>"
    ragged = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (2, 1, [1.0] * 5), (3, 0, [1.0] * 5)], schema).coalesce(1)
    with pytest.raises(Exception, match="common mean"):
        evaluate.class_means(ragged).collect()
    with pytest.raises(ValueError, match="channels"):
        evaluate.nearest_centroid(ragged.filter("vec_id < 3"))
    odd = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 1, [9.0, 9.0]), (3, 1, [float("nan"), 1.0]), (4, 1, [None, 2.0]), (5, 0, None), (6, 0, [1.0]), (7, None, [8.0, 9.0])], schema)
    wide = odd.filter("vec_id != 6")
    assert {(r["cls"], r["ch"]): r["m"] for r in evaluate.class_means(wide).collect()} == {(0, 0): 0.0, (0, 1): 0.0, (1, 0): 9.0, (1, 1): 9.0}
    assert {r["vec_id"]: r["pred"] for r in evaluate.nearest_centroid(wide).collect()} == {1: 0, 2: 1, 3: None, 4: None, 7: 1}


def test_names_as_ids(spark):
    rows = spark.range(400).select(F.concat(F.lit("img"), "id").alias("image"), F.concat(F.lit("p"), F.col("id") % 9).alias("patient"), (F.col("id") % 3).alias("y"), F.lit("kept").alias("h"), F.lit("too").alias("i"))
    got = sampling.label_split(rows, "y", "image", 0.75, 3)
    assert got.columns == [*rows.columns, "part"] and {(r["h"], r["i"]) for r in got.collect()} == {("kept", "too")}
    assert got.filter("part = 'train'").count() == 300 and sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.label_split(rows.repartition(7), "y", "image", 0.75, 3).collect()))
    assert sampling.patient_split(rows, "patient", 0.25, 3).filter("part = 'test'").select("patient").distinct().count() == 2
    filled = sampling.water_fill(rows, "y", "patient", "image", 10, 3)
    assert filled.columns == rows.columns and filled.groupBy("y").count().filter("count = 10").count() == 3


def test_draws_of_twin_ids(spark):
    prime = 3_037_000_493
    twins = spark.range(40).select("id", (F.col("id") + prime).alias("other"), (F.col("id") + prime * 2**31).alias("far"))
    for other in ("other", "far"):
        same = [twins.filter(hashrand.order_key(F.col("id"), s) == hashrand.order_key(F.col(other), s)).count() for s in range(3)]
        assert same == [0, 0, 0]


def test_perturbations_leave_other_columns(spark):
    rows = spectra(spark, SF_DIR).limit(5).select("vec_id", "x", F.lit(3).alias("old"), F.lit(4).alias("__old"))
    out = perturb.perturb(rows, "vec_id", AXIS, [{"type": "wavenumber_shift"}], 1)
    assert out.columns == rows.columns and {(r["old"], r["__old"]) for r in out.collect()} == {(3, 4)}
    named = rows.withColumn("vec_id", F.concat(F.lit("s"), "vec_id"))
    assert perturb.perturb(named, "vec_id", AXIS, [{"type": "noise", "max_level": 0.1}], 1).columns == rows.columns


def test_missing_attributes_are_false(spark):
    trials = spark.createDataFrame([(1, True, "a"), (2, False, None), (3, None, "b")], "n int, augment boolean, token string")
    pick = lambda **w: sorted(r["n"] for r in evaluate.filter_trials(trials, **w).collect())
    assert pick(augment=[False]) == [2, 3] and pick(augment=[True]) == [1] and pick(n=[1, 3]) == [1, 3]
    assert pick(other=[False]) == [1, 2, 3] and pick(other=[True]) == [] and pick(token=["a", "b"]) == [1, 3]


def test_tokens_fall_back_to_the_whole_id(spark):
    rows = spark.createDataFrame([(8, "", "r1", 0, 0.5, 1), (8, "", "r1", 1, 0.75, 1), (8, None, "r2", 0, 0.1, 1), (8, "", "r3", 1, 0.9, 1)], "n int, token string, run string, arm int, v double, o int")
    assert [tuple(r) for r in evaluate.paired_by_token(rows, "n", "token", "arm", "v", "o", "run").collect()] == [(8, 1, 0.25)]


def test_presets_hold_what_is_published():
    milk, pcuk, mlrod = preset("milk").data, preset("pcuk").data, preset("mlrod").data
    assert milk.augmentations["polynomial_baseline_signal"]["p0_max"] == 0.5 and milk.augmentations["noise"]["max_level"] == 0.001 and not milk.z_normalize
    assert list(pcuk.augmentations) == ["polynomial_baseline_signal", "noise", "co2_peaks", "paraffin", "wavenumber_shift"] and not pcuk.augment_train
    assert mlrod.augmentations["fluorescence"]["fit_pool_size"] == 2000 and preset("microplastic").data.augmentations["mie_scattering"]["theta_max"] == 0.45
    for name in ("microplastic", "textile", "pollen", "milk", "pcuk", "mlrod", "bacteria"):
        perturb.resolve(preset(name).data.augmentations)


def test_fit_pool_does_not_change_with_the_sample(spark):
    rows = spectra(spark, SF_DIR).select("vec_id", "y", "image", F.transform("x", lambda v: v + 1).alias("x"))
    entries = {"fluorescence": {"fit_pool_size": 40, "fit_pool_seed": 5, "n_components": 2}}
    a, b = (perturb.fit(rows.filter(f"vec_id % {k} = 0"), entries, rows, core="image") for k in (7, 3))
    c = perturb.fit(rows.filter("vec_id % 7 = 0"), {"fluorescence": {"n_components": 2}}, rows)
    assert a is not None and np.array_equal(a["0"]["mean"], b["0"]["mean"]) and not np.array_equal(a["0"]["mean"], c["0"]["mean"])


def test_dimension_equals_the_exact_one(spark, monkeypatch):
    from prismspark.operators import complexity

    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 90)) * 0.6 ** np.arange(90) @ np.linalg.qr(rng.standard_normal((90, 90)))[0] + 5
    data = [(0, 0, None), (1, 0, [float("nan")] * 90), (2, 0, [1.0, 2.0]), *[(i + 3, 0, v) for i, v in enumerate(x.tolist())]]
    rows = spark.createDataFrame(data, "vec_id long, y long, x array<double>").repartition(3)
    exact = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    for share, narrow in ((0.5, 0), (0.95, 0), (0.95, 128), (0.99999, 0)):
        monkeypatch.setattr(complexity, "NARROW", narrow)
        want = int(np.searchsorted(np.cumsum(exact) / exact.sum(), share)) + 1
        assert complexity.intrinsic_dimension(rows, share).first()["dimension"] == want
    first = complexity.leading_variances(rows, 8)
    assert np.allclose(first[0][:8], exact[:8], rtol=1e-6) and first[1] == pytest.approx(exact.sum())
    assert complexity.intrinsic_dimension(rows.limit(1)).first()["dimension"] == complexity.intrinsic_dimension(rows.limit(0)).first()["dimension"] == 0
    found = complexity.covariance(rows).collect()
    assert len(found) == 90 * 90 and np.allclose([r["c"] for r in found], [np.cov(x.T)[r["i"], r["j"]] for r in found])


@pytest.mark.parametrize("name", ["dominant_class", "core_split"])
def test_pixels_are_joined_in_tasks_of_bounded_rows(spark, same, monkeypatch, name):
    from conftest import SF_DIR
    from prismspark.jobs import relational
    from prismspark.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 300, raising=False)
    parts = tables.pixels(spark, SF_DIR).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 15 and max(r["count"] for r in parts) < 900
    same(relational.QUERIES[name], relational.ORACLE_SQL[name])
