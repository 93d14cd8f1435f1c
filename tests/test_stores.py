"""Array store, study file and search, against plain counterparts."""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismspark.config import Config, draw_trials
from prismspark.operators import search
from prismspark.sources import array_store, study


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = spark.range(95).select(F.when(F.col("id") < 70, "leaf").otherwise("bark").alias("image"), F.when(F.col("id") < 70, F.col("id")).otherwise(F.col("id") - 70).alias("px"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.col("id") + c / 10).alias("x"))
    path = str(tmp_path_factory.mktemp("store"))
    array_store.write_store(rows.repartition(3), path, {"wavenumbers": [1, 2, 3, 4, 5]}, chunk=16)
    return path, {(r["image"], r["px"]): r["x"] for r in rows.collect()}


def plain(frame):
    return {(r["image"], r["px"]): r["x"] for r in frame.collect()}


def test_what_is_written_is_read(spark, store):
    path, want = store
    assert plain(array_store.read_store(spark, path)) == want
    assert array_store.attributes(path)["wavenumbers"] == [1, 2, 3, 4, 5]


def test_chunks_out_of_range_are_not_opened(spark, store, tmp_path, monkeypatch):
    import shutil

    path, want = store
    own = str(tmp_path / "s")
    shutil.copytree(path, own)
    for name in ("leaf/X/0.0", "leaf/X/3.0", "leaf/X/4.0", "bark/X/0.0", "bark/X/1.0"):
        with open(f"{own}/images/{name}", "wb") as f:
            f.write(b"broken")
    got = array_store.read_store(spark, own).filter("image = 'leaf' and px >= 20 and px < 40")
    assert plain(got) == {k: v for k, v in want.items() if k[0] == "leaf" and 20 <= k[1] < 40}
    monkeypatch.setattr(array_store, "PARTITION_BYTES", 1)
    counts = {f: array_store.read_store(spark, path).filter(f).rdd.getNumPartitions() for f in ("px >= 0", "px < 16", "px = 40", "px > 63 and image in ('leaf', 'none')", "px > 999", "image = 'bark' and px <= 15")}
    assert list(counts.values()) == [7, 2, 1, 1, 1, 1]
    assert array_store.read_store(spark, path).filter("px > 999").count() == 0
    assert array_store.read_store(spark, path).filter("x[0] > 90 and px > 3").count() == 4
    with pytest.raises(Exception, match="(?i)zlib|decompress|header"):
        array_store.read_store(spark, own).count()


def test_cubes_in_several_chunks(spark, tmp_path):
    """Rows, columns and channels cut unevenly, both layouts, a missing chunk."""
    cube = np.arange(5 * 7 * 6, dtype="<f4").reshape(5, 7, 6)
    folder = tmp_path / "images" / "one" / "data"
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"shape": [5, 7, 6], "chunks": [2, 3, 4], "dtype": "<f4", "order": "C", "fill_value": -1, "filters": None, "compressor": {"id": "zlib"}, "zarr_format": 2}))
    want = cube.astype(float).copy()
    for i, j, k in np.ndindex(3, 3, 2):
        part = np.full((2, 3, 4), 99, "<f4")
        own = cube[2 * i : 2 * i + 2, 3 * j : 3 * j + 3, 4 * k : 4 * k + 4]
        part[: own.shape[0], : own.shape[1], : own.shape[2]] = own
        if (i, j, k) == (1, 1, 0):
            want[2:4, 3:6, :4] = -1
        else:
            (folder / f"{i}.{j}.{k}").write_bytes(zlib.compress(part.tobytes()))
    for image in ("one", "top"):
        flat = tmp_path / image / "X"
        flat.mkdir(parents=True)
        (flat / ".zarray").write_text(json.dumps({"shape": [2, 6], "chunks": [2, 6], "dtype": "<f8", "fill_value": 7, "compressor": None}))
    got = plain(array_store.read_store(spark, str(tmp_path)))
    assert {k: v for k, v in got.items() if k[0] == "one"} == {("one", p): want.reshape(-1, 6)[p].tolist() for p in range(35)}
    assert {k: v for k, v in got.items() if k[0] == "top"} == {("top", p): [7.0] * 6 for p in range(2)}
    some = plain(array_store.read_store(spark, str(tmp_path)).filter("px between 9 and 11 and image = 'one'"))
    assert sorted(p for _, p in some) == [9, 10, 11]


def test_stores_refuse_gaps(spark, tmp_path):
    with pytest.raises(ValueError, match="gaps"):
        array_store.write_store(spark.createDataFrame([("a", 0, [1.0]), ("a", 2, [1.0])], "image string, px long, x array<double>"), str(tmp_path))


def test_study_file_and_its_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(study, "TRIALS", 7)
    trials = spark.range(40).select(F.col("id"), (F.col("id") / 10).alias("lr"), F.when(F.col("id") % 3 > 0, F.col("id") * 2).alias("depth"), F.when(F.col("id") % 5 > 0, -F.col("id") / 3).alias("score"), F.lit(1.0).alias("time"), F.when(F.col("id") % 5 > 0, "COMPLETE").otherwise("FAIL").alias("state"))
    path = str(tmp_path / "s.db")
    study.write_study(trials.orderBy("id"), path, ["lr", "depth"], ["score", "time"])
    back = study.read_study(spark, path)
    assert back.columns == ["trial_id", "number", "state", "params_depth", "params_lr", "value", "value_1"]
    want = sorted((r["id"] + 1, r["id"], r["state"], r["depth"], r["lr"], r["score"], r["time"]) for r in trials.collect())
    assert sorted(tuple(r) for r in back.collect()) == want
    assert spark.read.format("study").load(path).rdd.getNumPartitions() == 6
    study.write_study(trials.limit(0), str(tmp_path / "none.db"), ["lr"], ["score"])
    assert study.read_study(spark, str(tmp_path / "none.db")).count() == 0


SPACE = {"lr": ("log", 1e-5, 1.0), "width": (0.0, 10.0), "kind": ["a", "b", "c"]}


def value(row):
    return -(math.log10(row["lr"]) + 3) ** 2 - (row["width"] - 7) ** 2 / 4 - (row["kind"] != "b")


def test_search_beats_plain_draws(spark):
    schema = "lr double, width double, kind string, o double"
    finals = []
    for seed in (1, 2, 3):
        rows = [{**r, "o": value(r)} for r in draw_trials(SPACE, 12, seed)]
        while len(rows) < 44:
            table = spark.createDataFrame([(r["lr"], r["width"], r["kind"], r["o"]) for r in rows] + [(None, 1.0, "a", 9.0), (1e-3, 7.0, "b", None), (50.0, 7.0, "b", 99.0)], schema)
            some = search.suggest(table, SPACE, "o", 8, seed)
            assert some == search.suggest(table.repartition(3), SPACE, "o", 8, seed)
            assert all(1e-5 <= r["lr"] <= 1 and 0 <= r["width"] <= 10 and r["kind"] in "abc" for r in some)
            rows += [{**r, "o": value(r)} for r in some]
        plain_ = max(value(r) for r in draw_trials(SPACE, 44, 100 + seed))
        finals.append((max(r["o"] for r in rows), plain_, np.mean([r["o"] for r in rows[-16:]]), np.mean([value(r) for r in draw_trials(SPACE, 200, seed)])))
    assert sum(t > p for t, p, *_ in finals) >= 2 and all(late > plain_ + 1 for *_, late, plain_ in finals)
    with pytest.raises(KeyError, match="lr"):
        search.suggest(spark.createDataFrame([(1.0,)], "o double"), SPACE, "o", 1)


def test_search_goes_on_from_its_table(spark, tmp_path):
    space = {"model.lr": ("log", 1e-3, 1.0), "model.hidden": [0, 4]}

    def evaluated(configs):
        rows = [(k, None if c.model.hidden and c.model.lr > 0.5 else -abs(math.log10(c.model.lr) + 2), "bad" if c.model.hidden and c.model.lr > 0.5 else None) for k, c in configs.items()]
        return spark.createDataFrame(rows, "trial string, objective double, error string")

    go = lambda path, n: {r["trial"]: tuple(r) for r in search.search(spark, evaluated, Config(), space, n, str(tmp_path / path), 4).collect()}
    whole = go("a", 20)
    go("b", 8)
    assert go("b", 20) == whole and len(whole) == 20
