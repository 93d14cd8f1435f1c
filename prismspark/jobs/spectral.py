"""Queries over spectra: preprocessing, perturbations, complexity, kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismspark.functions import native, profiles
from prismspark.functions.hashrand import gaussian_sql, order_key_sql, place_key_sql, share_sql
from prismspark.operators import augment, complexity, evaluate, perturb, preprocess, scoring
from prismspark.sources.tables import AXIS, CHANNELS, long_form, spectra, trials

WINDOWS = [(800.0, 1800.0), (2800.0, 3000.0)]
GRID = np.linspace(500, 3900, 40).tolist()
SHIFT = 2.5
CO2 = ((2340.0, 0.05, 20.0), (2360.0, 0.03, 15.0))


def values_of(frame: DataFrame) -> DataFrame:
    """(vec_id, ch, value) rounded to what two engines agree on."""
    return long_form(frame, "x", "vec_id").select("vec_id", "ch", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def _native(change):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spectra(spark, sf_dir)
        return values_of(rows.withColumn("x", change(F.col("x"))))

    return run


def _amount(scale: float):
    """A repeatable amount a row, of ids alone."""
    return F.lit(scale) * (F.col("vec_id") % 7 + 1)


# DuckDB: the base table, lists of doubles and helpers as text.
_E = "e as (select vec_id, cast(label as bigint) as y, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings)"


def _list(values) -> str:
    return "[" + ", ".join(f"cast({float(v)!r} as double)" for v in values) + "]"


def _sql(expression: str, more: str = "") -> str:
    """SQL of (vec_id, ch, value) for a list expression over x."""
    return f"""with {_E}{more}, z as (select vec_id, {expression} as z from e)
    select vec_id, unnest(range(0, len(z))) as ch, round(unnest(z), 6) + cast(0 as double) as value from z"""


_PEAK = "list_max(list_transform(x, lambda v: abs(v)))"
_MEAN, _STD = "list_avg(x)", "list_stddev_pop(x)"


def _amount_sql(scale: float) -> str:
    return f"(cast({scale!r} as double) * (vec_id % 7 + 1))"


def _plus(profile, factor: str) -> str:
    """x + factor * profile, channel by channel."""
    return f"list_transform(x, lambda v, i: v + {factor} * ({_list(profile)})[i])"


_axis = np.asarray(AXIS)
_T = profiles.polynomial_axis(_axis)
_KEEP = native.window_channels(AXIS, WINDOWS)
_GLOBULE = profiles.fat_globule(_axis)
_TEMP = sum(profiles.band_shift(_axis, c, w, 0.3) for c, w in ((1640, 40), (3340, 120)))
_PEAKS, _MOVED = profiles.preservative(_axis, "bronopol", 1.0)
_WATER = profiles.bands(_axis, profiles.WATER_BANDS)
_WATER = _WATER / (np.abs(_WATER).max() + 1e-9)
_PARAFFIN = profiles.bands(_axis, profiles.PARAFFIN_BANDS)


def _lerp_sql(targets, clamp: bool = False) -> str:
    b = native.brackets(AXIS, targets, clamp)
    left, right, weight = [x[0] + 1 for x in b], [x[1] + 1 for x in b], [x[2] for x in b]
    return f"list_transform({_list(weight)}, lambda w, i: x[({left})[i]] * (1 - w) + x[({right})[i]] * w)"


def mean_spectrum_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.mean_spectrum(spectra(spark, sf_dir), "y").select("y", "ch", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def nearest_centroid_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: standardise, class means, nearest class, accuracy per class."""
    rows = spectra(spark, sf_dir)
    rows = rows.withColumn("x", native.standardized(F.col("x")))
    scored = evaluate.nearest_centroid(rows)
    return evaluate.accuracy(scored, "gt").select(F.col("gt").alias("label"), "n", F.round("accuracy", 6).alias("accuracy"))


def savgol_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed channels that have a full window: a sliding product in each row."""
    from prismspark.functions.kernels import savgol_matrix

    half = 5
    weights = savgol_matrix(CHANNELS, 11, 3)[CHANNELS // 2, CHANNELS // 2 - half : CHANNELS // 2 + half + 1]
    at = lambda i: F.struct(i.cast("long").alias("ch"), sum(F.lit(float(w)) * F.get("x", i + (k - half)) for k, w in enumerate(weights)).alias("s"))
    found = spectra(spark, sf_dir).select("vec_id", F.explode(F.transform(F.sequence(F.lit(half), F.size("x") - 1 - half), at)).alias("c"))
    return found.select("vec_id", "c.ch", (F.round("c.s", 6) + F.lit(0.0)).alias("value"))


def _savgol_sql() -> str:
    from prismspark.functions.kernels import savgol_matrix

    w = savgol_matrix(CHANNELS, 11, 3)[32, 27:38]
    terms = " + ".join(f"cast({float(v)!r} as double) * x[ch + {k - 4}]" for k, v in enumerate(w))
    return f"with {_E}, c as (select vec_id, x, unnest(range(5, {CHANNELS - 5})) as ch from e) select vec_id, ch, round({terms}, 6) + cast(0 as double) as value from c"


def msc_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and intercept of every spectrum on the mean spectrum."""
    rows = spectra(spark, sf_dir)
    means = complexity.mean_spectrum(rows).withColumnRenamed("value", "m")  # a row a channel
    long = long_form(rows, "x", "vec_id").join(F.broadcast(means), "ch")
    return long.groupBy("vec_id").agg(F.round(F.regr_slope("value", "m"), 6).alias("slope"), (F.round(F.regr_intercept("value", "m"), 6) + F.lit(0.0)).alias("intercept"))


def _one(measure, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return measure(spectra(spark, sf_dir)).select(F.round(name, 6).alias(name))

    return run


def complexity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.report(spectra(spark, sf_dir)).select("measure", F.round("value", 6).alias("value"))


def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir)
    return values_of(rows.withColumn("x", native.differences(F.col("x"))))


def softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best channels of each spectrum's softmax, as if they were classes."""
    best = spectra(spark, sf_dir).select("vec_id", F.posexplode(native.top_k(native.softmax(F.col("x")), 3)).alias("rank", "s"))
    return best.select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("s.cls").cast("long").alias("cls"), F.round("s.prob", 6).alias("prob"))


def argmax_bgprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class, and the probability of class 0 as background."""
    p = spectra(spark, sf_dir).select("vec_id", native.softmax(F.slice("x", 1, 10)).alias("p"))
    return p.select("vec_id", native.argmax(F.col("p")).cast("long").alias("pred"), F.round(F.get("p", F.lit(0)), 6).alias("bg_prob"))


def _loss(gamma: float, alpha: float, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spectra(spark, sf_dir).select("y", native.softmax(F.slice("x", 1, 10)).alias("p"))
        p = F.get("p", F.col("y").cast("int"))
        return rows.agg(F.round(F.avg(alpha * F.pow(1 - p, F.lit(gamma)) * -F.log(p)), 6).alias(name))

    return run


_SOFT = "list_transform(x[1:10], lambda v: exp(v - list_max(x[1:10])))"


def _loss_sql(gamma: float, alpha: float, name: str) -> str:
    return f"""with {_E}, s as (select y, {_SOFT} as s from e), p as (select s[y + 1] / list_sum(s) as p from s)
    select round(avg(cast({alpha!r} as double) * pow(1 - p, cast({gamma!r} as double)) * -ln(p)), 6) as {name} from p"""


def _chain(steps: list[dict]):
    """A fitted chain of steps over all spectra: (vec_id, ch, value)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spectra(spark, sf_dir)
        state = preprocess.fit(rows, AXIS, steps)
        return values_of(preprocess.apply(rows, AXIS, steps, state)[0])

    return run


def _perturbed(change):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values_of(change(spectra(spark, sf_dir)))

    return run


def fluorescence_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each background component."""
    basis = augment.fit_background(spectra(spark, sf_dir))
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(basis["scale"])], "component long, scale double")


def _fluorescence(rows: DataFrame) -> DataFrame:
    return augment.fluorescence(rows, "vec_id", augment.fit_background(rows))


def scaling_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power law of the error over the number of training rows, per arm."""
    return evaluate.scaling_law(evaluate.learning_curve(trials(spark, sf_dir)))


def scaling_law_normalised_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fitted law of each arm leaves above its floor at each size, over
    what it leaves at the largest size that all arms reach."""
    return evaluate.normalised_law(evaluate.learning_curve(trials(spark, sf_dir)))


def pca_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.intrinsic_dimension(spectra(spark, sf_dir))


def score_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class and its probability by the attention network with seeded weights."""
    rows = spectra(spark, sf_dir)
    scored = scoring.score(rows, scoring.seeded_network(CHANNELS, 10))
    return scored.select("vec_id", native.argmax(F.col("probs")).cast("long").alias("pred"), F.round(F.array_max("probs"), 5).alias("prob"))


DENSE = tuple(np.round(np.random.default_rng(8).standard_normal(shape), 3) for shape in ((16, CHANNELS), (10, 16)))


def score_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class and its probability by a small dense network."""

    def network(x: np.ndarray, w: dict) -> np.ndarray:
        h = x @ w["a"].T
        z = np.where(h > 0, h, 0.01 * h) @ w["b"].T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    scored = scoring.score(spectra(spark, sf_dir), {"a": DENSE[0], "b": DENSE[1]}, network, channels=CHANNELS)
    return scored.select("vec_id", native.argmax(F.col("probs")).cast("long").alias("pred"), F.round(F.array_max("probs").cast("double"), 5).alias("prob"))


def _dense_sql() -> str:
    return f"""with {_E}, h as (select vec_id, list_transform({_matrix_sql(DENSE[0])}, lambda v: case when v > 0 then v else cast(0.01 as double) * v end) as x from e),
      z as (select vec_id, {_matrix_sql(DENSE[1])} as z from h), s as (select vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) as s from z)
    select vec_id, cast(list_position(z, list_max(z)) - 1 as bigint) as pred, round(cast(cast(list_max(s) / list_sum(s) as float) as double), 5) as prob from s"""


def train_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on held-out spectra of a logistic classifier."""
    return scoring.train_and_evaluate(spectra(spark, sf_dir))


CHAIN = {
    "baseline": {"type": "polynomial_baseline", "ratio": 0.5, "p0_min": -0.05, "p0_max": 0.05, "p1_min": 0.9, "p1_max": 1.1, "p2_min": -0.02, "p2_max": 0.02},
    "paraffin": {"ratio": 0.6, "amplitude_max": 0.05, "signal_only": True},
    "off": {"type": "noise", "max_level": 9.0, "enabled": False},
    "noise": {"ratio": 0.7, "max_level": 0.02},
}
CHAIN_SEED, STRENGTH = 3, 0.5
CO2_DRAWN = {"loc1": 2330.0, "loc2": 2370.0, "d_loc": 4.0, "height": 0.05, "d_height": 0.01, "width": 20.0, "d_width": 3.0, "n_peaks": 2}


def _single(name: str, seed: int, **cfg):
    return _perturbed(lambda r: perturb.perturb(r, "vec_id", AXIS, {name: cfg}, seed))


def augment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of perturbations with ratios, masks and strength; label 0 is background."""
    return values_of(perturb.perturb(spectra(spark, sf_dir), "vec_id", AXIS, CHAIN, CHAIN_SEED, STRENGTH, F.col("y") == 0))


def _between_sql(low: float, high: float, seed: int, place: int = 0) -> str:
    return f"(cast({low!r} as double) + cast({high - low!r} as double) * {share_sql(place_key_sql('vec_id', str(place), seed))})"


def _noise_sql(x: str, level: str, seed: int) -> str:
    return f"list_transform({x}, lambda v, i: v + {level} * {gaussian_sql('vec_id', '(i - 1)', seed)})"


def _paraffin_sql(x: str, high: float, seed: int) -> str:
    terms = " + ".join(f"cast({float(a)!r} as double) * {float(w * w)!r} / ({float(w * w)!r} + 4 * pow(wn - (cast({float(c)!r} as double) + j[{k + 1}]), 2))" for k, (c, w, a) in enumerate(profiles.PARAFFIN_BANDS))
    moves = ", ".join(_between_sql(-3.0, 3.0, seed, 1 + k) for k in range(len(profiles.PARAFFIN_BANDS)))
    shape = f"list_transform([[{moves}]], lambda j: list_transform({_list(AXIS)}, lambda wn: {terms}))[1]"
    return f"list_transform([{shape}], lambda p: list_transform({x}, lambda v, i: v + {_between_sql(0.0, high, seed)} * p[i] / (list_max(p) + cast(0.000000001 as double))))[1]"


def _masked_sql(ratio: float, seed: int, changed: str, allowed: str = "true") -> str:
    return f"case when {order_key_sql('vec_id', seed)} < {int(ratio * 4_294_967_296)} and {allowed} then {changed} else x end"


def _chain_sql() -> str:
    (m0, d0), (m1, d1), (m2, d2) = (perturb.seeds(CHAIN_SEED, k) for k in range(3))
    p = [_between_sql(lo, hi - lo + lo, d0, k) for k, (lo, hi) in enumerate(((-0.05, 0.05), (0.9, 1.1), (-0.02, 0.02)))]
    t = f"({_list(_T)})[i]"
    baseline = f"list_transform(x, lambda v, i: {p[1]} * v + {p[0]} + {p[2]} * {t})"
    steps = f""", a as (select vec_id, y, {_masked_sql(0.5, m0, baseline)} as x from e),
      b as (select vec_id, y, {_masked_sql(0.6, m1, _paraffin_sql("x", 0.05 * STRENGTH, d1), "y != 0")} as x from a),
      c as (select vec_id, {_masked_sql(0.7, m2, _noise_sql("x", _between_sql(0.0, 0.02 * STRENGTH, d2), d2 + 1))} as z from b)"""
    return f"with {_E}{steps} select vec_id, unnest(range(0, len(z))) as ch, round(unnest(z), 6) + cast(0 as double) as value from c"


def _shift_rows_sql(top: float, seed: int) -> str:
    """The axis is even, so a shift is a number of channels."""
    step = (AXIS[-1] - AXIS[0]) / (CHANNELS - 1)
    place = f"greatest(cast(0 as double), least(cast({CHANNELS - 1} as double), (i - 1) - {_between_sql(-top, top, perturb.seeds(seed, 0)[1])} / cast({step!r} as double)))"
    read = f"list_transform([least(cast(floor({place}) as bigint), {CHANNELS - 2})], lambda k: x[k + 1] * (1 - ({place} - k)) + x[k + 2] * ({place} - k))[1]"
    return _sql(f"list_transform(x, lambda v, i: {read})")


def _homogenizer_sql(seed: int) -> str:
    own = perturb.seeds(seed, 0)[1]
    axis = np.asarray(AXIS)
    ramp = 0.3 * (axis - axis.min()) / (axis.max() - axis.min() + 1e-9)
    centre = f"(cast(2900.0 as double) + {_between_sql(-50.0, 50.0, own, 1)})"
    shape = f"list_transform([{centre}], lambda c: list_transform({_list(AXIS)}, lambda wn, i: ({_list(ramp)})[i] + exp(-pow(wn - c, 2) / cast(20000.0 as double))))[1]"
    added = f"list_transform([{shape}], lambda p: list_transform(x, lambda v, i: v + {_between_sql(0.0, 0.1, own)} * {_PEAK} * (p[i] - list_min(p)) / (list_max(p) - list_min(p) + cast(0.000000001 as double))))[1]"
    return _sql(added)


def _co2_sql(seed: int) -> str:
    own, c = perturb.seeds(seed, 0)[1], CO2_DRAWN
    peaks = []
    for k in range(c["n_peaks"]):
        middle = f"(cast({c['loc1']!r} as double) + cast({c['loc2'] - c['loc1']!r} as double) * {share_sql(place_key_sql(str(k), '0', own))})"
        centre, height, width = (f"({base} + cast({d!r} as double) * {gaussian_sql('vec_id', str(3 * k + j), own)})" for j, (base, d) in enumerate(((middle, c["d_loc"]), (f"cast({c['height']!r} as double)", c["d_height"]), (f"cast({c['width']!r} as double)", c["d_width"]))))
        peaks.append(f"{{'c': {centre}, 'h': {height}, 'w': {width}}}")
    total = " + ".join(f"p[{k + 1}].h * p[{k + 1}].w * p[{k + 1}].w / (p[{k + 1}].w * p[{k + 1}].w + 4 * pow(({_list(AXIS)})[i] - p[{k + 1}].c, 2))" for k in range(c["n_peaks"]))
    return _sql(f"list_transform([[{', '.join(peaks)}]], lambda p: list_transform(x, lambda v, i: v + {total}))[1]")


def _matrix_sql(matrix: np.ndarray, x: str = "x") -> str:
    """matrix @ x."""
    return f"list_transform([{', '.join(_list(row) for row in matrix)}], lambda matrix_row: list_inner_product(matrix_row, {x}))"


def _emsc_sql(order: int) -> str:
    """What powers of the axis cannot tell of a spectrum, over the reference's
    share of it, and what they can tell of the reference."""
    from prismspark.functions.kernels import scaled_axis

    q, _ = np.linalg.qr(np.vander(scaled_axis(_axis), order + 1))
    rest = np.eye(CHANNELS) - q @ q.T
    more = f""", l as (select unnest(range(0, {CHANNELS})) as ch, unnest(x) as v from e), m as (select ch, avg(v) as v from l group by ch), ref as (select list(v order by ch) as r from m),
      pr as (select r, {_matrix_sql(rest, "r")} as pr from ref), px as (select vec_id, r, pr, {_matrix_sql(rest)} as px from e, pr),
      s as (select vec_id, r, pr, px, list_inner_product(px, pr) / list_inner_product(pr, pr) as c from px)"""
    return f"""with {_E}{more}, z as (select vec_id, list_transform(px, lambda v, i: v / c + r[i] - pr[i]) as z from s)
    select vec_id, unnest(range(0, len(z))) as ch, round(unnest(z), 6) + cast(0 as double) as value from z"""


def _smoothed(window: int, order: int, deriv: int = 0, n: int = CHANNELS) -> np.ndarray:
    from prismspark.functions.kernels import savgol_matrix

    return savgol_matrix(n, window, order, deriv)


def _preprocess_sql() -> str:
    m = _smoothed(7, 2, 0, len(_KEEP)) @ np.eye(CHANNELS)[list(_KEEP)]
    standard = f"list_transform(x, lambda v: (v - {_MEAN}) / greatest({_STD}, 0.001))"
    return f"""with {_E}, f as (select vec_id, {_matrix_sql(m)} as x from e), z as (select vec_id, {standard} as z from f)
    select vec_id, unnest(range(0, len(z))) as ch, round(unnest(z), 6) + cast(0 as double) as value from z"""


def _shot_sql() -> str:
    ordered = "list_transform([list_sort(list_transform(x, lambda v: abs(v)))], lambda s: s[60] + cast(0.85 as double) * (s[61] - s[60]))[1]"
    level = f"({_between_sql(0, 0.05, 3)} * abs(v) + cast(0.01 as double) * {ordered})"
    return _sql(_noise_sql("x", level, 4))


def nkk_real_part(rows: DataFrame) -> DataFrame:
    from prismspark.functions.kernels import kramers_kronig

    waves = 1e4 / _axis
    return preprocess.map_spectra(rows, lambda x: kramers_kronig(x, waves))


def _kramers_kronig() -> np.ndarray:
    """The transform is linear: its matrix."""
    from prismspark.functions.kernels import kramers_kronig

    return kramers_kronig(np.eye(CHANNELS), 1e4 / _axis).T


QUERIES = {
    "nearest_centroid_accuracy": nearest_centroid_accuracy,
    "snv_embeddings": _native(native.standardized),
    "vector_norm_l1": _native(lambda x: native.unit_norm(x, 1)),
    "vector_norm_l2": _native(lambda x: native.unit_norm(x, 2)),
    "instance_norm": _native(native.instance_norm),
    "znorm_array": _native(lambda x: native.standardized(x, 0.0, 1e-8)),
    "crop_channels": _native(lambda x: native.take(x, _KEEP)),
    "interp_grid": _native(lambda x: native.interpolate(x, AXIS, GRID)),
    "wn_shift_fixed": _native(lambda x: augment.wavenumber_shift(x, AXIS, SHIFT)),
    "poly_baseline": _native(lambda x: augment.polynomial_baseline(x, AXIS, _amount(0.01), F.lit(1.1), F.lit(0.05), F.lit(-0.02))),
    "co2_fixed": _native(lambda x: augment.lorentzian_peaks(x, AXIS, native.doubles([p[0] for p in CO2]), native.doubles([p[1] for p in CO2]), native.doubles([p[2] for p in CO2]))),
    "paraffin_fixed": _native(lambda x: augment.paraffin(x, AXIS, _amount(0.005))),
    "homogenizer_fixed": _native(lambda x: augment.homogenizer(x, AXIS, _amount(0.01))),
    "temperature_fixed": _native(lambda x: augment.temperature(x, AXIS, _amount(0.2), ((1640, 40), (3340, 120)))),
    "preservative_fixed": _native(lambda x: augment.preservative(x, AXIS, "bronopol", _amount(0.004))),
    "dilution_fixed": _native(lambda x: augment.dilution(x, AXIS, _amount(0.02))),
    "mean_spectrum_by_label": mean_spectrum_by_label,
    "savgol_interior": savgol_interior,
    "msc_regression": msc_regression,
    "first_difference": first_difference,
    "fisher_ratio": _one(complexity.fisher_ratio, "fisher_ratio"),
    "spectral_entropy": _one(complexity.spectral_entropy, "spectral_entropy"),
    "participation_ratio": _one(complexity.participation_ratio, "participation_ratio"),
    "roughness": _one(complexity.roughness, "roughness"),
    "complexity_report": complexity_report,
    "softmax_topk": softmax_topk,
    "argmax_bgprob": argmax_bgprob,
    "cross_entropy": _loss(0.0, 1.0, "cross_entropy"),
    "focal_loss": _loss(2.0, 0.25, "focal_loss"),
    "als_baseline": _chain([{"type": "als"}]),
    "savgol_full": _chain([{"type": "savgol", "window": 11, "polyorder": 3, "deriv": 1}]),
    "emsc_poly2": _chain([{"type": "emsc", "poly_order": 2}]),
    "fringe_emsc": _chain([{"type": "fringe_emsc", "fringe_wn_location": [1500, 2600]}]),
    "me_emsc": _chain([{"type": "me_emsc", "n_components": 3, "max_iter": 3}]),
    "preprocess_chain": _chain([{"type": "crop", "keep": WINDOWS}, {"type": "savgol", "window": 7, "polyorder": 2}, {"type": "snv"}]),
    "pluggable_step": _chain([{"type": "network", "function": lambda x: 2 * x}]),
    "augment_chain": augment_chain,
    "wn_shift_rowwise": _single("wavenumber_shift", 11, shift_max=40.0),
    "paraffin_jitter": _single("paraffin", 12),
    "homogenizer_jitter": _single("homogenizer_degradation", 13),
    "co2_drawn": _single("co2_peaks", 14, **CO2_DRAWN),
    "white_noise": _perturbed(lambda r: r.withColumn("x", augment.white_noise(F.col("x"), augment.between(0, 0.05, 1, F.col("vec_id")), 2, F.col("vec_id")))),
    "shot_noise": _perturbed(lambda r: r.withColumn("x", augment.shot_noise(F.col("x"), augment.between(0, 0.05, 3, F.col("vec_id")), 0.01, 4, F.col("vec_id")))),
    "cosmic_rays": _perturbed(lambda r: augment.cosmic_rays(r, "vec_id", rate=0.02, seed=5)),
    "fluorescence_fit": fluorescence_fit,
    "fluorescence_apply": _perturbed(_fluorescence),
    "mie_sphere": _perturbed(lambda r: augment.mie_scattering(r, "vec_id", AXIS, "sphere", 6)),
    "mie_cylinder": _perturbed(lambda r: augment.mie_scattering(r, "vec_id", AXIS, "cylinder", 7)),
    "nkk": _perturbed(nkk_real_part),
    "pca_dim": pca_dim,
    "scaling_law_fit": scaling_law_fit,
    "scaling_law_normalised_error": scaling_law_normalised_error,
    "score_network": score_network,
    "score_dense": score_dense,
    "train_classifier": train_classifier,
}

_LONG = f"{_E}, l as (select vec_id, y, unnest(range(0, {CHANNELS})) as ch, unnest(x) as v from e)"
_FISHER = """k as (select y, ch, count(*) as n, sum(v) as s, var_pop(v) as w from l group by y, ch), g as (select ch, sum(s) / sum(n) as m from k group by ch),
  f as (select sum(n * (s / n - m) * (s / n - m)) / sum(n * w) as v from k join g using (ch))"""
_ENTROPY = "a as (select ch, avg(abs(v)) as a from l group by ch), h as (select -sum(a / t * ln(a / t)) as v from a, (select sum(a) as t from a))"
_RATIO = """cv as (select i.ch as i, j.ch as j, covar_samp(i.v, j.v) as c from l i join l j using (vec_id) group by 1, 2),
  pr as (select pow(sum(c) filter (i = j), 2) / sum(c * c) as v from cv)"""
_ROUGH = "r as (select avg(d * d) as v from (select v - lag(v) over (partition by vec_id order by ch) as d from l))"

ORACLE_SQL = {
    "nearest_centroid_accuracy": f"""with {_E}, s as (select vec_id, y, list_transform(x, lambda v: (v - {_MEAN}) / greatest({_STD}, 0.001)) as x from e),
      l as (select vec_id, y, unnest(range(0, {CHANNELS})) as ch, unnest(x) as v from s), m as (select y as cls, ch, avg(v) as m from l group by 1, 2),
      d as (select vec_id, y, cls, round(sum((v - m) * (v - m)), 9) as d from l join m using (ch) group by 1, 2, 3),
      b as (select vec_id, y, cls, row_number() over (partition by vec_id order by d, cls) as r from d)
      select y as label, count(*) as n, round(avg(case when cls = y then cast(1 as double) else cast(0 as double) end), 6) as accuracy from b where r = 1 group by y""",
    "snv_embeddings": _sql(f"list_transform(x, lambda v: (v - {_MEAN}) / greatest({_STD}, 0.001))"),
    "vector_norm_l1": _sql("list_transform(x, lambda v: v / list_sum(list_transform(x, lambda w: abs(w))))"),
    "vector_norm_l2": _sql("list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda w: w * w))))"),
    "instance_norm": _sql(f"list_transform(x, lambda v: (v - {_MEAN}) / sqrt(list_var_pop(x) + cast(0.00001 as double)))"),
    "znorm_array": _sql(f"list_transform(x, lambda v: (v - {_MEAN}) / ({_STD} + cast(0.00000001 as double)))"),
    "crop_channels": _sql(f"list_transform({[c + 1 for c in _KEEP]}, lambda i: x[i])"),
    "interp_grid": _sql(_lerp_sql(GRID)),
    "wn_shift_fixed": _sql(_lerp_sql([v - SHIFT for v in AXIS], True)),
    "poly_baseline": _sql(f"list_transform(x, lambda v, i: cast(1.1 as double) * v + {_amount_sql(0.01)} + cast(0.05 as double) * ({_list(_T)})[i] - cast(0.02 as double) * ({_list(_T)})[i] * ({_list(_T)})[i])"),
    "co2_fixed": _sql("list_transform(x, lambda v, i: v" + "".join(f" + cast({h!r} as double) * {w * w!r} / ({w * w!r} + 4 * pow(({_list(AXIS)})[i] - {c!r}, 2))" for c, h, w in CO2) + ")"),
    "paraffin_fixed": _sql(_plus(_PARAFFIN, _amount_sql(0.005))),
    "homogenizer_fixed": _sql(_plus(_GLOBULE, f"{_amount_sql(0.01)} * {_PEAK}")),
    "temperature_fixed": _sql(_plus(_TEMP, f"{_amount_sql(0.2)} * {_PEAK}")),
    "preservative_fixed": _sql(f"list_transform(x, lambda v, i: v + {_PEAK} * ({_amount_sql(0.004)} * ({_list(_PEAKS)})[i] + ({_list(_MOVED)})[i]))"),
    "dilution_fixed": _sql(f"list_transform(x, lambda v, i: (1 - {_amount_sql(0.02)}) * v + {_amount_sql(0.02)} * {_PEAK} * ({_list(_WATER)})[i])"),
    "mean_spectrum_by_label": f"with {_LONG} select y, ch, round(avg(v), 6) + cast(0 as double) as value from l group by y, ch",
    "savgol_interior": _savgol_sql(),
    "msc_regression": f"""with {_LONG}, m as (select ch, avg(v) as m from l group by ch) select vec_id, round(regr_slope(v, m), 6) as slope,
      round(regr_intercept(v, m), 6) + cast(0 as double) as intercept from l join m using (ch) group by vec_id""",
    "first_difference": _sql("list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i])"),
    "fisher_ratio": f"with {_LONG}, {_FISHER} select round(v, 6) as fisher_ratio from f",
    "spectral_entropy": f"with {_LONG}, {_ENTROPY} select round(v, 6) as spectral_entropy from h",
    "participation_ratio": f"with {_LONG}, {_RATIO} select round(v, 6) as participation_ratio from pr",
    "roughness": f"with {_LONG}, {_ROUGH} select round(v, 6) as roughness from r",
    "complexity_report": f"""with {_LONG}, {_FISHER}, {_ENTROPY}, {_RATIO}, {_ROUGH} select 'fisher_ratio' as measure, round(v, 6) as value from f union all
      select 'spectral_entropy', round(v, 6) from h union all select 'participation_ratio', round(v, 6) from pr union all select 'roughness', round(v, 6) from r""",
    "softmax_topk": f"""with {_E}, l as (select vec_id, unnest(range(0, {CHANNELS})) as cls, unnest(list_transform(x, lambda v: exp(v - list_max(x)))) as s from e),
      p as (select vec_id, cls, s / sum(s) over (partition by vec_id) as p, row_number() over (partition by vec_id order by s desc, cls) - 1 as rank from l)
      select vec_id, rank, cls, round(p, 6) as prob from p where rank < 3""",
    "argmax_bgprob": f"""with {_E}, s as (select vec_id, {_SOFT} as s from e)
      select vec_id, cast(list_position(s, list_max(s)) - 1 as bigint) as pred, round(s[1] / list_sum(s), 6) as bg_prob from s""",
    "cross_entropy": _loss_sql(0.0, 1.0, "cross_entropy"),
    "focal_loss": _loss_sql(2.0, 0.25, "focal_loss"),
    "pluggable_step": _sql("list_transform(x, lambda v: 2 * v)"),
    "augment_chain": _chain_sql(),
    "score_dense": _dense_sql(),
    "nkk": _sql(_matrix_sql(_kramers_kronig())),
    "wn_shift_rowwise": _shift_rows_sql(40.0, 11),
    "paraffin_jitter": _sql(_paraffin_sql("x", 0.05, perturb.seeds(12, 0)[1])),
    "homogenizer_jitter": _homogenizer_sql(13),
    "co2_drawn": _co2_sql(14),
    "white_noise": _sql(_noise_sql("x", _between_sql(0, 0.05, 1), 2)),
    "shot_noise": _shot_sql(),
    "savgol_full": _sql(_matrix_sql(_smoothed(11, 3, 1))),
    "preprocess_chain": _preprocess_sql(),
    "emsc_poly2": _emsc_sql(2),
}
