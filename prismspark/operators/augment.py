"""Perturbations of spectra; every draw is a column, keyed by seed and row.

Profiles are worked out on the driver and enter as array literals; what differs
by row (amplitudes, shifts, spikes) are expressions, so a perturbation with
fixed draws can be checked against SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismspark.functions import hashrand, native, profiles
from prismspark.functions.kernels import add_background, als_baseline, scattered
from prismspark.operators import complexity
from prismspark.operators.preprocess import map_spectra


def between(low: float, high: float, seed: int, ident: Column, place: int = 0) -> Column:
    """Uniform between two numbers; a row has a draw for each place."""
    return low + (high - low) * hashrand.share(hashrand.place_key(ident, place, seed))


def masked(x: Column, changed: Column, mask: Column) -> Column:
    """``changed`` where the mask holds and it is finite throughout, else x."""
    return F.when(mask, native.let(changed, lambda c: native.finite_or(c, x))).otherwise(x)


def polynomial_baseline(x: Column, axis: Sequence[float], p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """p1 x + p0 + p2 t + p3 t^2 on the scaled axis t."""
    t = native.doubles(profiles.polynomial_axis(np.asarray(axis)))
    return F.zip_with(x, t, lambda v, u: p1 * v + p0 + p2 * u + p3 * u * u)


def white_noise(x: Column, level: Column, seed: int, key: Column) -> Column:
    return native.let(F.struct(hashrand.gaussian_keys(key, seed).alias("k"), level.alias("level")), lambda s: F.transform(x, lambda v, i: v + s["level"] * hashrand.gaussian_at(s["k"], i, seed)))


def shot_noise(x: Column, scale: Column, read_noise: float, seed: int, key: Column) -> Column:
    """Noise in proportion to |v|, with a floor in proportion to the 95th
    percentile of |x| (linear between its neighbours)."""
    ordered = F.array_sort(F.transform(x, F.abs))
    at = 0.95 * (F.size(x) - 1)
    low = F.floor(at).cast("int")

    def noisy(s: Column) -> Column:
        top = F.get(s, low) + (at - low) * (F.get(s, F.least(low + 1, F.size(x) - 1)) - F.get(s, low))
        row = F.struct(hashrand.gaussian_keys(key, seed).alias("k"), scale.alias("scale"), (read_noise * top).alias("floor"))
        return native.let(row, lambda r: F.transform(x, lambda v, i: v + (r["scale"] * F.abs(v) + r["floor"]) * hashrand.gaussian_at(r["k"], i, seed)))

    return native.let(ordered, noisy)


def lorentzian_peaks(x: Column, axis: Sequence[float], centres: Column, heights: Column, widths: Column) -> Column:
    """x plus Lorentzian peaks given as arrays of equal length."""
    def added(peaks: Column) -> Column:
        at = lambda wn: F.aggregate(peaks, F.lit(0.0), lambda acc, p: acc + p["h"] * p["w"] * p["w"] / (p["w"] * p["w"] + 4 * (wn - p["c"]) * (wn - p["c"])))
        return F.zip_with(x, native.doubles(axis), lambda v, wn: v + at(wn))

    return native.let(F.arrays_zip(centres.alias("c"), heights.alias("h"), widths.alias("w")), added)


def co2_peaks(x: Column, axis: Sequence[float], ident: Column, seed: int, place: tuple[float, float], d_place: float, height: tuple[float, float], width: tuple[float, float], n: int) -> Column:
    """``n`` Lorentzian peaks: a place for each of them, drawn for all rows
    alike, around which a row's centres are spread; heights and widths (mean,
    deviation) are drawn a row and peak."""
    middle = [between(*map(float, place), seed, F.lit(k)) for k in range(n)]

    def peaks(keys: Column) -> Column:
        draw = lambda k, j: hashrand.gaussian_at(keys, 3 * k + j, seed)
        return F.struct(
            F.array(*[m + float(d_place) * draw(k, 0) for k, m in enumerate(middle)]).alias("c"),
            F.array(*[float(height[0]) + float(height[1]) * draw(k, 1) for k in range(n)]).alias("h"),
            F.array(*[F.abs(float(width[0]) + float(width[1]) * draw(k, 2)) for k in range(n)]).alias("w"),
        )

    return native.let(native.let(hashrand.gaussian_keys(ident, seed), peaks), lambda p: lorentzian_peaks(x, axis, p["c"], p["h"], p["w"]))


def paraffin_drawn(x: Column, axis: Sequence[float], amount: Column, ident: Column, seed: int, jitter: float = 3.0) -> Column:
    """Paraffin whose bands are each moved by up to ``jitter`` in every row."""
    def moved(key: Column) -> Column:
        draw = lambda k: -jitter + 2 * jitter * hashrand.share(hashrand.place_at(key, 1 + k, seed))
        return F.array(*[float(c) + draw(k) for k, (c, _, _) in enumerate(profiles.PARAFFIN_BANDS)])

    def profile(centres: Column) -> Column:
        def at(wn: Column) -> Column:
            away = [wn - F.get(centres, F.lit(k)) for k in range(len(profiles.PARAFFIN_BANDS))]
            return sum(float(a * w * w) / (float(w * w) + 4 * d * d) for d, (_, w, a) in zip(away, profiles.PARAFFIN_BANDS, strict=True))

        return F.transform(native.doubles(axis), at)

    shape = native.let(native.let(hashrand.order_key(ident, seed), moved), profile)
    return native.let(shape, lambda p: native.let(F.array_max(p) + 1e-9, lambda top: F.zip_with(x, p, lambda v, b: v + amount * (b / top))))


def wavenumber_shift_rows(rows: DataFrame, axis: Sequence[float], shift: Column) -> DataFrame:
    """``rows`` with each spectrum read ``shift`` further along the axis, the
    ends held; a shift a row, on an axis of either direction."""
    order = np.argsort(np.asarray(axis, float), kind="stable")
    points = np.asarray(axis, float)[order]

    def kernel(x: np.ndarray) -> np.ndarray:
        values, moved = x[:, :-1][:, order], np.clip(points - x[:, -1:], points[0], points[-1])
        left = np.clip(np.searchsorted(points, moved, side="right") - 1, 0, max(len(points) - 2, 0))
        right = np.minimum(left + 1, len(points) - 1)
        gap = points[right] - points[left]
        weight = (moved - points[left]) / np.where(gap > 0, gap, 1.0)
        out = np.empty_like(values)
        out[:, order] = np.take_along_axis(values, left, 1) * (1 - weight) + np.take_along_axis(values, right, 1) * weight
        return out

    return map_spectra(rows.withColumn("x", F.concat("x", F.array(shift))), kernel)


def paraffin(x: Column, axis: Sequence[float], amount: Column) -> Column:
    return native.add_profile(x, native.doubles(profiles.bands(np.asarray(axis), profiles.PARAFFIN_BANDS)), amount)


def wavenumber_shift(x: Column, axis: Sequence[float], shift: float) -> Column:
    """The spectrum read ``shift`` further along the axis, the ends held."""
    return native.interpolate(x, axis, [v - shift for v in axis], clamp=True)


def homogenizer(x: Column, axis: Sequence[float], amount: Column, **profile: float) -> Column:
    shape = native.doubles(profiles.fat_globule(np.asarray(axis), **profile))
    return native.let(native.peak(x), lambda top: native.add_profile(x, shape, amount * top))


def homogenizer_drawn(x: Column, axis: Sequence[float], amount: Column, centre: Column, slope: float = 0.3, width: float = 100.0, bump: float = 1.0, relative: bool = True) -> Column:
    """As ``homogenizer``, the bump's centre drawn a row."""
    points = np.asarray(axis, float)
    ramp = slope * (points - points.min()) / (points.max() - points.min() + 1e-9)

    def raw(c: Column) -> Column:
        return F.zip_with(native.doubles(ramp), native.doubles(points), lambda r, wn: r + bump * F.exp(-(wn - c) * (wn - c) / (2 * width**2)))

    def added(p: Column) -> Column:
        low = F.array_min(p)
        row = F.struct(low.alias("low"), (F.array_max(p) - low + 1e-9).alias("span"), (amount * native.peak(x) if relative else amount).alias("amount"))
        return native.let(row, lambda r: F.zip_with(x, p, lambda v, b: v + r["amount"] * ((b - r["low"]) / r["span"])))

    return native.let(native.let(centre, raw), added)


def temperature(x: Column, axis: Sequence[float], degrees: Column, bands: Sequence[tuple[float, float]] = ((1640, 40),), per_degree: float = 0.3) -> Column:
    """Bands move by a shift per degree; the height is the row's own peak."""
    shape = sum(profiles.band_shift(np.asarray(axis), c, w, per_degree) for c, w in bands)
    return native.let(native.peak(x), lambda top: native.add_profile(x, native.doubles(shape), degrees * top))


def preservative(x: Column, axis: Sequence[float], name: str, amount: Column, shift: float = 1.0, scale: Column | float = 1.0) -> Column:
    peaks, moved = profiles.preservative(np.asarray(axis), name, shift)
    pair = F.arrays_zip(native.doubles(peaks).alias("p"), native.doubles(moved).alias("m"))
    return native.let(native.peak(x), lambda top: F.zip_with(x, pair, lambda v, b: v + top * (amount * b["p"] + scale * b["m"])))


def dilution(x: Column, axis: Sequence[float], share: Column, water: Sequence[float] | None = None, rescale: bool = True) -> Column:
    """(1 - share) x + share * water, the water brought to the row's peak."""
    if water is not None and len(water) != len(axis):
        raise ValueError(f"water has {len(water)} channels, the axis has {len(axis)}")
    ref = np.asarray(profiles.bands(np.asarray(axis), profiles.WATER_BANDS) if water is None else water, float)
    ref = ref / (np.abs(ref).max() + 1e-9) if rescale else ref
    return native.let(native.peak(x) if rescale else F.lit(1.0), lambda top: F.zip_with(x, native.doubles(ref), lambda v, b: (1 - share) * v + share * top * b))


def cosmic_rays(rows: DataFrame, ident: str, rate: float = 0.002, amplitude: tuple[float, float] = (3.0, 15.0), widest: int = 3, seed: int = 0, wide: bool = False) -> DataFrame:
    """Spikes: their number follows a Poisson law of the channels times the
    rate (by inversion of one uniform draw), each of random centre, width and
    height.  A spike of width w covers w // 2 channels on each side of its
    centre and tapers to 0 at its ends; with ``wide`` the ends keep half."""
    key, n = F.col(ident), F.size("x")
    # The sum of draws of means up to 16, so that neither exp(-mean) nor the
    # walk along the law comes near its end (100 is passed with chance 1e-45).
    draws = F.greatest(F.lit(1), F.ceil(n * F.lit(rate) / 16)).cast("int")

    def poisson(u: Column, mean: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
        grow = lambda acc, i: F.when(u > acc["c"], F.struct((acc["k"] + 1).alias("k"), (acc["p"] * mean / i).alias("p"), (acc["c"] + acc["p"] * mean / i).alias("c"))).otherwise(acc)
        return F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, grow, lambda acc: acc["k"])

    each = native.let(draws, lambda d: native.let(n * F.lit(rate) / d, lambda mean: F.transform(F.sequence(F.lit(1), d), lambda j: native.let(hashrand.uniform(seed, key, F.lit("n"), j), lambda u: poisson(u, mean)))))
    count = F.aggregate(each, F.lit(0), lambda acc, k: acc + k)
    level = native.mean(F.transform("x", F.abs))

    def spike(i: Column) -> Column:
        draw = lambda name: hashrand.uniform(seed, key, F.lit(name), i)
        return F.struct(F.floor(draw("c") * n).alias("c"), F.floor((1 + F.floor(draw("w") * widest)) / 2).alias("half"), (amplitude[0] + (amplitude[1] - amplitude[0]) * draw("a")).alias("a"))

    spikes = F.transform(F.filter(F.sequence(F.lit(0), count), lambda i: i < count), spike)

    def shape(j: Column, s: Column) -> Column:
        low, high = F.greatest(F.lit(0), s["c"] - s["half"]), F.least(n - 1, s["c"] + s["half"])
        length = high - low + 1
        at = F.least(j - low, high - j)
        top = F.greatest(F.ceil(length / 2) - 1, F.lit(1))
        tall = F.when(length <= 2, F.lit(1.0)).otherwise((at + 1) / (top + 1) if wide else at / top)
        return F.when((j >= low) & (j <= high), s["a"] * tall).otherwise(0.0)

    hit = native.let(spikes, lambda all_: native.let(level, lambda m: F.transform("x", lambda v, j: v + m * F.aggregate(all_, F.lit(0.0), lambda acc, s: acc + shape(j, s)))))
    return rows.withColumn("x", native.finite_or(hit, F.col("x")))


def fit_background(rows: DataFrame, components: int = 5, lam: float = 1e5, p: float = 0.01) -> dict[str, np.ndarray]:
    """Mean, leading directions and their spreads of the baselines of all
    spectra.  Baselines are fitted and multiplied by batches; a matrix of
    channels by channels is all that the driver sees."""
    base = map_spectra(rows.select(F.lit(0).alias("vec_id"), F.lit(0).alias("y"), "x"), lambda x: als_baseline(x, lam, p)).persist(StorageLevel.DISK_ONLY)
    try:
        mean = np.array([r["value"] for r in complexity.mean_spectrum(base).orderBy("ch").collect()])
        table = complexity.covariance(base).toArrow()
    finally:
        base.unpersist()
    matrix = np.zeros((len(mean), len(mean)))
    matrix[table["i"].to_numpy(), table["j"].to_numpy()] = np.nan_to_num(table["c"].to_numpy(zero_copy_only=False))
    spread, directions = np.linalg.eigh(matrix)
    best = np.argsort(spread)[::-1][:components]
    return {"mean": mean, "basis": directions[:, best].T, "scale": np.sqrt(np.maximum(spread[best], 0))}


def fluorescence(rows: DataFrame, ident: str, basis: dict[str, np.ndarray] | None, amount: tuple[float, float] = (0.0, 0.25), seed: int = 0) -> DataFrame:
    """Adds a background of the fitted basis to every spectrum."""
    if basis is None:
        raise RuntimeError("fluorescence needs a fitted basis; call fit_background() first")
    k = len(basis["scale"])
    extra = [hashrand.gaussian(F.col(ident), i, seed) for i in range(k)] + [between(*amount, seed, F.col(ident), k)]
    packed = rows.withColumn("x", F.concat("x", F.array(*extra)))
    return map_spectra(packed, lambda x: add_background(x[:, : -k - 1], basis, x[:, -k - 1 : -1], x[:, -1]))


def mie_scattering(rows: DataFrame, ident: str, axis: Sequence[float], shape: str = "sphere", seed: int = 0, ranges: Sequence[tuple[float, float]] = ((2.0, 6.0), (1.2, 1.5), (0.0, 0.01), (0.5, 1.0), (0.2, 1.0))) -> DataFrame:
    """Replaces each spectrum by the apparent absorbance of a scatterer of the
    same material, of drawn radius, index, absorption and mixing."""
    draws = [between(*r, seed, F.col(ident), i) for i, r in enumerate(ranges)]
    wn = np.asarray(axis, float)

    def kernel(x: np.ndarray) -> np.ndarray:
        spectrum, (radius, n0, absorb, h, mix) = x[:, :-5], x[:, -5:].T
        low, high = spectrum.min(axis=1, keepdims=True), spectrum.max(axis=1, keepdims=True)
        return scattered((spectrum - low) / np.maximum(high - low, 1e-9), wn, radius, n0, absorb, h, mix, shape)

    return map_spectra(rows.withColumn("x", F.concat("x", F.array(*draws))), kernel)
