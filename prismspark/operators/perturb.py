"""Registry of perturbations: an ordered list of entries over spectra.

An entry names its type (its key in a mapping, if it has none), the share of
rows that it changes (``ratio``), and whether it keeps to signal or background
rows; the rest are the type's own settings.  Draws are keyed by seed, entry and
row, so a rerun repeats them.  Types that are expressions fuse into one plan;
those that need a kernel cost an Arrow pass.  A row whose result is not finite
keeps what it had.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismspark.functions import hashrand, native
from prismspark.operators import augment
from prismspark.operators.augment import between
from prismspark.operators.sampling import fresh, ident_key, random_mask, seeded, water_fill

Change = Callable[[Column, Column], Column]


class Perturbation:
    """kind: 'native' (make gives (x, ident) -> Column) or 'rows' (make gives
    DataFrame -> DataFrame, which replaces x)."""

    def __init__(self, kind: str, make: Callable):
        self.kind, self.make = kind, make


PERTURBATIONS: dict[str, Perturbation] = {}


def register(name: str, kind: str, make: Callable) -> None:
    PERTURBATIONS[name] = Perturbation(kind, make)


def _range(cfg: Mapping, name: str, low: float, high: float, strength: float = 1.0) -> tuple[float, float]:
    """Ends of an amplitude's range; strength scales both."""
    pair = cfg.get(f"{name}_range", (low, high))
    return float(cfg.get(f"{name}_min", pair[0])) * strength, float(cfg.get(f"{name}_max", pair[1])) * strength


# The names of settings below and their defaults are those of the
# published configurations.


def _polynomial(cfg, axis, ident, seed, strength, basis) -> Change:
    ranges = cfg.get("param_ranges") or [_range(cfg, f"p{k}", float(k == 1), float(k == 1)) for k in range(4)]
    return lambda x, key: augment.polynomial_baseline(x, axis, *[between(*map(float, r), seed, key, k) for k, r in enumerate(ranges)])


def _noise(cfg, axis, ident, seed, strength, basis) -> Change:
    return lambda x, key: augment.white_noise(x, between(0.0, float(cfg["max_level"]) * strength, seed, key), seed + 1, key)


def _shot_noise(cfg, axis, ident, seed, strength, basis) -> Change:
    return lambda x, key: augment.shot_noise(x, between(0.0, float(cfg.get("scale", 0.05)) * strength, seed, key), float(cfg.get("read_noise", 0.0)), seed + 1, key)


def _co2(cfg, axis, ident, seed, strength, basis) -> Change:
    names = ("loc1", "loc2", "d_loc", "height", "d_height", "width", "d_width", "n_peaks")
    loc1, loc2, d_loc, height, d_height, width, d_width, n = cfg.get("params") or [cfg[k] for k in names]
    return lambda x, key: augment.co2_peaks(x, axis, key, seed, (loc1, loc2), d_loc, (height * strength, d_height * strength), (width, d_width), int(n))


def _paraffin(cfg, axis, ident, seed, strength, basis) -> Change:
    low, high = _range(cfg, "amplitude", 0.0, 0.05, strength)
    jitter = 3.0 if cfg.get("randomise_bands", True) else 0.0
    return lambda x, key: augment.paraffin_drawn(x, axis, between(low, high, seed, key), key, seed, jitter)


def _shift(cfg, axis, ident, seed, strength, basis):
    top = float(cfg.get("shift_max", 3.0)) * strength
    key = F.lit(0) if cfg.get("per_batch", False) else F.col(ident)
    return lambda rows: augment.wavenumber_shift_rows(rows, axis, between(-top, top, seed, key))


def _homogenizer(cfg, axis, ident, seed, strength, basis) -> Change:
    low, high = _range(cfg, "amplitude", 0.0, 0.1, strength)
    jitter = float(cfg.get("bump_center_jitter", 50.0))
    shape = {"slope": float(cfg.get("slope_strength", 0.3)), "width": float(cfg.get("bump_width", 100.0)), "bump": float(cfg.get("bump_strength", 1.0))}

    def change(x: Column, key: Column) -> Column:
        centre = between(-jitter, jitter, seed, key, 1) + float(cfg.get("bump_center", 2900.0))
        return augment.homogenizer_drawn(x, axis, between(low, high, seed, key), centre, relative=bool(cfg.get("relative_amplitude", True)), **shape)

    return change


def _temperature(cfg, axis, ident, seed, strength, basis) -> Change:
    top = float(cfg.get("temp_delta_max", 2.0)) * strength
    bands = [(float(cfg.get("band_center", 1640.0)), float(cfg.get("band_width", 40.0))), *(tuple(map(float, b[:2])) for b in cfg.get("extra_bands") or [])]
    return lambda x, key: augment.temperature(x, axis, between(-top, top, seed, key) * float(cfg.get("amplitude_scale", 1.0)), bands, float(cfg.get("shift_per_degree", 0.3)))


def _preservative(cfg, axis, ident, seed, strength, basis) -> Change:
    low, high = _range(cfg, "amplitude", 0.0, 0.03, strength)
    shift, scale = float(cfg.get("shift_max", 1.0)), float(cfg.get("shift_scale", 1.0))
    # The bands' movement is linear in the shift, which a row draws.
    return lambda x, key: augment.preservative(x, axis, cfg.get("preservative", "azidiol"), between(low, high, seed, key), 1.0, between(-shift, shift, seed, key, 1) * scale)


def _dilution(cfg, axis, ident, seed, strength, basis) -> Change:
    low, high = _range(cfg, "dilution", 0.0, 0.15, strength)
    return lambda x, key: augment.dilution(x, axis, between(low, high, seed, key), cfg.get("water_reference"), bool(cfg.get("scale_reference", True)))


def _mie(cfg, axis, ident, seed, strength, basis):
    shape = "cylinder" if cfg.get("variant", cfg.get("shape", "spherical")).startswith("cylind") else "sphere"
    names = (("r", 2.0, 6.0), ("n0", 1.2, 1.5), ("n_imag", 0.0, 0.01), ("h", 0.5, 1.0), ("scale", 0.2, 1.0))
    return lambda rows: augment.mie_scattering(rows, ident, axis, shape, seed, tuple(_range(cfg, *n) for n in names))


def _cosmic(cfg, axis, ident, seed, strength, basis):
    low, high = _range(cfg, "amplitude", 3.0, 15.0, strength)
    return lambda rows: augment.cosmic_rays(rows, ident, float(cfg.get("spike_rate", 0.002)), (low, high), int(cfg.get("max_width", 3)), seed)


def _fluorescence(cfg, axis, ident, seed, strength, basis):
    return lambda rows: augment.fluorescence(rows, ident, basis, _range(cfg, "amplitude", 0.0, 0.25, strength), seed)


for _name, _kind, _make in (
    ("polynomial_baseline", "native", _polynomial), ("noise", "native", _noise), ("shot_noise", "native", _shot_noise), ("co2_peaks", "native", _co2),
    ("paraffin", "native", _paraffin), ("homogenizer_degradation", "native", _homogenizer), ("temperature_perturbation", "native", _temperature),
    ("preservative_effect", "native", _preservative), ("dilution", "native", _dilution), ("wavenumber_shift", "rows", _shift), ("mie_scattering", "rows", _mie),
    ("cosmic_rays", "rows", _cosmic), ("fluorescence", "rows", _fluorescence),
):
    register(_name, _kind, _make)


def resolve(entries: Mapping[str, Mapping] | Sequence[Mapping] | None) -> list[dict]:
    """Enabled entries in order, each with its type; unknown types are an error
    even where an entry is off."""
    named = [{"type": name, **cfg} for name, cfg in entries.items()] if isinstance(entries, Mapping) else [dict(e) for e in entries or []]
    for entry in named:
        if entry.get("type") not in PERTURBATIONS:
            raise KeyError(f"Unknown perturbation {entry.get('type')!r}; known: {sorted(PERTURBATIONS)}")
    return [e for e in named if e.get("enabled", True)]


def fit(rows: DataFrame, entries, pool: DataFrame | None = None, ident: str = "vec_id", label: str = "y", core: str | None = None) -> dict[str, dict] | None:
    """Background bases of the enabled fluorescence entries, by their place.  An
    entry with a ``fit_pool_size`` is fitted on so many rows of ``pool`` (all
    training rows; ``rows`` if None), even over labels and drawn by
    ``fit_pool_seed``, so that the basis does not change with the sample."""
    found = {}
    for place, entry in enumerate(resolve(entries)):
        if entry["type"] == "fluorescence":
            size, drawn = int(entry.get("fit_pool_size") or 0), rows
            if size > 0:
                drawn, seed = pool if pool is not None else rows, int(entry.get("fit_pool_seed") or 0)
                labels = max(1, drawn.select(label).distinct().count())
                drawn = water_fill(drawn, label, core or label, ident, -(-size // labels), seed)
                drawn = drawn.orderBy(seeded(drawn, ident, seed + 1), ident).limit(size)
            found[str(place)] = augment.fit_background(drawn.select("x"), int(entry.get("n_components", 5)), float(entry.get("als_lam", 1e5)), float(entry.get("als_p", 0.01)))
    return found or None


def seeds(seed: int, place: int) -> tuple[int, int]:
    """Seeds of an entry's mask and of its own draws."""
    return 1_000 * seed + 10 * place, 1_000 * seed + 10 * place + 1


def perturb(rows: DataFrame, ident: str, axis: Sequence[float], entries, seed: int = 0, strength: float = 1.0, background: Column | None = None, basis: dict | None = None) -> DataFrame:
    """``rows`` with ``x`` after all entries.  ``background`` tells background
    rows; without it entries go by their ratio alone.  ``basis`` is what ``fit``
    gave, or one fitted background for all entries."""
    entries = resolve(entries)
    if dict(rows.dtypes)[ident] == "string":
        named = fresh(rows, "key")
        keyed = perturb(rows.withColumn(named, ident_key(rows, ident)), named, axis, entries, seed, strength, background, basis)
        return keyed.drop(named)
    for place, cfg in enumerate(entries):
        mask_seed, own = seeds(seed, place)
        allowed = None
        if background is not None and cfg.get("signal_only", False):
            allowed = ~background
        elif background is not None and cfg.get("background_only", False):
            allowed = background
        mask = random_mask(F.col(ident), float(cfg.get("ratio", 1.0)), mask_seed, allowed)
        step = PERTURBATIONS[cfg["type"]]
        fitted = basis.get(str(place), basis if "mean" in basis else None) if basis else None
        change = step.make(cfg, list(axis), ident, own, strength, fitted)
        if step.kind == "native":
            rows = rows.withColumn("x", augment.masked(F.col("x"), change(F.col("x"), F.col(ident)), mask))
        else:
            columns, old = rows.columns, fresh(rows, "old")
            changed = change(rows.withColumn(old, F.col("x")))
            rows = changed.withColumn("x", augment.masked(F.col(old), F.col("x"), mask)).select(*[F.col(f"`{c}`") for c in columns])
    return rows


def raman_pipeline(rows: DataFrame, ident: str, axis: Sequence[float], basis: dict | None, p_apply: float = 1.0, seed: int = 0, **settings: dict) -> DataFrame:
    """Spikes, then a fluorescent background, then shot noise, for a share
    ``p_apply`` of the rows (the same rows in each); rows that would not be
    finite in the end stay as they are."""
    mask = random_mask(F.col(ident), p_apply, seed)
    entries = [{"type": t, **settings.get(t, {})} for t in ("cosmic_rays", "fluorescence", "shot_noise") if t != "fluorescence" or basis is not None]
    columns, first = rows.columns, fresh(rows, "first")
    changed = perturb(rows.withColumn(first, F.col("x")), ident, axis, entries, seed, basis=basis)
    return changed.withColumn("x", augment.masked(F.col(first), F.col("x"), mask)).select(*[F.col(f"`{c}`") for c in columns])
