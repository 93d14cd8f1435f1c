"""Ordered preprocessing steps: registry, planner and fitted state.

Native steps are Catalyst expressions; linear ones are matrices known on the
driver.  Neighbouring linear steps are multiplied into one matrix, so a chain
of crop, smoothing and resampling costs one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismspark.functions import native
from prismspark.functions.kernels import als_baseline, emsc, fringe_emsc, me_emsc, savgol_matrix

Kernel = Callable[[np.ndarray], np.ndarray]


def map_spectra(rows: DataFrame, kernel: Kernel, column: str = "x") -> DataFrame:
    """``rows`` with ``column`` replaced by the kernel's, a batch at a time; rows
    of one batch that differ in length, or are null, are taken by their length."""
    at = rows.columns.index(column)
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at)
            sizes = old.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out: list = [None] * len(old)
            if len(set(sizes.tolist())) == 1 and not old.null_count and sizes[0]:
                out = list(kernel(old.flatten().to_numpy(zero_copy_only=False).reshape(len(old), -1)))
            else:
                values = old.to_pylist()
                for size in set(sizes.tolist()) - {0}:
                    k = np.flatnonzero(sizes == size)
                    for i, row in zip(k, kernel(np.array([values[i] for i in k], float)), strict=True):
                        out[i] = row
            columns = [pa.array(out, pa.list_(pa.float64())) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, schema)


class Step:
    """kind: 'native' (config, axis, state -> Column -> Column), 'linear'
    (config, axis, state -> (matrix, new axis)) or 'kernel' (-> Kernel)."""

    def __init__(self, name: str, kind: str, make: Callable, stateful: bool = False):
        self.name, self.kind, self.make, self.stateful = name, kind, make, stateful


STEPS: dict[str, Step] = {}


def register_step(name: str, kind: str, make: Callable, stateful: bool = False) -> None:
    STEPS[name] = Step(name, kind, make, stateful)


def _selection(channels: Sequence[int], n: int) -> np.ndarray:
    return np.eye(n)[list(channels)]


def _crop(cfg, axis, state):
    keep = native.window_channels(axis, [tuple(w) for w in cfg.get("keep", [])])
    return _selection(keep, len(axis)), [axis[c] for c in keep]


def _resample(cfg, axis, state):
    targets = np.linspace(cfg["start"], cfg["stop"], int(cfg["num"])).tolist()
    m = np.zeros((len(targets), len(axis)))
    for i, (a, b, w) in enumerate(native.brackets(axis, targets, cfg.get("clamp", False))):
        m[i, a] += 1 - w
        m[i, b] += w
    return m, targets


def _reference(state) -> np.ndarray:
    if "reference" not in state:
        raise RuntimeError("this step needs a fitted reference; call fit() first")
    return np.asarray(state["reference"], float)


def _network(cfg, axis, state) -> Kernel:
    """A given function, or what ``load`` returns, which a task calls once; it
    takes batches of spectra, as (rows, 1, channels) of 32-bit numbers with
    ``planes``, and may return either form."""
    function, load, size = cfg.get("function"), cfg.get("load"), int(cfg.get("batch", 4096))
    if (function is None) == (load is None):
        raise NotImplementedError("a network step needs either a function or a loader of one")
    if cfg.get("expect_channels", len(axis)) != len(axis):
        raise ValueError(f"the network expects {cfg['expect_channels']} channels, spectra have {len(axis)}")
    held: list = [] if function is None else [function]

    def kernel(x: np.ndarray) -> np.ndarray:
        if not held:
            held.append(load())
        out = []
        for k in range(0, len(x), size):
            part = x[k : k + size]
            made = np.asarray(held[0](part.astype(np.float32)[:, None] if cfg.get("planes") else part), float)
            out.append(made.reshape(len(part), -1))
        return np.vstack(out)

    return kernel


register_step("crop", "linear", _crop)
register_step("savgol", "linear", lambda c, axis, s: (savgol_matrix(len(axis), c.get("window", 11), c.get("polyorder", 3), c.get("deriv", 0)), list(axis)))
register_step("interpolate", "linear", _resample)
register_step("snv", "native", lambda c, axis, s: lambda x: native.standardized(x, c.get("eps", 1e-3)))
register_step("vector_norm", "native", lambda c, axis, s: lambda x: native.unit_norm(x, c.get("order", 2)))
register_step("z_normalize", "native", lambda c, axis, s: lambda x: native.finite_or_zero(native.standardized(x, 1e-3)))
register_step("als", "kernel", lambda c, axis, s: lambda x: x - als_baseline(x, c.get("lam", 1e5), c.get("p", 0.01), c.get("n_iter", 10)))
register_step("emsc", "kernel", lambda c, axis, s: (lambda ref: lambda x: emsc(x, ref, c.get("poly_order", 2), axis=np.asarray(axis)))(_reference(s)), True)
register_step("me_emsc", "kernel", lambda c, axis, s: (lambda ref: lambda x: me_emsc(x, np.asarray(axis), ref, c.get("n_components", 4), c.get("max_iter", 5)))(_reference(s)), True)
register_step("fringe_emsc", "kernel", lambda c, axis, s: (lambda ref: lambda x: fringe_emsc(x, np.asarray(axis), ref, tuple(c["fringe_wn_location"]), c.get("poly_order", 2)))(_reference(s)), True)
register_step("network", "kernel", _network)


def resolve(config: dict | list | None) -> list[dict]:
    """Enabled steps of a bare list or of {enabled, steps}; names are checked
    even where a step is off."""
    if config is None:
        return []
    on, steps = (config.get("enabled", True), config.get("steps", [])) if isinstance(config, dict) else (True, config)
    for step in steps:
        if step.get("type") not in STEPS:
            raise KeyError(f"Unknown preprocessing step {step.get('type')!r}; known: {sorted(STEPS)}")
    return [s for s in steps if s.get("enabled", True)] if on else []


def apply(rows: DataFrame, axis: Sequence[float], config, state: dict | None = None) -> tuple[DataFrame, list[float]]:
    """``rows`` with ``x`` after all steps, and the axis after them."""
    state, axis, matrix = state or {}, list(axis), None

    def flush(frame: DataFrame) -> DataFrame:
        if matrix is None:
            return frame
        fixed = matrix
        return map_spectra(frame, lambda x: x @ fixed.T)

    for cfg in resolve(config):
        step = STEPS[cfg["type"]]
        if step.kind == "linear":
            own, axis = step.make(cfg, axis, state)
            matrix = own if matrix is None else own @ matrix
            continue
        rows, matrix = flush(rows), None
        made = step.make(cfg, axis, state)
        rows = rows.withColumn("x", made(F.col("x"))) if step.kind == "native" else map_spectra(rows, made)
    return flush(rows), axis


def fit(rows: DataFrame, axis: Sequence[float], config) -> dict:
    """State of the chain: the mean spectrum just before its first step that
    needs a reference (one row of channels comes to the driver)."""
    steps = resolve(config)
    at = next((i for i, s in enumerate(steps) if STEPS[s["type"]].stateful), None)
    if at is None:
        return {}
    before, _ = apply(rows, axis, steps[:at])
    means = before.select(F.posexplode("x").alias("ch", "v")).groupBy("ch").agg(F.avg("v").alias("v")).orderBy("ch").collect()
    return {"reference": [r["v"] for r in means]}
