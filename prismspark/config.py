"""Run configuration: defaults, overrides, presets, and search spaces."""

from __future__ import annotations

import dataclasses
import json
import random
from dataclasses import dataclass, field


@dataclass
class Data:
    split: str = "patient"
    train_ratio: float = 0.8
    val_share: float = 0.5
    per_class: int = 64
    signal_above: float = 0.0
    background_below: float = 0.0
    z_normalize: bool = True
    preprocessing: list = field(default_factory=list)
    augment_train: bool = True
    augmentations: list | dict = field(default_factory=list)


@dataclass
class Model:
    """A softmax layer, behind one layer of ``hidden`` units if any; 0 classes
    are as many as the data have."""

    num_classes: int = 0
    hidden: int = 0
    gamma: float = 1.0
    lr: float = 1e-2
    weight_decay: float = 1e-3


@dataclass
class Trainer:
    batch_size: int = 64
    max_epochs: int = 5
    min_epochs: int = 2
    early_stopping_patience: int = 10
    least_patience: int = 5
    val_every_n_epochs: int = 1
    gradient_clip_val: float = 1.0


@dataclass
class Inference:
    batch: int = 512
    top_k: int = 3
    background_threshold: float = 0.5


@dataclass
class Config:
    domain: str = "default"
    seed: int = 0
    data: Data = field(default_factory=Data)
    model: Model = field(default_factory=Model)
    trainer: Trainer = field(default_factory=Trainer)
    inference: Inference = field(default_factory=Inference)


def override(config, changes: dict):
    """A copy with nested changes; unknown keys are an error."""
    known = {f.name for f in dataclasses.fields(config)}
    if unknown := set(changes) - known:
        raise KeyError(f"Unknown keys {sorted(unknown)}; known: {sorted(known)}")
    new = {k: override(getattr(config, k), v) if dataclasses.is_dataclass(getattr(config, k)) and isinstance(v, dict) else v for k, v in changes.items()}
    return dataclasses.replace(config, **new)


# Data settings of the published domains, as they are published.
_BASELINE_SIGNAL = {"type": "polynomial_baseline", "signal_only": True, "ratio": 0.6, "param_ranges": [[0.0, 0.0], [0.1, 4.0], [-0.15, 0.15], [-0.08, 0.08]]}
_BASELINE_BACKGROUND = {"type": "polynomial_baseline", "background_only": True, "ratio": 0.6, "param_ranges": [[0.0, 0.0], [0.01, 2.5], [-0.10, 0.10], [-0.05, 0.05]]}
_CO2_OFF = {"enabled": False, "ratio": 0.2, "params": [2300, 2400, 10, 0.0, 0.4, 30, 5, 6]}
_MIE = {
    "enabled": True, "signal_only": True, "ratio": 0.5, "n0_min": 1.3, "n0_max": 1.65, "r_min": 3.0, "r_max": 17.0, "n_imag_min": 1.0e-5, "n_imag_max": 1.0e-1,
    "h_min": 1.0, "h_max": 2.0, "scale_min": 2.5, "scale_max": 5.5, "theta_min": 0.2, "theta_max": 0.45,
}
_FLUORESCENCE = {"signal_only": True, "ratio": 0.5, "n_components": 5, "poly_degree": 3, "als_lam": 1.0e5, "als_p": 0.01, "fit_pool_size": 2000, "fit_pool_seed": 12345, "amplitude_min": 0.0}
PRESETS = {
    "microplastic": {"data": {
        "split": "patient", "per_class": 64, "signal_above": 0.3, "background_below": 0.05, "z_normalize": True, "augment_train": True,
        "augmentations": {
            "mie_scattering": {**_MIE, "variant": "spherical"},
            "polynomial_baseline_signal": _BASELINE_SIGNAL,
            "polynomial_baseline_background": _BASELINE_BACKGROUND,
            "noise": {"ratio": 0.5, "max_level": 0.01},
            "co2_peaks": _CO2_OFF,
        },
    }},
    "textile": {"data": {
        "split": "label", "per_class": 64, "signal_above": 0.0, "background_below": 0.0, "z_normalize": True, "augment_train": True,
        "augmentations": {
            "mie_scattering": {**_MIE, "variant": "cylindrical"},
            "polynomial_baseline_signal": _BASELINE_SIGNAL,
            "polynomial_baseline_background": _BASELINE_BACKGROUND,
            "noise": {"ratio": 0.5, "max_level": 0.01},
            "co2_peaks": _CO2_OFF,
        },
    }},
    "pollen": {"data": {"split": "label", "per_class": 64, "signal_above": 0.3, "background_below": 0.05, "z_normalize": True, "augment_train": True}},
    "milk": {"data": {
        "split": "patient", "per_class": 512, "z_normalize": False, "augment_train": True,
        "augmentations": {
            "polynomial_baseline_signal": {"type": "polynomial_baseline", "signal_only": True, "ratio": 0.5, "p0_min": 0.0, "p0_max": 0.5, "p1_min": 0.25, "p1_max": 2.0, "p2_min": -0.15, "p2_max": 0.15, "p3_min": -0.08, "p3_max": 0.08},
            "noise": {"ratio": 0.5, "max_level": 0.001},
            "wavenumber_shift": {"ratio": 0.5, "shift_max": 3.0, "per_batch": False},
            "temperature_perturbation": {"ratio": 0.5, "temp_delta_max": 2.0, "shift_per_degree": 0.5, "band_center": 1640.0, "band_width": 40.0, "amplitude_scale": 1.0},
        },
    }},
    "pcuk": {"data": {
        "split": "patient", "per_class": 128, "z_normalize": True, "augment_train": False,
        "augmentations": {
            "polynomial_baseline_signal": {"type": "polynomial_baseline", "signal_only": True, "ratio": 0.5, "p0_min": 0.0, "p0_max": 0.0, "p1_min": 0.25, "p1_max": 2.0, "p2_min": -0.15, "p2_max": 0.15, "p3_min": -0.08, "p3_max": 0.08},
            "noise": {"ratio": 0.5, "max_level": 0.025},
            "co2_peaks": {"ratio": 0.2, "loc1": 2300, "loc2": 2400, "d_loc": 10, "height": 0.0, "d_height": 0.4, "width": 30, "d_width": 5, "n_peaks": 6},
            "paraffin": {"ratio": 0.4, "amplitude_min": 0.0, "amplitude_max": 2.0, "randomise_bands": True},
            "wavenumber_shift": {"ratio": 0.4, "shift_max": 30.0, "per_batch": False},
        },
    }},
    "mlrod": {"data": {
        "split": "test", "per_class": 32, "z_normalize": True, "augment_train": True,
        "augmentations": {
            "cosmic_rays": {"ratio": 0.5, "spike_rate": 0.002, "amplitude_min": 3.0, "amplitude_max": 15.0, "max_width": 3},
            "fluorescence": {**_FLUORESCENCE, "amplitude_max": 0.25},
            "shot_noise": {"ratio": 0.5, "scale": 0.075, "read_noise": 0.005},
        },
    }},
    "bacteria": {"data": {
        "split": "test", "per_class": 32, "z_normalize": True, "augment_train": True,
        "augmentations": {
            "cosmic_rays": {"enabled": False, "ratio": 0.5, "spike_rate": 0.0002, "amplitude_min": 2.0, "amplitude_max": 5, "max_width": 3},
            "fluorescence": {**_FLUORESCENCE, "amplitude_max": 0.015},
            "shot_noise": {"ratio": 0.7, "scale": 0.003, "read_noise": 0.005},
        },
    }},
}


def preset(domain: str) -> Config:
    if domain not in PRESETS:
        raise KeyError(f"Unknown domain {domain!r}; known: {sorted(PRESETS)}")
    return override(Config(domain=domain), PRESETS[domain])


def load(*paths: str) -> Config:
    """Defaults, then the JSON files in order: each may name a ``domain``, whose
    preset comes first, and change any keys."""
    changes = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            changes.append(json.load(f))
    domain = next((c["domain"] for c in reversed(changes) if "domain" in c), None)
    config = preset(domain) if domain else Config()
    for change in changes:
        config = override(config, change)
    return config


def draw_trials(space: dict, n: int, seed: int = 0) -> list[dict]:
    """``n`` seeded draws: (low, high) is a range, ("log", low, high) a range
    drawn by its logarithm, a list a choice."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        row = {}
        for k, v in sorted(space.items()):
            if isinstance(v, list):
                row[k] = rng.choice(v)
            elif v[0] == "log":
                row[k] = v[1] * (v[2] / v[1]) ** rng.random()
            else:
                row[k] = v[0] + (v[1] - v[0]) * rng.random()
        out.append(row)
    return out
