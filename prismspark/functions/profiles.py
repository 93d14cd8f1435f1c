"""Additive profiles on a wavenumber axis, worked out once on the driver."""

from __future__ import annotations

import numpy as np

# Band tables (centre, width, amplitude), in 1/cm.
PARAFFIN_BANDS = (
    (1462, 12, 0.35), (1377, 8, 0.15), (1170, 9, 0.06), (1062, 8, 0.04), (2920, 14, 1),
    (2850, 12, 0.85), (2955, 9, 0.30), (2870, 8, 0.20), (1735, 8, 0.03),
)
PRESERVATIVE_BANDS = {
    "azidiol": ((2050, 12, 1),),
    "bronopol": ((1545, 14, 0.6), (1370, 10, 0.4), (1040, 10, 0.25)),
}
WATER_BANDS = ((3340, 250, 1), (2130, 120, 0.1), (1640, 70, 0.55))
_TINY = 1e-9


def lorentzian(axis: np.ndarray, centre: float, width: float, amplitude: float) -> np.ndarray:
    return amplitude * width**2 / (width**2 + 4 * (axis - centre) ** 2)


def bands(axis: np.ndarray, table, shift: float = 0.0) -> np.ndarray:
    """Sum of Lorentzians with its peak at 1."""
    out = sum(lorentzian(axis, c + shift, w, a) for c, w, a in table)
    return out / (out.max() + _TINY)


def band_shift(axis: np.ndarray, centre: float, width: float, shift: float) -> np.ndarray:
    """First-order change when a Gaussian band moves by ``shift``."""
    return shift * (axis - centre) / width**2 * np.exp(-((axis - centre) ** 2) / (2 * width**2))


def preservative(axis: np.ndarray, name: str, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """(peaks, band movement) of a preservative."""
    if name not in PRESERVATIVE_BANDS:
        raise ValueError(f"Unknown preservative {name!r}; known: {sorted(PRESERVATIVE_BANDS)}")
    table = PRESERVATIVE_BANDS[name]
    return bands(axis, table), sum(a * band_shift(axis, c, w, shift) for c, w, a in table)


def fat_globule(axis: np.ndarray, slope: float = 0.3, centre: float = 2900, width: float = 100, bump: float = 1.0) -> np.ndarray:
    """Slope and Gaussian bump, brought to [0, 1]."""
    ramp = (axis - axis.min()) / (axis.max() - axis.min() + _TINY)
    out = slope * ramp + bump * np.exp(-((axis - centre) ** 2) / (2 * width**2))
    out = out - out.min()
    return out / (out.max() + _TINY)


def polynomial_axis(axis: np.ndarray) -> np.ndarray:
    """The axis brought to [-1, 1] around its mean."""
    return (axis - axis.mean()) / (abs(axis[0] - axis[-1]) / 2)


def strength(n: float, reference: float) -> float:
    """Strength of perturbations for ``n`` samples a class."""
    return float(np.clip(1 / np.log2(n / reference + 1), 0.1, 1))
