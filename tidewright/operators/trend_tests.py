"""Trend and change-point tests of one series in numpy, for operators that hold an entity's series already."""

from __future__ import annotations

import math

import numpy as np

BOUNDS = {0.05: 1.959963984540054, 0.1: 1.6448536269514722, 0.01: 2.5758293035489004}
#: Values without their trend that are no farther apart are equal: as far as a rounding to nine digits goes.
TIED = 1e-9


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, which, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[which]


def mann_kendall(x: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float | None, float | None, str | None]:
    """(s, slope, z, p, trend) as series.mann_kendall has them; x has two values or more."""
    n = len(x)
    i, j = np.triu_indices(n, 1)
    rise = x[j] - x[i]
    s, slope = float(np.sign(rise).sum()), float(np.median(rise / (j - i)))
    c = np.unique(x, return_counts=True)[1]
    variance = (n * (n - 1) * (2 * n + 5) - (c * (c - 1) * (2 * c + 5)).sum()) / 18
    d = x - slope * np.arange(1, n + 1)
    rising = np.argsort(d)
    d[rising] = np.cumsum(np.diff(d[rising], prepend=d[rising[0]]) > TIED)
    r = _ranks(d) - (n + 1) / 2
    power = float((r * r).sum())
    if power and n > 2:
        lag = np.arange(1, n)
        corr = np.correlate(r, r, "full")[n:] / power
        own = np.abs(corr) >= BOUNDS[alpha] / math.sqrt(n)
        variance *= 1 + 2 * ((n - lag) * (n - lag - 1) * (n - lag - 2) * corr)[own].sum() / (n * (n - 1) * (n - 2))
    if s == 0:
        z = 0.0
    elif variance > 0:
        z = (s - math.copysign(1, s)) / math.sqrt(variance)
    else:
        return s, slope, None, None, None
    p = math.erfc(abs(z) / math.sqrt(2))
    return s, slope, z, p, "no trend" if p >= alpha or z == 0 else "increasing" if z > 0 else "decreasing"


def pettitt(x: np.ndarray) -> tuple[float, int, float]:
    """(k, place, p): the first place where |2 * rank sum - i (n + 1)| is largest."""
    n = len(x)
    u = np.abs(2 * np.cumsum(_ranks(x)) - np.arange(1, n + 1) * (n + 1))
    k = float(u.max())
    return k, int(u.argmax()), min(1.0, 2 * math.exp(-6 * k * k / (n**3 + n**2)))


def outlier_factors(y: np.ndarray, k: int = 12, stretch: float = 5.0) -> np.ndarray:
    """Local outlier factors of (time * stretch, y), both scaled to [0, 1]; neighbours at equal distance (to 9 digits) in order of time.

    NaN where y is; all NaN for a constant series or one of a single known value.
    """
    known = np.flatnonzero(np.isfinite(y))
    out, value = np.full(len(y), np.nan), y[known]
    if len(known) < 2 or not np.ptp(value) > 0:
        return out
    at, value = stretch * known / (len(y) - 1), (value - value.min()) / np.ptp(value)
    d = np.sqrt((at[:, None] - at) ** 2 + (value[:, None] - value) ** 2)
    shown = np.round(d, 9)
    np.fill_diagonal(shown, np.inf)
    near = np.argsort(shown, axis=1, kind="stable")[:, : min(k, len(known) - 1)]
    far = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(far, far.max(1)[near]).mean(1) + 1e-10)
    out[known] = density[near].mean(1) / density
    return out
