"""Order-dependent filters and p-values: small numpy helpers that run per group."""

from __future__ import annotations

import math

import numpy as np


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter of radius int(4 sigma + 0.5) with reflected borders, over the last axis."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    padded = np.pad(np.asarray(x, float), [(0, 0)] * (np.ndim(x) - 1) + [(r, r)], mode="symmetric")
    return np.apply_along_axis(np.convolve, -1, padded, k / k.sum(), "valid")


def causal_halfgaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Half-Gaussian over the past ceil(4 sigma) bins and the present one, with zeros before the first."""
    d = np.arange(math.ceil(4 * sigma) + 1)
    k = np.exp(-(d**2) / (2 * sigma**2))
    return np.convolve(np.asarray(x, float), k / k.sum())[: len(x)]


def moving_average(x: np.ndarray, size: int) -> np.ndarray:
    """Uniform filter whose window starts size // 2 before, with the edge value repeated."""
    padded = np.pad(np.asarray(x, float), (size // 2, size - 1 - size // 2), mode="edge")
    return np.convolve(padded, np.full(size, 1 / size), "valid")


def butter_sections(order: int, cutoff: float, rate: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a low-pass Butterworth filter, by the bilinear transform."""
    warped = 2 * rate * math.tan(math.pi * cutoff / rate)
    sections = []
    for k in range(order // 2):
        pole = warped * np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order))
        z = (2 * rate + pole) / (2 * rate - pole)
        a1, a2 = -2 * z.real, abs(z) ** 2
        g = (1 + a1 + a2) / 4
        sections.append((g, 2 * g, g, a1, a2))
    if order % 2:
        z = (2 * rate - warped) / (2 * rate + warped)
        g = (1 - z) / 2
        sections.append((g, g, 0.0, -z, 0.0))
    return np.array(sections)


def lowpass(x: np.ndarray, order: int, cutoff: float, rate: float) -> np.ndarray:
    """Causal Butterworth filter with zero initial state."""
    y = np.asarray(x, float).copy()
    for b0, b1, b2, a1, a2 in butter_sections(order, cutoff, rate):
        s1 = s2 = 0.0
        for i, v in enumerate(y):
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[i] = out
    return y


def nan_median(x: np.ndarray, width: int, most_nan: float = 0.5) -> np.ndarray:
    """Sliding median that skips NaN; an even width grows by one, ends are copied, NaN where too many are."""
    width += 1 - width % 2
    h, x = width // 2, np.asarray(x, float)
    out = x.copy()
    if len(x) < width:
        return out
    w = np.lib.stride_tricks.sliding_window_view(x, width)
    bad = np.isnan(w).mean(1)
    middle = np.full(len(w), np.nan)
    ok = bad < 1
    middle[ok] = np.nanmedian(w[ok], 1)
    middle[bad > most_nan] = np.nan
    out[h : len(x) - h] = middle
    return out


def median_zero(x: np.ndarray, size: int = 3) -> np.ndarray:
    """Sliding median with zeros beyond the ends."""
    h = size // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, float), h), size), 1)


def decimate(x: np.ndarray, q: int) -> np.ndarray:
    """Every q-th sample after a zero-phase Hamming FIR of 20 q + 1 taps; one sample is padded if short."""
    x = np.asarray(x, float)
    if len(x) % q:
        x = np.append(x, x[-1])
    n = np.arange(20 * q + 1) - 10 * q
    h = np.sinc(n / q) / q * np.hamming(20 * q + 1)
    return np.convolve(x, h / h.sum())[10 * q :][: len(x)][::q]


def nan_gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter whose weights are shared among finite samples; edges are extended."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    padded = np.pad(np.asarray(x, float), r, mode="edge")
    ok = np.isfinite(padded)
    total = np.convolve(np.where(ok, padded, 0.0), k, "valid")
    weight = np.convolve(ok.astype(float), k, "valid")
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 0, total / weight, np.nan)


def fill_gaps(x: np.ndarray) -> np.ndarray:
    """Linear over runs of NaN, the ends held."""
    x = np.asarray(x, float).copy()
    ok = np.isfinite(x)
    if ok.any():
        x[~ok] = np.interp(np.flatnonzero(~ok), np.flatnonzero(ok), x[ok])
    return x


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees > x), by the incomplete gamma function."""
    if x is None or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def mann_whitney_p(u: float, n1: int, n2: int, ties: float, alternative: str = "two-sided") -> float:
    """p of U; ties is the sum of t^3 - t. Exact for small untied samples, else normal with continuity."""
    if not n1 or not n2:
        return math.nan
    if ties == 0 and min(n1, n2) <= 8:
        few, many = min(n1, n2), max(n1, n2)
        counts = np.zeros(n1 * n2 + 1)
        counts[0] = 1
        for i in range(1, few + 1):  # Gaussian binomial coefficient, factor by factor
            up = counts.copy()
            up[many + i :] -= counts[: len(counts) - many - i]
            # Dividing by 1 - q^i is a running sum in steps of i.
            padded = np.pad(up, (0, -len(up) % i)).reshape(-1, i)
            counts = padded.cumsum(0).ravel()[: len(up)]
        share = counts / counts.sum()
        greater, less = share[int(u) :].sum(), share[: int(u) + 1].sum()
    else:
        n = n1 + n2
        sd = math.sqrt(max(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))), 0))
        if sd == 0:
            return 1.0
        middle = n1 * n2 / 2
        greater, less = normal_tail((u - middle - 0.5) / sd), normal_tail((middle - u - 0.5) / sd)
    return {"greater": min(1.0, greater), "less": min(1.0, less)}.get(alternative, min(1.0, 2 * min(greater, less)))


def signed_rank_p(plus: float, minus: float, n: int, ties: float, exact: bool, mean: float | None = None, var: float | None = None) -> float:
    """Two-sided p of the signed-rank statistic min(plus, minus)."""
    if not n:
        return math.nan
    w = min(plus, minus)
    if exact and n <= 50:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1
        for i in range(1, n + 1):
            counts[i:] += counts[:-i].copy()
        return float(min(1.0, 2 * counts[: int(w) + 1].sum() / 2.0**n))
    mean = n * (n + 1) / 4 if mean is None else mean
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48 if var is None else var
    return min(1.0, 2 * normal_tail(abs(w - mean) / math.sqrt(var))) if var > 0 else 1.0
