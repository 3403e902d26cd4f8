"""Fits per series that SQL aggregates don't express: robust lines, polynomials by cross-validation, trend filters, extrema, wavelets, kriging, collocation.

Each is a NumPy kernel on one series, run by `per_series` in grouped Arrow tasks; a series is one cell's or one epoch's values. Line fits and correlations
are Spark's own aggregates (regr_slope, regr_intercept, corr) and need no kernel.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial, gamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_series(df: DataFrame, key: str | list[str], order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a kernel to each group of key, its rows in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(key).applyInPandas(run, schema)


def huber_line(x: np.ndarray, y: np.ndarray, tune: float = 1.345, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) by Huber's M-estimate: reweighted least squares, scale by the median absolute deviation. NaN under two points."""
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    if len(x) < 2:
        return np.nan, np.nan
    a = np.stack([x, np.ones(len(x))], 1)
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(rounds):
        r = y - a @ beta
        scale = np.median(np.abs(r)) / 0.6744897501960817
        if scale <= 1e-12:
            break
        w = np.sqrt(np.minimum(1.0, tune * scale / np.maximum(np.abs(r), 1e-300)))
        new = np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
        done = np.abs(new - beta).max() < 1e-10
        beta = new
        if done:
            break
    return float(beta[0]), float(beta[1])


def polynomial(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients, the highest power first; NaN under three points."""
    ok = ~(np.isnan(x) | np.isnan(y))
    return np.polyfit(x[ok], y[ok], degree) if ok.sum() >= 3 else np.full(degree + 1, np.nan)


def polynomial_by_folds(x: np.ndarray, y: np.ndarray, most: int = 3, folds: int = 5) -> tuple[int, np.ndarray]:
    """The degree from 1 to `most` with the least mean squared error over folds i % folds, and its coefficients over all points."""
    ok = ~(np.isnan(x) | np.isnan(y))
    x, y = x[ok], y[ok]
    if len(x) < 3:
        return 1, np.full(2, np.nan)
    fold = np.arange(len(x)) % folds
    errors = []
    for d in range(1, most + 1):
        e = [np.mean((np.polyval(np.polyfit(x[fold != k], y[fold != k], d), x[fold == k]) - y[fold == k]) ** 2) for k in range(folds) if (fold == k).any() and (fold != k).sum() > d]
        errors.append(np.mean(e) if e else np.inf)
    best = int(np.argmin(errors)) + 1
    return best, np.polyfit(x, y, best)


def lasso_polynomial(x: np.ndarray, y: np.ndarray, degree: int = 3, penalty: float = 0.01, rounds: int = 500) -> np.ndarray:
    """The fitted curve of an L1-penalised polynomial on standardised powers, by coordinate descent."""
    a = np.stack([x**k for k in range(1, degree + 1)], 1)
    mean, sd = a.mean(0), a.std(0)
    a = (a - mean) / np.where(sd > 0, sd, 1)
    r = y - y.mean()
    b = np.zeros(degree)
    for _ in range(rounds):
        old = b.copy()
        for k in range(degree):
            rho = a[:, k] @ (r - a @ b + a[:, k] * b[k]) / len(y)
            b[k] = np.sign(rho) * max(abs(rho) - penalty, 0) / max((a[:, k] ** 2).mean(), 1e-12)
        if np.abs(b - old).max() < 1e-10:
            break
    return a @ b + y.mean()


def _lasso(gram: np.ndarray, rho: np.ndarray, penalties: np.ndarray, rounds: int) -> np.ndarray:
    """(fits, penalties, columns): L1-penalised coefficients by coordinate descent on gram (fits, columns, columns) and rho (fits, columns), all fits and penalties at once."""
    b = np.zeros((len(rho), len(penalties), rho.shape[1]))
    for _ in range(rounds):
        most = 0.0
        for k in range(rho.shape[1]):
            own = gram[:, k, k][:, None]
            part = rho[:, k][:, None] - np.matmul(b, gram[:, :, k][:, :, None])[:, :, 0] + own * b[:, :, k]
            new = np.sign(part) * np.maximum(np.abs(part) - penalties, 0) / np.maximum(own, 1e-12)
            most = max(most, np.abs(new - b[:, :, k]).max())
            b[:, :, k] = new
        if most < 1e-8:
            break
    return b


def lasso_by_folds(x: np.ndarray, y: np.ndarray, most: int = 3, folds: int = 10, penalties: int = 30, rounds: int = 1000) -> np.ndarray:
    """The fitted curve of an L1-penalised polynomial of degree `most` on standardised powers; the penalty, from the least that leaves no power down to a thousandth of it, has the least
    mean squared error over `folds` folds of successive points. Missing values take no part in the fit; NaN under three points."""
    ok = ~(np.isnan(x) | np.isnan(y))
    if ok.sum() < 3:
        return np.full(len(x), np.nan)
    # powers of a centred, scaled x: the same polynomials, and columns that are less alike
    u = (x - x[ok].mean()) / max(np.abs(x[ok] - x[ok].mean()).max(), 1e-12)
    powers, own, v = np.stack([u**k for k in range(1, most + 1)], 1), np.flatnonzero(ok), y[ok]

    def scale(rows):
        sd = powers[rows].std(0)
        return powers[rows].mean(0), np.where(sd > 0, sd, 1)

    mean, sd = scale(own)
    a = (powers - mean) / sd
    top = max(np.abs(a[own].T @ (v - v.mean())).max() / len(v), 1e-12)
    path = np.geomspace(top, top / 1000, penalties)
    parts = np.array_split(np.arange(len(v)), min(folds, len(v)))
    columns, values = [], []
    for part in parts:
        rest = np.setdiff1d(np.arange(len(v)), part)
        m, d = scale(own[rest])
        columns.append((powers - m) / d)
        values.append((v[rest].mean(), rest))
    fits = [(c[own[rest]], v[rest] - middle) for c, (middle, rest) in zip(columns, values)] + [(a[own], v - v.mean())]
    b = _lasso(np.stack([c.T @ c / len(c) for c, _ in fits]), np.stack([c.T @ r / len(c) for c, r in fits]), path, rounds)
    errors = sum(((c[own[part]] @ f.T + middle - v[part][:, None]) ** 2).mean(0) for part, c, f, (middle, _) in zip(parts, columns, b, values))
    return a @ b[-1, int(np.argmin(errors))] + v.mean()


def solve_five_bands(diagonal: np.ndarray, first: np.ndarray, second: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric positive definite system with two bands beside the diagonal: its factors L D L' have the same bands, so memory and time grow with the length."""
    n = len(diagonal)
    d, e, f, z = diagonal.tolist(), first.tolist() + [0.0], second.tolist() + [0.0, 0.0], right.tolist()
    # below[i] and beyond[i]: L's entries in column i, one and two rows further down
    below, beyond = [0.0] * n, [0.0] * n
    for i in range(n):
        if i + 1 < n:
            below[i] = e[i] / d[i]
            beyond[i] = f[i] / d[i]
            d[i + 1] -= below[i] * e[i]
            e[i + 1] -= below[i] * f[i]
            z[i + 1] -= below[i] * z[i]
        if i + 2 < n:
            d[i + 2] -= beyond[i] * f[i]
            z[i + 2] -= beyond[i] * z[i]
    after = last = 0.0
    for i in range(n - 1, -1, -1):
        after, last = z[i] / d[i] - below[i] * after - beyond[i] * last, after
        z[i] = after
    return np.array(z)


def trend_filter(y: np.ndarray, penalty: float = 7.0) -> np.ndarray:
    """The smooth part of y that minimises squared distance plus penalty times squared second differences."""
    n = len(y)
    if n < 3:
        return y.astype(float)
    # the bands of the products of second differences: each difference (1, -2, 1) adds to three rows
    d, e = np.zeros(n), np.zeros(n - 1)
    for k, w in enumerate((1.0, 4.0, 1.0)):
        d[k : n - 2 + k] += w
    for k in (0, 1):
        e[k : n - 2 + k] -= 2.0
    return solve_five_bands(1 + penalty * d, penalty * e, np.full(n - 2, float(penalty)), y)


def extrema(v: np.ndarray, delta: float) -> list[tuple[int, int]]:
    """(position, kind) of maxima (1) and minima (-1), in turn: an extremum counts once the series has moved `delta` away from it."""
    found, sign, best = [], 1, 0
    for i in range(len(v)):
        if np.isnan(v[i]):
            continue
        if sign * v[i] > sign * v[best] or np.isnan(v[best]):
            best = i
        if sign * (v[best] - v[i]) > delta:
            found.append((best, sign))
            best, sign = i, -sign
    return found


def drop_peaks(t: np.ndarray, y: np.ndarray, k: float = 3.0, rounds: int = 10) -> np.ndarray:
    """y with values over k deviations from the trend (polynomial by folds) as NaN, again until none is left."""
    y = y.astype(float).copy()
    for _ in range(rounds):
        _, c = polynomial_by_folds(t, y)
        r = y - np.polyval(c, t)
        out = np.abs(r) > k * np.nanstd(r, ddof=1) if (~np.isnan(r)).sum() > 2 else np.zeros(len(y), bool)
        if not out.any():
            break
        y[out] = np.nan
    return y


def low_pass(y: np.ndarray, cutoff: float, width: int = 21, beta: float = 5.0) -> np.ndarray:
    """Zero-phase low-pass: a Kaiser-windowed sinc of `width` taps, forward and backward, ends reflected; cutoff as a part of the Nyquist frequency."""
    k = np.arange(width) - (width - 1) / 2
    taps = cutoff * np.sinc(cutoff * k) * np.kaiser(width, beta)
    taps /= taps.sum()
    pad = min(width, len(y) - 1)
    x = np.concatenate([2 * y[0] - y[pad:0:-1], y, 2 * y[-1] - y[-2 : -pad - 2 : -1]])
    for _ in range(2):
        x = np.convolve(x, taps, "same")[::-1]
    return x[pad : pad + len(y)]


def smooth(y: np.ndarray, window: int = 11, kind: str = "hanning") -> np.ndarray:
    """Convolution with a window (flat, hanning, hamming, bartlett, blackman), ends reflected."""
    w = np.ones(window) if kind == "flat" else getattr(np, kind)(window)
    h = window // 2
    if len(y) <= h:
        return y.astype(float)
    return np.convolve(np.pad(y.astype(float), h, "reflect"), w / w.sum(), "valid")[: len(y)]


def smoothing_spline(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Reinsch's cubic smoothing spline at the points (x ascending and distinct)."""
    h = np.diff(x)
    n = len(x)
    if n < 3:
        return y.astype(float)
    # column j of the second divided differences has three entries, in rows j to j + 2
    one, three = 1 / h[:-1], 1 / h[1:]
    two = -one - three
    d = (h[:-1] + h[1:]) / 3 + penalty * (one**2 + two**2 + three**2)
    e = h[1:-1] / 6 + penalty * (two[:-1] * one[1:] + three[:-1] * two[1:])
    g = solve_five_bands(d, e, penalty * three[:-2] * one[2:], one * y[:-2] + two * y[1:-1] + three * y[2:])
    out = y.astype(float)
    for k, w in enumerate((one, two, three)):
        out[k : n - 2 + k] -= penalty * w * g
    return out


def wavelet_spectrum(kind: str, u: np.ndarray, order: float) -> np.ndarray:
    """The Fourier transform of a wavelet of unit energy at u = scale * angular frequency.

    kind: morlet (order: its frequency), real_morlet (its real part), paul (order m), dog (order m: derivatives of the Gaussian; 2 is the Mexican hat), haar (one, then minus one, half a unit each).
    """
    if kind in ("morlet", "real_morlet"):
        one = np.pi**-0.25 * np.exp(-0.5 * (u - order) ** 2)
        return one * (u > 0) if kind == "morlet" else (one + np.pi**-0.25 * np.exp(-0.5 * (u + order) ** 2)) / np.sqrt(2 * (1 + np.exp(-(order**2))))
    m = int(order)
    if kind == "paul":
        v = np.maximum(u, 0)
        return 2.0**m / np.sqrt(m * factorial(2 * m - 1)) * v**m * np.exp(-v) * (u > 0)
    if kind == "dog":
        return (-1) ** (m + 1) * 1j**m / np.sqrt(gamma(m + 0.5)) * u**m * np.exp(-0.5 * u * u)
    if kind == "haar":
        safe = np.where(u == 0, 1.0, u)
        return np.where(u == 0, 0, 4j * np.sin(u / 4) ** 2 / safe) / np.sqrt(2 * np.pi)
    raise ValueError(f"no wavelet {kind}")


def wavelet_scales(longest: float, notes: int, logarithmic: bool = True, shortest: float = 2.0) -> np.ndarray:
    """Scales from `shortest` to `longest`: `notes` per octave, or one per unit over `notes`."""
    if logarithmic:
        return shortest * 2.0 ** (np.arange(int(np.floor(notes * np.log2(longest / shortest) + 1e-9)) + 1) / notes)
    return np.arange(shortest * notes, longest * notes + 1) / notes


def wavelet_transform(y: np.ndarray, scales: np.ndarray, kind: str = "morlet", order: float = 6.0) -> np.ndarray:
    """(scales, points): the continuous transform of a periodic series without its mean, by FFT, with unit energy at each scale."""
    u = scales[:, None] * 2 * np.pi * np.fft.fftfreq(len(y))
    daughters = np.sqrt(2 * np.pi * scales)[:, None] * np.conj(wavelet_spectrum(kind, u, order))
    return np.fft.ifft(np.fft.fft(y - y.mean()) * daughters, axis=1)


def wavelet_power(y: np.ndarray, scales: np.ndarray, kind: str = "morlet", order: float = 6.0) -> np.ndarray:
    """(scales, points): squared absolute values of the transform."""
    return np.abs(wavelet_transform(y, scales, kind, order)) ** 2


def kriging(x: np.ndarray, y: np.ndarray, v: np.ndarray, gx: np.ndarray, gy: np.ndarray, length: float, nugget: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(value, error) of a Gaussian process with a squared-exponential covariance at the nodes."""
    cov = lambda a, b, c, d: np.exp(-0.5 * ((a[:, None] - c) ** 2 + (b[:, None] - d) ** 2) / length**2)
    var = max(v.var(), 1e-12)
    k = cov(x, y, x, y) + nugget * np.eye(len(x))
    s = cov(gx, gy, x, y)
    low = np.linalg.cholesky(k)
    w = np.linalg.solve(low, s.T)
    return v.mean() + w.T @ np.linalg.solve(low, v - v.mean()), np.sqrt(np.maximum(var * (1 + nugget - (w**2).sum(0)), 0))


def kriging_features(lows: tuple[float, float], highs: tuple[float, float], length: float, least: float = 1e-14) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The function from places in a box to (places, m) features whose products are kriging's covariance.

    exp(-(a - b)**2 / 2) is the sum over k of f_k(a) f_k(b) with f_k(a) = exp(-a**2 / 2) a**k / sqrt(k!); products of two such, one a direction, that nowhere in the box reach `least` are
    under the rounding of the others. m depends on the box's sides over the length and not on the number of places.
    """
    mid = [(a + b) / 2 for a, b in zip(lows, highs, strict=True)]
    most = []
    for a, b in zip(lows, highs, strict=True):
        half, bound, k = (b - a) / 2 / length, [], 0
        while k <= half**2 or bound[-1] >= least:
            u = min(half, k**0.5)
            bound.append((1.0 if not k else np.exp(2 * k * np.log(u) - u * u - sum(np.log(np.arange(1, k + 1)))) if u else 0.0))
            k += 1
        most.append(np.array(bound))
    one, two = np.nonzero(np.outer(*most) >= least)

    def line(u: np.ndarray, n: int) -> np.ndarray:
        f = np.empty((len(u), n))
        f[:, 0] = np.exp(-u * u / 2)
        for k in range(1, n):
            f[:, k] = f[:, k - 1] * u / k**0.5
        return f

    return lambda x, y: line((x - mid[0]) / length, len(most[0]))[:, one] * line((y - mid[1]) / length, len(most[1]))[:, two]


def kriging_sums(f: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """What kriging needs of any number of places with features f: sums, so that parts add up."""
    return {"ff": f.T @ f, "fv": f.T @ v, "f": f.sum(0), "v": np.array([len(v), v.sum(), (v * v).sum()])}


def kriging_of_sums(sums: dict[str, np.ndarray], g: np.ndarray, nugget: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """kriging's (value, error) at nodes with features g, of all places in the sums."""
    n, total, squares = sums["v"]
    mean = total / n
    low = np.linalg.cholesky(sums["ff"] + nugget * np.eye(len(sums["f"])))
    w = np.linalg.solve(low, g.T)
    var = max(squares / n - mean**2, 1e-12)
    return mean + w.T @ np.linalg.solve(low, sums["fv"] - mean * sums["f"]), np.sqrt(var * nugget * (1 + (w**2).sum(0)))


def collocation(distance: np.ndarray, to_node: np.ndarray, v: np.ndarray, error: np.ndarray, table_d: np.ndarray, table_c: np.ndarray) -> tuple[float, float]:
    """(signal, error) at a node by least squares: covariances are interpolated in a table (0 beyond it); error variances add to the diagonal."""
    look = lambda d: np.interp(d, table_d, table_c, right=0.0)
    c = look(distance) + np.diag(error**2)
    s = look(to_node)
    low = np.linalg.cholesky(c)
    a, b = np.linalg.solve(low, v), np.linalg.solve(low, s)
    return float(b @ a), float(np.sqrt(max(table_c[0] - b @ b, 0.0)))
