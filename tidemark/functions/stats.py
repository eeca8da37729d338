"""Tests and fits of one series, in numpy: unit roots, stationarity, autoregressions, lag orders."""

from __future__ import annotations

import math

import numpy as np

#: MacKinnon's (1994) response surfaces of the Dickey-Fuller t with a constant.
ADF_STAR, ADF_LOW, ADF_HIGH = -1.61, -18.83, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
#: Points of the KPSS statistic around a level (Kwiatkowski et al. 1992).
KPSS_POINTS, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
ADF_MAX_LAG, LB_LAG, MOST_ORDERS = 20, 10, 20


def shifted_log(x: np.ndarray, eps=1e-10) -> np.ndarray:
    low = float(np.min(x))
    return np.log1p(x + (abs(low) + eps if low <= 0 else eps))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares, diagonal of the inverse of X'X."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    return beta, float(e @ e), np.diag(np.linalg.pinv(x.T @ x))


def _adf_design(y: np.ndarray, lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(y)
    rows = np.arange(first, len(d))
    cols = [y[rows], *(d[rows - k] for k in range(1, lags + 1)), np.ones(len(rows))]
    return d[rows], np.column_stack(cols)


def adf(y: np.ndarray, max_lag=ADF_MAX_LAG) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller t with a constant, its p-value, and the lags chosen by AIC on a common sample."""
    y = np.asarray(y, float)
    max_lag = min(max_lag, (len(y) - 1) // 2 - 2)
    if max_lag < 0:
        raise ValueError("too few values for a unit root test")
    best = (math.inf, 0)
    for lags in range(max_lag + 1):
        dy, x = _adf_design(y, lags, max_lag)
        _, rss, _ = _ols(dy, x)
        n = len(dy)
        best = min(best, (n * math.log(max(rss, 1e-300) / n) + n * (1 + math.log(2 * math.pi)) + 2 * x.shape[1], lags))
    dy, x = _adf_design(y, best[1], best[1])
    beta, rss, inverse = _ols(dy, x)
    t = float(beta[0] / math.sqrt(rss / (len(dy) - x.shape[1]) * inverse[0]))
    if t > ADF_HIGH:
        return t, 1.0, best[1]
    if t < ADF_LOW:
        return t, 0.0, best[1]
    surface = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    return t, 0.5 * math.erfc(-sum(c * t**k for k, c in enumerate(surface)) / math.sqrt(2)), best[1]


def kpss(y: np.ndarray) -> tuple[float, float, int]:
    """KPSS statistic around a level, its p-value between 0.01 and 0.1, and the lags of Hobijn, Franses and Ooms."""
    e = np.asarray(y, float) - np.mean(y)
    n = len(e)
    s0, s1 = float(e @ e) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        c = float(e[k:] @ e[: n - k]) / (n / 2)
        s0, s1 = s0 + c, s1 + k * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    spread = float(e @ e) + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[: n - k]) for k in range(1, lags + 1))
    stat = float(np.sum(np.cumsum(e) ** 2)) / n**2 / (spread / n)
    return stat, float(np.interp(stat, KPSS_POINTS, KPSS_P)), lags


def ar_residuals(y: np.ndarray, p: int) -> np.ndarray:
    """Residuals of the least-squares autoregression with a constant, given the first p values."""
    x = np.column_stack([np.ones(len(y) - p), *(y[p - k : len(y) - k] for k in range(1, p + 1))])
    beta, *_ = np.linalg.lstsq(x, y[p:], rcond=None)
    return y[p:] - x @ beta


def chi2_tail(q: float, dof: int) -> float:
    """Upper tail for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= q / 2 / k
        total += term
    return math.exp(-q / 2) * total


def ljung_box(e: np.ndarray, lags=LB_LAG) -> tuple[float, float]:
    e = e - e.mean()
    n, s = len(e), float(e @ e)
    q = n * (n + 2) * sum((float(e[k:] @ e[: n - k]) / s) ** 2 / (n - k) for k in range(1, lags + 1))
    return q, chi2_tail(q, lags)


def optimal_lag(x: np.ndarray, most=MOST_ORDERS, alpha=0.05, relog=True) -> int:
    """The least order whose residuals pass the Ljung-Box test, the greatest tried if none does; 1 for what can't be fitted."""
    y = np.asarray(x, float)
    if len(y) < 10 or not np.isfinite(y).all() or np.ptp(y) == 0:
        return 1
    y = shifted_log(y) if relog else y
    top = max(1, min(most, len(y) // 5))
    for p in range(1, top + 1):
        try:
            e = ar_residuals(y, p)
            if len(e) > LB_LAG + 1 and ljung_box(e)[1] > alpha:
                return p
        except np.linalg.LinAlgError:
            continue
    return top


def stationarity(x: np.ndarray, relog=True) -> tuple[float | None, float | None]:
    """p-values of both tests; none where they can't be made."""
    y = np.asarray(x, float)
    if not len(y) or not np.isfinite(y).all() or np.std(y) == 0:
        return None, None
    y = shifted_log(y) if relog else y
    try:
        return adf(y)[1], kpss(y)[1]
    except (ValueError, np.linalg.LinAlgError, ZeroDivisionError):
        return None, None
