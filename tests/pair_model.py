"""Literal per-pair model in numpy, written from the method's definition:
least squares with intercept, unit-root regression of the residual differences
on the lagged residual (no extra lags, with constant) in the order given
(newest first), critical value for the sample size, spread over all
(a_i, b_j) combinations or over the aligned residuals, population deviation."""

from __future__ import annotations

import numpy as np

from pairsignals.functions.critical import critical_value_py


def ols(y, x):
    X = np.column_stack([np.ones(len(x)), x])
    coef, *_ = np.linalg.lstsq(X, y, rcond=None)
    return coef  # intercept, slope


def adf_t(r):
    x = r[:-1]
    y = r[1:] - r[:-1]
    X = np.column_stack([x, np.ones(len(x))])
    coef, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ coef
    m = len(y)
    sigma2 = e @ e / (m - 2)
    cov = sigma2 * np.linalg.inv(X.T @ X)
    return coef[0] / np.sqrt(cov[0, 0]), m


def pair(a, b, z_thresh=2.0, level="5%", spread="cross"):
    """a, b: newest first. Returns dict with the statistics and verdict."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    alpha, beta = ols(a, b)
    r = a - alpha - beta * b
    t, m = adf_t(r)
    crit = critical_value_py(level, m)
    if spread == "cross":
        signal = np.array([ai - beta * bj - alpha for ai in a for bj in b])
    else:
        signal = r
    mean, sd = signal.mean(), signal.std()
    z = (signal[0] - mean) / sd
    if not t < crit:
        verdict = "not_cointegrated"
    elif abs(z) > z_thresh:
        verdict = "tradeable"
    else:
        verdict = "cointegrated"
    return dict(alpha=alpha, beta=beta, adf_t=t, adf_m=m, crit_value=crit, signal_mean=mean,
                signal_sd=sd, z_score=z, verdict=verdict)
