"""Predictive precedence of pairs of series: unit roots, cointegration, a VAR lag by BIC, and F-tests both ways.

Each pair is one group of Arrow rows. Least squares is numpy's; the tail of F is the regularised
incomplete beta function by its continued fraction; unit-root p-values come from the published response
surfaces of MacKinnon (1994, 2010).
"""

from __future__ import annotations

from math import erf, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAST = 24
# MacKinnon (1994) response surfaces with a constant, for one and two variables: bounds,
# and the coefficients of the normal quantile for small and large statistics.
SURFACES = {
    1: (2.74, -18.83, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (0.92, -18.86, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
SCHEMA = "n_obs int, adf_target double, adf_predictor double, differenced boolean, cointegration_p double, lag int, p_forward double, p_backward double, effect_forward double, effect_backward double, correlation double, verdict string, reason string"


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-30)
        c = 1 + n / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return 1.0 if f <= 0 else beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def unit_root_p(t: float, variables: int = 1) -> float:
    """MacKinnon's p-value of a unit-root statistic."""
    most, least, star, small, large = SURFACES[variables]
    if t > most:
        return 1.0
    if t < least:
        return 0.0
    z = sum(c * t**i for i, c in enumerate(small if t <= star else large))
    return 0.5 * (1 + erf(z / sqrt(2)))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares: coefficients, residual sum of squares and the inverse of x'x."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    return b, float(((y - x @ b) ** 2).sum()), inverse


def dickey_fuller(y: np.ndarray, constant: bool = True) -> float:
    """The augmented statistic, its lags chosen by AIC on a common sample."""
    d, top = np.diff(y), int(np.ceil(12 * (len(y) / 100) ** 0.25))
    top = max(0, min(top, len(d) // 2 - 2))

    def design(lags, start):
        columns = [y[start : len(d)]] + [d[start - k : len(d) - k] for k in range(1, lags + 1)]
        return np.column_stack(columns + [np.ones(len(d) - start)] * constant), d[start:]

    def aic(lags):
        x, z = design(lags, top)
        return len(z) * log(max(fit(x, z)[1], 1e-300) / len(z)) + 2 * x.shape[1]

    lags = min(range(top + 1), key=aic)
    x, z = design(lags, lags)
    b, rss, inverse = fit(x, z)
    return float(b[0] / sqrt(max(rss / (len(z) - x.shape[1]) * inverse[0, 0], 1e-300)))


def lagged(values: np.ndarray, lags: int) -> np.ndarray:
    """A constant and the lags 1..lags of every column, rows from ``lags`` on."""
    return np.column_stack([np.ones(len(values) - lags)] + [values[lags - k : len(values) - k] for k in range(1, lags + 1)])


def var_lag(values: np.ndarray, top: int) -> int:
    """The VAR order from 1 to ``top`` with the least BIC on a common sample."""
    def bic(p):
        y, x = values[top:], lagged(values[top - p :], p)
        r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return np.linalg.slogdet(r.T @ r / len(y))[1] + log(len(y)) / len(y) * p * values.shape[1] ** 2

    return min(range(1, top + 1), key=bic)


def granger(values: np.ndarray, lags: int) -> tuple[float, float]:
    """p-value of column 1 preceding column 0, and the sum of its coefficients."""
    x, y = lagged(values, lags), values[lags:, 0]
    own = [0, *range(1, x.shape[1], 2)]
    b, full, _ = fit(x, y)
    short = fit(x[:, own], y)[1]
    free = len(y) - x.shape[1]
    return f_tail((short - full) / lags / (full / free), lags, free) if full > 0 and free > 0 else 0.0, float(b[2::2].sum())


def untestable(target: np.ndarray, predictor: np.ndarray) -> str | None:
    """Why an aligned pair cannot be tested, or None."""
    if len(target) < LEAST:
        return f"{len(target)} aligned values; {LEAST} are needed"
    still = [name for name, x in (("target", target), ("predictor", predictor)) if x.std() == 0]
    return f"the {' and the '.join(still)} never varies" if still else None


def test_pair(target: np.ndarray, predictor: np.ndarray, max_lag: int = 6) -> dict:
    """All results for one aligned pair, or n_obs and the reason why there are none."""
    if why := untestable(target, predictor):
        return dict(n_obs=len(target), reason=why)
    both = np.column_stack([target, predictor]).astype(float)
    roots = [unit_root_p(dickey_fuller(both[:, i])) for i in (0, 1)]
    differenced = max(roots) > 0.05
    cointegration = None
    if min(roots) > 0.05:
        x = np.column_stack([predictor, np.ones(len(predictor))])
        cointegration = unit_root_p(dickey_fuller(target - x @ fit(x, target)[0], constant=False), 2)
    values = np.diff(both, axis=0) if differenced else both
    lag = var_lag(values, max(1, min(max_lag, len(values) // 8)))
    forward, backward = granger(values, lag), granger(values[:, ::-1], lag)
    flags = (forward[0] < 0.05, backward[0] < 0.05)
    verdict = {(True, True): "both", (True, False): "predictor->target", (False, True): "target->predictor", (False, False): "none"}[flags]
    return dict(n_obs=len(both), adf_target=roots[0], adf_predictor=roots[1], differenced=differenced, cointegration_p=cointegration, lag=lag, p_forward=forward[0], p_backward=backward[0], effect_forward=forward[1], effect_backward=backward[1], correlation=float(np.corrcoef(values.T)[0, 1]), verdict=verdict)


def granger_pairs(df: DataFrame, keys: list[str], target: str, predictor: str, max_lag: int = 6, period: str = "period") -> DataFrame:
    """One row per pair of series in a long table of aligned columns. Pairs that cannot be tested have nulls and
    a reason: too few aligned values, or a series that never varies.

    Raises where a pair has a period twice.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf[period].duplicated().any():
            raise ValueError("a period occurs twice")
        known = pdf.replace([np.inf, -np.inf], np.nan).dropna(subset=[target, predictor]).sort_values(period)
        got = test_pair(known[target].to_numpy(float), known[predictor].to_numpy(float), max_lag)
        row = dict.fromkeys(names) | {k: pdf[k].iloc[0] for k in keys} | got
        return pd.DataFrame({c: pd.Series([row[c]], dtype=object) for c in [*keys, *names]})

    return df.select(*keys, period, target, predictor).groupBy(*keys).applyInPandas(one, f"{fields}, {SCHEMA}")
