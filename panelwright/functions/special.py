"""Distribution tails.

The normal tail is a column expression. The chi-square and F tails are
vectorised numpy functions applied to rows that are already one per group.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_ppf = np.frompyfunc(NormalDist().inv_cdf, 1, 1)


def normal_cdf_np(x) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def normal_ppf_np(p) -> np.ndarray:
    return np.asarray(_ppf(np.asarray(p, float)), float)


def chi2_sf_np(x, df) -> np.ndarray:
    """Upper tail of chi-square: regularised upper incomplete gamma Q(df/2, x/2)."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    a, z = df / 2, x / 2
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(z) & (a > 0)
    out[ok & (z <= 0)] = 1.0
    pos = ok & (z > 0)
    if not pos.any():
        return out
    a, z = a[pos], z[pos]
    front = np.exp(-z + a * np.log(z) - _lgamma(a).astype(float))
    # Series below the bend, continued fraction (modified Lentz) above it.
    term = 1 / a
    total = term.copy()
    ap = a.copy()
    for _ in range(2000):
        ap = ap + 1
        term = term * z / ap
        total = total + term
        if np.all((term < total * 1e-17) | (z >= a + 1)):
            break
    lower = 1 - front * total
    tiny = 1e-300
    b = z + 1 - a
    c = np.full_like(z, 1 / tiny)
    d = 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if np.all((np.abs(step - 1) < 1e-16) | (z < a + 1)):
            break
    out[pos] = np.clip(np.where(z < a + 1, lower, front * h), 0, 1)
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / fix(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / fix(1 + even * d)
        c = fix(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / fix(1 + odd * d)
        c = fix(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-16):
            break
    return h


def beta_inc_np(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) for 0 <= x <= 1."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    mid = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if mid.any():
        a, b, x = a[mid], b[mid], x[mid]
        front = np.exp(
            (_lgamma(a + b) - _lgamma(a) - _lgamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x)
        )
        swap = x > (a + 1) / (a + b + 2)
        aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        part = front * _beta_fraction(aa, bb, xx) / aa
        out[mid] = np.where(swap, 1 - part, part)
    return out


def f_sf_np(x, d1, d2) -> np.ndarray:
    """Upper tail of the F distribution."""
    x, d1, d2 = (np.asarray(v, float) for v in np.broadcast_arrays(x, d1, d2))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(x) & (d1 > 0) & (d2 > 0)
    out[ok] = beta_inc_np(d2[ok] / 2, d1[ok] / 2, d2[ok] / (d2[ok] + d1[ok] * np.maximum(x[ok], 0)))
    return out


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf_np(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return pd.Series(normal_ppf_np(p.to_numpy(float)))


# Coefficients of the published rational Chebyshev approximations
# of erf and erfc (W. J. Cody, Math. Comp. 23, 1969), in order of rising power.
_ERF_P = [3.209377589138469472562e3, 3.774852376853020208137e2, 1.138641541510501556495e2, 3.161123743870565596947, 1.857777061846031526730e-1]
_ERF_Q = [2.844236833439170622273e3, 1.282616526077372275645e3, 2.440246379344441733056e2, 2.360129095234412093499e1, 1.0]
_ERFC_P = [
    1.23033935479799725272e3, 2.05107837782607146532e3, 1.71204761263407058314e3, 8.81952221241769090411e2,
    2.98635138197400131132e2, 6.61191906371416294775e1, 8.88314979438837594118, 5.64188496988670089180e-1,
    2.15311535474403846343e-8,
]
_ERFC_Q = [
    1.23033935480374942043e3, 3.43936767414372163696e3, 4.36261909014324715820e3, 3.29079923573345962678e3,
    1.62138957456669018874e3, 5.37181101862009857509e2, 1.17693950891312499305e2, 1.57449261107098347253e1, 1.0,
]
_TAIL_P = [-6.58749161529837803157e-4, -1.60837851487422766278e-2, -1.25781726111229246204e-1, -3.60344899949804439429e-1, -3.05326634961232344035e-1, -1.63153871373020978498e-2]
_TAIL_Q = [2.33520497626869185443e-3, 6.05183413124413191178e-2, 5.27905102951428412248e-1, 1.87295284992346725209, 2.56852019228982242072, 1.0]


def _poly(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function of a column, in the JVM."""
    y = F.abs(x)
    y2 = y * y
    inv2 = 1 / F.greatest(y2, F.lit(1e-300))
    small = 1 - y * _poly(_ERF_P, y2) / _poly(_ERF_Q, y2)
    middle = F.exp(-y2) * _poly(_ERFC_P, y) / _poly(_ERFC_Q, y)
    far = F.exp(-y2) / F.greatest(y, F.lit(1.0)) * (
        1 / math.sqrt(math.pi) + inv2 * _poly(_TAIL_P, inv2) / _poly(_TAIL_Q, inv2)
    )
    upper = F.when(y <= 0.46875, small).when(y <= 4.0, middle).when(y > 27.0, F.lit(0.0)).otherwise(far)
    return F.when(x < 0, 2 - upper).otherwise(upper)


def normal_cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2)) / 2


def normal_two_sided(x: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return erfc(F.abs(x) / math.sqrt(2))


# MacKinnon's response surfaces for the unit-root test with a
# constant (1994 p-values, 2010 critical values), coefficients by rising power.
ADF_P_LOW = [2.1659, 1.4412, 0.038269]
ADF_P_HIGH = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_P_SWITCH, ADF_P_MIN, ADF_P_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {
    "crit_1": [-3.43035, -6.5393, -16.786, -79.433],
    "crit_5": [-2.86154, -2.8903, -4.234, -40.040],
    "crit_10": [-2.56677, -1.5384, -2.809, 0.0],
}


def adf_p_value(tau: Column) -> Column:
    z = F.when(tau <= ADF_P_SWITCH, _poly(ADF_P_LOW, tau)).otherwise(_poly(ADF_P_HIGH, tau))
    return F.when(tau > ADF_P_MAX, F.lit(1.0)).when(tau < ADF_P_MIN, F.lit(0.0)).otherwise(normal_cdf(z))


def adf_critical(n_obs: Column) -> dict[str, Column]:
    return {name: _poly(coefs, 1 / n_obs) for name, coefs in ADF_CRITICAL.items()}
