"""Upper tails of the normal, Student, F and chi-square distributions.

Arrow-batched helpers over released statistics (a few numbers per released
table).  The incomplete beta and gamma functions use NumPy array recurrences.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# executors receive these helpers with the task, they need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
# A step that changes less than this has settled; the most steps of an
# expansion, over which its value is NaN; from this shape on the incomplete gamma
# function is taken from its uniform asymptotic form.
SETTLED, MOST_STEPS, LARGE_SHAPE = 1e-15, 1_000_000, 1e4


def _each(fn, x):
    x = np.asarray(x, dtype=float)
    return np.array([fn(v) for v in x.ravel()], dtype=float).reshape(x.shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _erfc(x):
    return _each(math.erfc, x)


def _lentz(first, terms):
    """Modified Lentz evaluation of first + a1/(b1 + a2/(b2 + …)) over arrays.

    Runs until every element has settled; one that has not after ``MOST_STEPS``
    is NaN.
    """
    f = np.where(np.abs(first) < _TINY, _TINY, first)
    c, d = f.copy(), np.zeros_like(f)
    moving = np.ones(f.shape, bool)
    for i in range(1, MOST_STEPS + 1):
        a, b = terms(i)
        d = b + a * d
        d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + a / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        f = np.where(moving, f * c * d, f)
        moving &= np.abs(c * d - 1) > SETTLED
        if not moving.any():
            break
    return np.where(moving, np.nan, f)


def beta_regularised(x, a, b):
    """I_x(a, b) elementwise, by whichever tail of the fraction converges fast."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, a, b)))
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    xs, aa, bb = np.where(inside, x, 0.5), np.where(inside, a, 1.0), np.where(inside, b, 1.0)
    swap = xs > (aa + 1) / (aa + bb + 2)
    p, q, z = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xs, xs)

    def terms(i):
        m = i // 2
        if i % 2:
            num = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        else:
            num = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        return num, np.ones_like(z)

    # 1 + d1/(1 + d2/(1 + …)); the function is prefactor / fraction
    fraction = _lentz(np.ones_like(z), terms)
    log_front = (_lgamma(p + q) - _lgamma(p) - _lgamma(q)
                 + p * np.log(z) + q * np.log1p(-z) - np.log(p))
    tail = np.exp(log_front) / fraction
    out = np.where(swap, 1 - tail, tail)
    out = np.where(inside, out, np.where(x <= 0, 0.0, 1.0))
    return np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, np.clip(out, 0, 1))


def _gamma_upper_large(s, z):
    """Q(s, z) for large s: a normal tail in a stretched variable, with two correction terms."""
    ratio = z / s
    off = ratio - 1
    stretch = np.sign(off) * np.sqrt(2 * np.maximum(off - np.log(ratio), 0))
    near = np.abs(stretch) < 0.05
    away, e = np.where(near, 1.0, off), np.where(near, 1.0, stretch)
    one = np.where(near, -1 / 3 + stretch / 12 - 2 * stretch ** 2 / 135 + stretch ** 3 / 864, 1 / away - 1 / e)
    two = np.where(near, -1 / 540 - stretch / 288, 1 / e ** 3 - 1 / away ** 3 - 1 / away ** 2 - 1 / (12 * away))
    rest = np.exp(-s * stretch ** 2 / 2) / np.sqrt(2 * np.pi * s) * (one + two / s)
    return 0.5 * _erfc(stretch * np.sqrt(s / 2)) + rest


def gamma_upper(a, x):
    """Q(a, x): series below a + 1, continued fraction above, asymptotic form for large a."""
    a, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, x)))
    ok = (a > 0) & (x > 0) & np.isfinite(a) & np.isfinite(x)
    large = ok & (a >= LARGE_SHAPE)
    s, z = np.where(ok & ~large, a, 1.0), np.where(ok & ~large, x, 1.0)
    front = np.exp(s * np.log(z) - z - _lgamma(s))
    low = np.minimum(z, s + 1)                    # keep the series where it converges
    term = 1 / s
    total = term.copy()
    for k in range(1, MOST_STEPS + 1):
        term = term * low / (s + k)
        total = total + term
        if (term <= SETTLED * total).all():
            break
    high = np.maximum(z, s + 1)
    fraction = _lentz(high + 1 - s, lambda i: (-i * (i - s), high + 2 * i + 1 - s))
    out = np.where(z < s + 1, 1 - front * total, front / fraction)
    out = np.where(large, _gamma_upper_large(np.where(large, a, 1.0), np.where(large, x, 1.0)), out)
    out = np.where(ok, np.clip(out, 0, 1), np.where((x == 0) & (a > 0), 1.0, np.nan))
    return out


def normal_upper(z):
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2.0))


def student_upper(t, df):
    t, df = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (t, df)))
    ok = np.isfinite(t) & (df > 0)
    tt, dd = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    half = 0.5 * beta_regularised(dd / (dd + tt * tt), dd / 2, 0.5)
    return np.where(ok, np.where(tt >= 0, half, 1 - half), np.nan)


def f_upper(f, df1, df2):
    f, m, n = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, df1, df2)))
    ok = np.isfinite(f) & (m > 0) & (n > 0)
    ff, mm, nn = np.where(ok, f, 1.0), np.where(ok, m, 1.0), np.where(ok, n, 1.0)
    out = beta_regularised(nn / (nn + mm * np.maximum(ff, 0)), nn / 2, mm / 2)
    return np.where(ok, np.where(ff <= 0, 1.0, out), np.nan)


def chi2_upper(x, df):
    x, df = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (x, df)))
    ok = np.isfinite(x) & (df > 0)
    out = gamma_upper(np.where(ok, df, 1.0) / 2, np.where(ok, np.maximum(x, 0), 1.0) / 2)
    return np.where(ok, np.where(x <= 0, 1.0, out), np.nan)


def pearson_two_sided(r, n):
    """Two-sided p-value of a correlation r over n observations."""
    r, n = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (r, n)))
    ok = np.isfinite(r) & (n >= 3)
    rr, nn = np.where(ok, np.minimum(np.abs(r), 1.0), 0.0), np.where(ok, n, 3.0)
    out = beta_regularised(1 - rr * rr, (nn - 2) / 2, 0.5)
    return np.where(ok, np.where(rr >= 1, 0.0, out), np.nan)


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_upper(z))


@F.pandas_udf(DoubleType())
def student_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_upper(t, df))


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, df1, df2))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x, df))


@F.pandas_udf(DoubleType())
def beta_inc(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_regularised(x, a, b))


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(pearson_two_sided(r, n))
