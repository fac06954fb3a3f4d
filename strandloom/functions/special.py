"""Distribution functions: the normal quantile as a Column, tails of t, beta and the normal over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of Wichura's rational approximations (algorithm AS 241), lowest power first.
CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
          (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
MIDDLE = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
          (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
       (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def ratio(parts: tuple, x: Column) -> Column:
    def value(coefficients):
        out = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            out = out * x + F.lit(c)
        return out

    return value(parts[0]) / value(parts[1])


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile; null outside (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, ratio(MIDDLE, r - 1.6)).otherwise(ratio(FAR, r - 5.0))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, F.lit(0.180625) - q * q)).otherwise(tail))


def log_gamma(x: np.ndarray) -> np.ndarray:
    own, back = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in own])[back].reshape(np.shape(x))


def beta_cdf(x, a, b) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    x = np.clip(x, 0.0, 1.0)
    turn = x > (a + 1) / (a + b + 2)
    y, c, d = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(c * np.log(y) + d * np.log1p(-y) - np.log(c) - (log_gamma(c) + log_gamma(d) - log_gamma(c + d)))
    small = 1e-300
    f, num, den = np.ones_like(y), np.ones_like(y), np.zeros_like(y)
    for k in range(400):
        m = k // 2
        step = 1.0 if k == 0 else m * (d - m) * y / ((c + 2 * m - 1) * (c + 2 * m)) if k % 2 == 0 else -(c + m) * (c + d + m) * y / ((c + 2 * m) * (c + 2 * m + 1))
        den = 1 + step * den
        den = 1 / np.where(np.abs(den) < small, small, den)
        num = 1 + step / num
        num = np.where(np.abs(num) < small, small, num)
        f = f * num * den
        if np.all(np.abs(num * den - 1) < 1e-14):
            break
    out = np.where(y > 0, front * (f - 1), 0.0)
    return np.where(turn, 1 - out, out)


def beta_quantile(p, a, b) -> np.ndarray:
    """Where beta_cdf reaches p, by halving."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, a, b)))
    lo, hi = np.full(p.shape, -700.0), np.zeros(p.shape)
    for _ in range(70):  # on a log scale: small quantiles keep their digits
        mid = (lo + hi) / 2
        low = beta_cdf(np.exp(mid), a, b) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return np.where(p <= 0, 0.0, np.where(p >= 1, 1.0, np.exp((lo + hi) / 2)))


def t_two_sided(t, dof) -> np.ndarray:
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return beta_cdf(dof / (dof + t * t), dof / 2, 0.5)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t; null for a null t."""
    return pd.Series(np.where(t.isna(), np.nan, t_two_sided(t.fillna(0), dof.fillna(1)))).where(t.notna().to_numpy(), None)


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal; null for null."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


def t_quantile(p, dof) -> np.ndarray:
    """Where Student's t has the share p below it."""
    p, dof = np.broadcast_arrays(np.asarray(p, float), np.asarray(dof, float))
    x = beta_quantile(2 * np.minimum(p, 1 - p), dof / 2, 0.5)
    with np.errstate(divide="ignore"):
        return np.sign(p - 0.5) * np.sqrt(dof * (1 - x) / x)


@F.pandas_udf(DoubleType())
def beta_below(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The beta distribution's share below x; null for a null x."""
    return pd.Series(beta_cdf(x.fillna(0), a, b)).where(x.notna().to_numpy(), None)


@F.pandas_udf(DoubleType())
def beta_at(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The beta quantile of p."""
    return pd.Series(beta_quantile(p, a, b))


# where filters on p are not moved into its arguments
t_pvalue_once = F.pandas_udf(t_pvalue.func, DoubleType()).asNondeterministic()
