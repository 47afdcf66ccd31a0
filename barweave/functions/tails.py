"""Tail probabilities, evaluated in Arrow batches on (small) result tables."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def chi2_1_tail(x: pd.Series) -> pd.Series:
    """P(X > x) for one degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2.0)))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def incomplete_beta(a, b, x):
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * h


def student_two_sided(t, dof):
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    out = [None if (pd.isna(a) or pd.isna(v) or v <= 0) else student_two_sided(float(a), float(v))
           for a, v in zip(t, dof)]
    return pd.Series(out, dtype="float64")


def kolmogorov_tail(x):
    """Limit distribution of the two-sample KS statistic."""
    if x <= 0:
        return 1.0
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(min(max(2.0 * np.sum((-1.0) ** (k - 1) * np.exp(-2.0 * k * k * x * x)), 0.0), 1.0))


@F.pandas_udf(DoubleType())
def kolmogorov_p(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else kolmogorov_tail(float(v)))
