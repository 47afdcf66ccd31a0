"""Null-safe arithmetic. Missing is NULL everywhere; NaN and infinities never enter an aggregate."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import col

PROB_EPS = 1e-15


def clean(c) -> Column:
    """NaN and +-inf to NULL."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def ratio(a, b) -> Column:
    """a / b, NULL on a zero or missing denominator."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def log_ratio(a, b) -> Column:
    """ln(a / b), NULL unless the ratio is positive and finite."""
    return clean(F.ln(ratio(a, b)))


def pct_deviation(abs_dev, denominator) -> Column:
    return F.try_divide(F.abs(col(abs_dev)), F.abs(col(denominator))) * 100.0


def clip_prob(p, eps=PROB_EPS) -> Column:
    x = col(p)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0 - eps)), F.lit(eps)))


def log_loss(y, p, eps=PROB_EPS) -> Column:
    q = clip_prob(p, eps)
    yd = col(y).cast("double")
    return -(yd * F.ln(q) + (1.0 - yd) * F.ln(1.0 - q))


def brier(y, p) -> Column:
    d = col(p) - col(y).cast("double")
    return d * d


def _moment(c):
    return F.when(~F.isnan(col(c)), col(c))


def sample_skewness(n, pop_skew) -> Column:
    """Bias-corrected skewness from the population value: NULL below three values, 0 for a constant."""
    n, g = col(n).cast("double"), _moment(pop_skew)
    return F.when(n >= 3, F.coalesce(F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0) * g, F.lit(0.0)))


def sample_kurtosis(n, pop_kurt) -> Column:
    """Bias-corrected excess kurtosis from the population excess: NULL below four values, 0 for a constant."""
    n, g = col(n).cast("double"), _moment(pop_kurt)
    full = F.try_divide(n - 1.0, (n - 2.0) * (n - 3.0)) * ((n + 1.0) * g + 6.0)
    return F.when(n >= 4, F.coalesce(full, F.lit(0.0)))


def correlation(a, b) -> Column:
    """Pearson correlation aggregate over complete pairs; NULL when a side is constant."""
    x, y = col(a).cast("double"), col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def slope(y, x) -> Column:
    """Least-squares slope of y on x over complete pairs; NULL when x is constant."""
    a, b = col(x).cast("double"), col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.var_pop(a))
