"""Training-window winsoriser and scaler as joins with small threshold tables."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles

# Clipped features, quantiles and the least finite values to fit on.
WINSOR_FEATURES = ["log_return_t", "cum_log_return_7d", "cum_log_return_14d", "cum_log_return_21d", "realized_vol_14d",
                   "volume_diff", "log_market_cap_lag1", "log1p_post_count"]
WINSOR_Q = (0.005, 0.995)
WINSOR_MIN = 20


def winsor_thresholds(train: DataFrame, features, fold="fold") -> DataFrame:
    """Clip limits per (fold, ticker, feature): the ticker's own where it has enough values, else the pooled ones.

    A ticker's values in a window are bounded by the calendar, so the built-in percentile fits; the pooled
    limits span all tickers and use the distributed one.
    """
    use = [f for f in features if f in WINSOR_FEATURES]
    long = train.select(fold, "ticker", *use).unpivot([fold, "ticker"], use, "feature", "v").where(F.col("v").isNotNull())
    own = long.groupBy(fold, "ticker", "feature").agg(
        F.count("v").alias("n"), F.percentile("v", F.array(*[F.lit(q) for q in WINSOR_Q])).alias("_q"))
    pool = percentiles(long, [fold, "feature"], "v", WINSOR_Q, ["_plo", "_phi"])
    n = long.groupBy(fold, "feature").agg(F.count("v").alias("_pn"))
    j = own.join(pool, [fold, "feature"]).join(n, [fold, "feature"])
    enough, pooled = F.col("n") >= WINSOR_MIN, F.col("_pn") >= WINSOR_MIN
    return j.select(
        fold, "ticker", "feature", "n",
        F.when(enough, F.col("_q")[0]).when(pooled, F.col("_plo")).alias("lower"),
        F.when(enough, F.col("_q")[1]).when(pooled, F.col("_phi")).alias("upper"),
        F.when(enough, "ticker").when(pooled, "pooled").otherwise("passthrough_insufficient_pooled").alias("rule"))


def winsorise(df: DataFrame, thresholds: DataFrame, features, fold="fold") -> DataFrame:
    """Clip with frozen limits; rows without limits pass through."""
    use = [f for f in features if f in WINSOR_FEATURES]
    wide = thresholds.groupBy(fold, "ticker").agg(*[
        x for f in use for x in (F.max(F.when(F.col("feature") == f, F.col("lower"))).alias(f"_lo_{f}"),
                                 F.max(F.when(F.col("feature") == f, F.col("upper"))).alias(f"_hi_{f}"))])
    j = df.join(wide, [fold, "ticker"], "left")
    cols = {f: F.when(F.col(f).isNotNull() & F.col(f"_lo_{f}").isNotNull(),
                      F.greatest(F.least(F.col(f), F.col(f"_hi_{f}")), F.col(f"_lo_{f}"))).otherwise(F.col(f)) for f in use}
    return j.withColumns(cols).drop(*[f"_{s}_{f}" for f in use for s in ("lo", "hi")])


def standardise(train: DataFrame, df: DataFrame, features, fold="fold") -> DataFrame:
    """Centre and scale with the training mean and population deviation; a constant feature is only centred."""
    st = train.groupBy(fold).agg(*[x for f in features for x in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    j = df.join(st, fold)
    scale = {f: F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0) for f in features}
    return j.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / scale[f] for f in features}) \
        .drop(*[f"_{s}_{f}" for f in features for s in ("m", "s")])


def ticker_effects(train: DataFrame, df: DataFrame, fold="fold") -> DataFrame:
    """Index of each row's ticker among the fold's sorted training tickers; the first one, and unseen ones,
    are the reference (index 0). One row per listed instrument is ranked."""
    t = train.select(fold, "ticker").distinct()
    names = t.groupBy(fold).agg(F.array_sort(F.collect_set("ticker")).alias("_names"))
    idx = names.select(fold, F.posexplode("_names").alias("ticker_effect", "ticker"))
    return df.join(idx, [fold, "ticker"], "left").fillna(0, ["ticker_effect"])


def any_null(columns):
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
