"""Bar-series features. A row t describes [t, t+h); every window counts rows, never time."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean, log_ratio
from ..functions.times import BARS_PER_DAY, utc
from .asof import asof_join
from .sequence import sliding

# Window lengths in days and the publication lag of a daily market value.
RETURN_DAYS = (7, 14, 21)
VOL_DAYS = 14
AVAILABILITY_DAYS = 1

PRICE_FEATURES = ["log_return_t", "cum_log_return_7d", "cum_log_return_14d", "cum_log_return_21d",
                  "realized_vol_14d", "volume_diff", "log_market_cap_lag1"]


def market_cap_series(caps: DataFrame) -> DataFrame:
    """Positive daily market values with the instant each becomes known (source date + 1 day)."""
    d = F.date_trunc("day", F.col("date").cast("timestamp")).cast("timestamp_ntz")
    mc = clean("market_cap")
    return (
        caps.select("ticker", utc(d).alias("market_cap_source_date"), mc.alias("market_cap"))
        .where(F.col("market_cap") > 0)
        .withColumn("market_cap_available_at",
                    F.col("market_cap_source_date") + F.expr(f"INTERVAL {AVAILABILITY_DAYS} DAY"))
        .withColumn("log_market_cap_lag1", F.ln("market_cap"))
    )


def return_windows(bars: DataFrame, horizon, keys=("ticker",)) -> DataFrame:
    """Log return, volume change, 7/14/21-day returns, 14-day volatility, next-bar target."""
    bpd = BARS_PER_DAY[horizon]
    r = F.col("log_return_t")

    def full(n, agg):
        return lambda w: F.when(F.count(r).over(w.rowsBetween(1 - n, 0)) == n, agg(r).over(w.rowsBetween(1 - n, 0)))

    cols = {
        "log_return_t": lambda w: log_ratio(F.col("close"), F.lag("close").over(w)),
        "volume_diff": lambda w: clean(F.col("volume") - F.lag("volume").over(w)),
    }
    for d in RETURN_DAYS:
        cols[f"cum_log_return_{d}d"] = full(d * bpd, F.sum)
    cols["realized_vol_14d"] = full(VOL_DAYS * bpd, F.stddev_samp)
    nxt = F.lead(r)
    cols["target"] = lambda w: F.when(nxt.over(w) < 0, 0).when(nxt.over(w).isNotNull(), 1)
    return sliding(bars, list(keys), "timestamp", cols, before=max(RETURN_DAYS) * bpd + 1, after=1)


def price_features(bars: DataFrame, caps: DataFrame, horizon, drop_incomplete=True) -> DataFrame:
    """The price side of the final matrix: windows plus the market value known strictly before t.

    Both inputs are read more than once; pass stored tables (or ``reuse`` them first).
    """
    win = return_windows(bars.select("ticker", "timestamp", "close", "volume"), horizon)
    out = asof_join(win, market_cap_series(caps), "ticker", "timestamp", "market_cap_available_at",
                    ["market_cap_source_date", "market_cap_available_at", "log_market_cap_lag1"],
                    tie="market_cap_source_date", left_times=bars)
    out = out.select(
        "timestamp", F.to_date("timestamp").alias("date"), "ticker", F.lit(horizon).alias("horizon"), "target",
        *PRICE_FEATURES, "market_cap_source_date", "market_cap_available_at")
    if drop_incomplete:
        out = out.dropna(subset=["target", *PRICE_FEATURES]).withColumn("target", F.col("target").cast("byte"))
    return out


def feature_build_report(bars: DataFrame, features: DataFrame, horizon) -> DataFrame:
    """Input and output rows per ticker of the price-feature build."""
    a = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_input_rows"))
    b = features.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_output_rows"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"), F.avg("target").alias("share_positive_target"))
    out = F.coalesce(F.col("n_output_rows"), F.lit(0))
    return a.join(b, "ticker", "left").select(
        "ticker", F.lit(horizon).alias("horizon"),
        F.when(out > 0, "ok").otherwise("empty_after_feature_na_drop").alias("status"),
        "n_input_rows", out.alias("n_output_rows"), (F.col("n_input_rows") - out).alias("n_dropped_rows"),
        "first_timestamp", "last_timestamp", "share_positive_target")


def forward_returns(closes: DataFrame, keys=("ticker",)) -> DataFrame:
    """Log return of the bar after t."""
    return sliding(closes, list(keys), "timestamp", {
        "forward_log_return": lambda w: log_ratio(F.lead("close").over(w), F.col("close"))}, before=0, after=1)


def rolling_stats(df: DataFrame, keys, ts, value, window, min_count=None) -> DataFrame:
    """Trailing mean and sample deviation over a number of rows."""
    m = min_count or window
    v = F.col(value)

    def full(agg):
        return lambda w: F.when(F.count(v).over(w.rowsBetween(1 - window, 0)) >= m, agg(v).over(w.rowsBetween(1 - window, 0)))

    return sliding(df, keys, ts, {"rolling_mean": full(F.avg), "rolling_std": full(F.stddev_samp)}, before=window)


def centred_mean(df: DataFrame, keys, ts, value, half) -> DataFrame:
    """Mean over the row and ``half`` rows on either side, only where all of them exist."""
    n = 2 * half + 1
    v = F.col(value)
    return sliding(df, keys, ts, {"centred_mean": lambda w: F.when(
        F.count(v).over(w.rowsBetween(-half, half)) == n, F.avg(v).over(w.rowsBetween(-half, half)))},
        before=half, after=half)


