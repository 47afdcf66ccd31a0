"""Volatility and size regimes, their as-of attachment and the stratified tables."""
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import GROUP_KEYS
from ..functions.numeric import brier, clean, ratio
from ..functions.times import DAY_MICROS, micros
from .asof import asof_join
from .metrics import metric_columns, outcome_counts
from .quantiles import tercile, with_value_position
from .sequence import sliding

VOL_WINDOW, VOL_MIN = 14, 7
VOL_LABELS = ("low", "mid", "high")
SIZE_LABELS = ("small", "mid", "large")


def garman_klass(ohlc: DataFrame) -> DataFrame:
    hl, co = F.ln(F.try_divide("high", "low")), F.ln(F.try_divide("close", "open"))
    return ohlc.withColumn("gk_var", clean(0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co))


def volatility_lookup(ohlc: DataFrame) -> DataFrame:
    """Daily tercile of lagged volatility per ticker, with the instant it is known.

    The volatility of a day averages the 14 rows before it; the cut points use the ticker's whole
    series, as the published tables do, so they look ahead although the value itself does not.
    """
    v = F.col("gk_var")

    def rolled(w):
        f = w.rowsBetween(-VOL_WINDOW, -1)
        return F.when(F.count(v).over(f) >= VOL_MIN, F.avg(v).over(f))

    vol = sliding(garman_klass(ohlc).select("ticker", "date", "gk_var"), ["ticker"], "date", {"vol": rolled},
                  before=VOL_WINDOW)
    ranked = with_value_position(vol, ["ticker"], "vol", ["date"])
    known = ranked.withColumn("regime", tercile("_pos", "_n", VOL_LABELS)).drop("_pos", "_n")
    return known.withColumns({"regime_source_date": F.col("date") - F.expr("INTERVAL 1 DAY"),
                              "regime_available_at": F.col("date")})


def lagged_caps(caps: DataFrame) -> DataFrame:
    return sliding(caps.select("ticker", "date", "market_cap"), ["ticker"], "date",
                   {"market_cap_lag": lambda w: F.lag("market_cap").over(w)}, before=1)


def size_lookup(caps: DataFrame, universe: DataFrame = None) -> DataFrame:
    """Daily cross-sectional tercile of the previous market value, within the universe.

    A day's cross-section has one row per instrument; days with fewer than three distinct positive
    values get no regime.
    """
    rows = caps.join(universe.select("ticker"), "ticker", "left_semi") if universe is not None else caps
    x = lagged_caps(rows).where(F.col("market_cap_lag") > 0)
    per = W.partitionBy("date")
    k = F.row_number().over(per.orderBy("market_cap_lag", "ticker")) - 1
    v = F.col("market_cap_lag")
    x = x.withColumns({"_k": k, "_n": F.count(F.lit(1)).over(per), "_lo": F.min(v).over(per), "_hi": F.max(v).over(per)})
    # three distinct values: something lies strictly between the smallest and the largest
    x = x.withColumn("_mid", F.max((v > F.col("_lo")) & (v < F.col("_hi"))).over(per))
    x = x.where((F.col("_n") >= 3) & F.col("_mid")).withColumn("mcap_regime", tercile("_k", "_n", SIZE_LABELS))
    return x.select("ticker", "date", "market_cap_lag", "mcap_regime",
                    (F.col("date") - F.expr("INTERVAL 1 DAY")).alias("regime_source_date"),
                    F.col("date").alias("regime_available_at"))


def attach_regime(signals: DataFrame, lookup: DataFrame, regime, prefix) -> DataFrame:
    """The last regime available strictly before each forecast.

    Many runs share a (ticker, time), so the as-of join runs on the distinct pairs and the result
    returns to the forecasts by an equi-join.
    """
    at = signals.select("ticker", "timestamp").distinct()
    vals = [regime, "regime_source_date", "regime_available_at"]
    hit = asof_join(at, lookup.select("ticker", *vals), "ticker", "timestamp", "regime_available_at", vals)
    hit = hit.withColumns({
        f"{prefix}_regime_lag_days": (micros("timestamp") - micros("regime_available_at")) / float(DAY_MICROS)}) \
        .withColumnsRenamed({"regime_source_date": f"{prefix}_regime_source_date",
                             "regime_available_at": f"{prefix}_regime_available_at"})
    return signals.join(hit, ["ticker", "timestamp"], "left")


def attach_both(signals: DataFrame, vol: DataFrame, size: DataFrame) -> DataFrame:
    v = vol.withColumnRenamed("regime", "vol_regime")
    return attach_regime(attach_regime(signals, v, "vol_regime", "vol"), size, "mcap_regime", "mcap")


def _spine(df, keys, **regimes):
    """Every group with every regime label."""
    out = df.groupBy(*keys).agg(F.max("category").alias("category"))
    for name, labels in regimes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))
    return out


def volatility_table(with_regime: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    """Accuracy and Brier by volatility regime; intraday rows are first averaged per ticker and day."""
    keys = list(keys)
    rows = with_regime.withColumns({
        "date": F.to_date("timestamp"), "_ok": (F.col("prediction") == F.col("target")).cast("int"),
        "_sq": brier("target", F.col("probability"))})
    daily = rows.where(F.col("vol_regime").isNotNull()).groupBy(*keys, "vol_regime", "ticker", "date").agg(
        F.sum("_ok").alias("ok"), F.sum("_sq").alias("sq"), F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    day = F.max(F.col("horizon") == "1d")
    g = daily.groupBy(*keys, "vol_regime").agg(
        F.when(day, ratio(F.sum("ok"), n)).otherwise(F.avg(F.col("ok") / F.col("n"))).alias("accuracy"),
        F.when(day, ratio(F.sum("sq"), n)).otherwise(F.avg(F.col("sq") / F.col("n"))).alias("brier_score"),
        n.alias("n_obs"), F.count(F.lit(1)).alias("n_days"))
    return _spine(with_regime, keys, vol_regime=VOL_LABELS).join(g, [*keys, "vol_regime"], "left") \
        .fillna(0, ["n_obs", "n_days"])


def _stratified(df, keys, regimes):
    g = df.dropna(subset=list(regimes)).withColumn("date", F.to_date("timestamp")).groupBy(*keys, *regimes).agg(
        *outcome_counts(), F.count(F.lit(1)).alias("n_obs"), F.count_distinct("date").alias("n_days"),
        F.count_distinct("ticker").alias("n_tickers"))
    m = metric_columns(balanced_single=False)
    return g.select(*keys, *regimes, "n_obs", "n_days", "n_tickers", *[
        m[c].alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "brier_score")])


def size_table(with_regime: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    keys = list(keys)
    return _spine(with_regime, keys, mcap_regime=SIZE_LABELS).join(
        _stratified(with_regime, keys, ["mcap_regime"]), [*keys, "mcap_regime"], "left") \
        .fillna(0, ["n_obs", "n_days", "n_tickers"])


def interaction_table(with_both: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    keys, r = list(keys), ["mcap_regime", "vol_regime"]
    g = _stratified(with_both, keys, r).drop("balanced_accuracy", "precision", "recall", "f1")
    return _spine(with_both, keys, mcap_regime=SIZE_LABELS, vol_regime=VOL_LABELS).join(g, [*keys, *r], "left") \
        .fillna(0, ["n_obs", "n_days", "n_tickers"]) \
        .withColumn("interaction", F.concat_ws("_", *r))


def regime_lag_summary(joined: DataFrame, keys, regime, prefix) -> DataFrame:
    """How old the attached regimes are; lags are grid differences, so the exact median stays small."""
    lag, hit = F.col(f"{prefix}_regime_lag_days"), F.col(regime).isNotNull()
    lag = F.when(hit, lag)
    return joined.groupBy(*keys).agg(
        (1.0 - ratio(F.count_if(hit), F.count(F.lit(1)))).alias("share_unmatched_regime"),
        F.median(lag).alias("median_regime_lag_days"), F.min(lag).alias("min_regime_lag_days"),
        F.max(lag).alias("max_regime_lag_days"), F.avg((lag > 1.0).cast("int")).alias("share_regime_lag_gt_1_day"))
