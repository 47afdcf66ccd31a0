"""Long/short portfolio backtests: legs, turnover, costs, performance."""
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import GROUP_KEYS
from ..functions.numeric import ratio
from ..functions.times import DAY_MICROS, micros
from ..session import reuse
from .sequence import keep_last, running, sliding, with_position

# Leg quantiles, smallest leg, cost grid (basis points), thresholds, days per year.
LONG_Q, SHORT_Q, MIN_LEG = 0.8, 0.2, 1
COSTS = (0.0, 5.0, 10.0)
LEG_THRESHOLDS = (0.55, 0.60, 0.65)
YEAR_DAYS = 365


def signals_with_returns(signals: DataFrame, returns: DataFrame, order="probability", keys=GROUP_KEYS) -> DataFrame:
    """Forward return of each forecast: matched by day at 1d, by exact time intraday; the last duplicate counts."""
    def at(df):
        day = F.date_trunc("day", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
        return df.withColumn("_at", F.when(F.col("horizon") == "1d", day).otherwise(F.col("timestamp")))
    s = at(signals).drop("forward_log_return")
    s = keep_last(s, [*keys, "ticker", "_at"], [order, "prediction"])
    r = at(returns.select("horizon", "ticker", "timestamp", "forward_log_return")).groupBy("horizon", "ticker", "_at").agg(
        F.max_by("forward_log_return", "timestamp").alias("forward_log_return"))
    return s.join(r, ["horizon", "ticker", "_at"], "left").drop("_at")


def duplicate_return_keys(returns: DataFrame) -> DataFrame:
    return returns.groupBy("horizon", "ticker", "timestamp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def quantile_legs(merged: DataFrame, keys, long_q=LONG_Q, short_q=SHORT_Q, min_leg=MIN_LEG) -> DataFrame:
    """Side of every asset per (group, time): top and bottom quantile, ends included.

    When the two legs would share an asset the cross-section is split by rank instead. A cross-section
    holds one row per instrument.
    """
    keys = list(keys)
    v = merged.dropna(subset=["forward_log_return", "probability"])
    w = W.partitionBy(*keys, "timestamp")
    v = v.withColumns({"_q": F.percentile("probability", F.array(F.lit(long_q), F.lit(short_q))).over(w),
                       "_n": F.count(F.lit(1)).over(w)})
    v = v.withColumns({"_long": F.col("probability") >= F.col("_q")[0], "_short": F.col("probability") <= F.col("_q")[1],
                       "_rank": F.row_number().over(w.orderBy(F.col("probability").desc(), "ticker"))})
    v = v.withColumns({"_clash": F.max(F.col("_long") & F.col("_short")).over(w),
                       "_nl": F.count_if("_long").over(w), "_ns": F.count_if("_short").over(w)})
    n = F.col("_n")
    nl = F.least(F.greatest("_nl", F.lit(min_leg)), n)
    ns = F.when(nl < n, F.least(F.greatest("_ns", F.lit(min_leg)), n - nl)).otherwise(0)
    long = F.when(F.col("_clash"), F.col("_rank") <= nl).otherwise(F.col("_long"))
    short = F.when(F.col("_clash"), F.col("_rank") > n - ns).otherwise(F.col("_short"))
    return _sided(v, keys, long, short)


def threshold_legs(merged: DataFrame, keys, thresholds=LEG_THRESHOLDS) -> DataFrame:
    """Long above the threshold, short below its mirror, per threshold."""
    v = merged.dropna(subset=["forward_log_return", "probability"])
    th = F.array(*[F.lit(float(t)) for t in thresholds])
    v = v.withColumn("threshold", F.explode(th))
    p = F.col("probability")
    return _sided(v, [*keys, "threshold"], p > F.col("threshold"), p < 1.0 - F.col("threshold"))


def _sided(v, keys, long, short):
    side = F.when(long & short, 0).when(long, 1).when(short, -1)
    return v.withColumn("side", side).where(F.col("side").isNotNull() & (F.col("side") != 0)) \
        .select(*keys, "timestamp", "ticker", "side", "forward_log_return")


def weigh(legs: DataFrame, keys, min_leg=MIN_LEG, single_leg=False) -> DataFrame:
    """Equal weights +1/n and -1/n; times that lack a leg are inactive."""
    keys = list(keys)
    w = W.partitionBy(*keys, "timestamp")
    x = legs.withColumns({"_nl": F.count_if(F.col("side") == 1).over(w), "_ns": F.count_if(F.col("side") == -1).over(w)})
    l, s = F.col("_nl") >= min_leg, F.col("_ns") >= min_leg
    x = x.where((l | s) if single_leg else (l & s))
    return x.select(*keys, "timestamp", "ticker", "forward_log_return", "side",
                    F.when(F.col("side") == 1, 1.0 / F.col("_nl")).otherwise(-1.0 / F.col("_ns")).alias("weight"))


def portfolio(weights: DataFrame, keys) -> DataFrame:
    """Per active time: gross return, leg sizes and turnover against the active time before it.

    Turnover needs no self-join: each holding is also booked, negated, at the next active time, and
    the absolute net changes are summed.
    """
    keys = list(keys)
    weights = reuse(weights)
    per = weights.groupBy(*keys, "timestamp").agg(
        F.sum(F.col("weight") * F.col("forward_log_return")).alias("gross_log_return"),
        F.count_if(F.col("side") == 1).alias("long_n"), F.count_if(F.col("side") == -1).alias("short_n"))
    idx = reuse(with_position(per, keys, "timestamp", name="_idx"))
    at = idx.select(*keys, "timestamp", "_idx")
    last = at.groupBy(*keys).agg(F.max("_idx").alias("_last"))
    held = weights.select(*keys, "timestamp", "ticker", "weight").join(at, [*keys, "timestamp"]).join(last, keys)
    moves = F.array(F.struct(F.col("_idx").alias("i"), F.col("weight").alias("w")),
                    F.struct((F.col("_idx") + 1).alias("i"), (-F.col("weight")).alias("w")))
    m = held.select(*keys, "_last", "ticker", F.explode(moves).alias("m")).where(F.col("m.i") <= F.col("_last"))
    turn = m.groupBy(*keys, F.col("m.i").alias("_idx"), "ticker").agg(F.sum("m.w").alias("_dw")) \
        .groupBy(*keys, "_idx").agg((F.sum(F.abs("_dw")) * 0.5).alias("turnover"))
    return reuse(idx.join(turn, [*keys, "_idx"]).drop("_idx"))


def with_costs(pf: DataFrame, costs=COSTS) -> DataFrame:
    grid = F.array(*[F.lit(float(c)) for c in costs])
    return pf.withColumn("cost_bps", F.explode(grid)).withColumn(
        "net_log_return", F.col("gross_log_return") - F.col("turnover") * F.col("cost_bps") / 1e4)


def with_drawdown(net: DataFrame, keys, value="net_log_return") -> DataFrame:
    """Fall of the equity curve below its own running maximum (no initial 1.0), row by row."""
    keys = list(keys)
    eq = running(net, keys, "timestamp", sums={"_cum": F.coalesce(F.col(value), F.lit(0.0))})
    pk = running(reuse(eq), keys, "timestamp", maxes={"_peak": F.exp("_cum")})
    return pk.withColumn("drawdown", F.exp("_cum") / F.col("_peak") - 1.0).drop("_cum", "_peak")


def drawdown(net: DataFrame, keys, value="net_log_return") -> DataFrame:
    """Deepest drawdown per series."""
    return with_drawdown(net.select(*keys, "timestamp", value), keys, value).groupBy(*keys).agg(
        F.min("drawdown").alias("max_drawdown"))


def _risk(net, keys, value="net_log_return", rf=0.0, extra=()):
    """Return, risk and ratio columns of one series per key, in one aggregation over its rows.

    The median's state is bounded by the calendar. With a risk-free rate the downside deviation needs
    the periods per year first, which costs a second pass.
    """
    keys = list(keys)
    r = F.col(value)
    n = F.count(r)
    days = (F.max(micros("timestamp")) - F.min(micros("timestamp"))) / float(DAY_MICROS)
    rows = with_drawdown(net, keys, value)
    if rf:
        rows = reuse(rows)
    g = rows.groupBy(*keys).agg(
        n.alias("n_periods"), days.alias("_days"), F.sum(r).alias("net_cumulative_log_return"), F.avg(r).alias("mean_return"),
        F.median(r).alias("median_return"), F.when(n > 1, F.stddev_samp(r)).alias("_std"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"), F.count_if(r > 0).alias("_hits"),
        F.min("drawdown").alias("max_drawdown"), *extra)
    g = g.withColumn("periods_per_year", F.when(F.col("_days") > 0, F.col("n_periods") / F.col("_days") * YEAR_DAYS))
    per = F.coalesce(ratio(F.lit(rf), "periods_per_year"), F.lit(0.0))
    if rf:
        ex = rows.select(*keys, r.alias("_r")).join(g.select(*keys, "periods_per_year"), keys).withColumn("_ex", F.col("_r") - per)
        g = g.drop("_down").join(ex.where(F.col("_ex") < 0).groupBy(*keys).agg(F.stddev_samp("_ex").alias("_down")), keys, "left")
    excess = F.col("mean_return") - per
    root = F.sqrt("periods_per_year")
    ann = F.col("mean_return") * F.col("periods_per_year")
    return g.withColumns({
        "net_cumulative_simple_return": F.expm1("net_cumulative_log_return"),
        "annualized_log_return": ann, "annualized_simple_return": F.expm1(ann),
        "annualized_volatility": F.col("_std") * root, "sharpe": ratio(excess, "_std") * root,
        "sortino": ratio(excess, "_down") * root, "hit_rate": ratio("_hits", "n_periods"),
        "calmar_ratio": F.when(F.col("max_drawdown") < 0, ratio(ann, F.abs("max_drawdown")))}) \
        .drop("_days", "_std", "_hits", "_down")


def performance(pf: DataFrame, keys, costs=COSTS, rf=0.0) -> DataFrame:
    """One row per (group, cost): returns, risk, ratios, drawdown and averages."""
    return _risk(with_costs(pf, costs), [*keys, "cost_bps"], rf=rf, extra=[
        F.sum("gross_log_return").alias("gross_cumulative_log_return"), F.avg("turnover").alias("turnover_avg"),
        F.avg(F.col("long_n") + F.col("short_n")).alias("n_assets_avg"), F.avg("long_n").alias("long_assets_avg"),
        F.avg("short_n").alias("short_assets_avg")])


def _coverage(perf, merged, keys):
    periods = merged.groupBy(*keys).agg(F.count_distinct("timestamp").alias("_all"), F.max("category").alias("category"))
    return perf.join(periods, list(keys)).withColumn("coverage", ratio("n_periods", "_all")).drop("_all")


def high_low_backtest(merged: DataFrame, keys=GROUP_KEYS, costs=COSTS) -> DataFrame:
    """Quantile long/short portfolio per group and cost."""
    keys = list(keys)
    pf = portfolio(weigh(quantile_legs(merged, keys), keys), keys)
    return _coverage(performance(pf, keys, costs), merged, keys)


def threshold_backtest(merged: DataFrame, keys=GROUP_KEYS, thresholds=LEG_THRESHOLDS, costs=COSTS) -> DataFrame:
    """Threshold long/short portfolio; a threshold that never trades keeps a row of zero periods."""
    keys = list(keys)
    tk = [*keys, "threshold"]
    pf = portfolio(weigh(threshold_legs(merged, keys, thresholds), tk), tk)
    perf = performance(pf, tk, costs)
    spine = merged.where(F.col("forward_log_return").isNotNull()).groupBy(*keys).agg(F.max("category").alias("category"))
    spine = spine.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))) \
        .withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    allp = merged.groupBy(*keys).agg(F.count_distinct("timestamp").alias("_all"))
    out = spine.join(perf, [*tk, "cost_bps"], "left").join(allp, keys)
    zero = ["n_periods", "n_assets_avg", "long_assets_avg", "short_assets_avg", "turnover_avg"]
    return out.fillna(0, zero).withColumn("coverage", ratio("n_periods", "_all")).drop("_all")


def ticker_backtest(merged: DataFrame, keys=GROUP_KEYS, costs=COSTS) -> DataFrame:
    """Sign-of-forecast position per ticker; half the absolute position change is the turnover."""
    tk = [*keys, "ticker"]
    v = merged.dropna(subset=["forward_log_return", "probability"]).select(
        *tk, "timestamp", (F.col("prediction") * 2 - 1).cast("double").alias("_pos_sign"), "forward_log_return")
    v = sliding(v, tk, "timestamp", {"turnover": lambda w: F.abs(
        F.col("_pos_sign") - F.coalesce(F.lag("_pos_sign").over(w), F.lit(0.0))) / 2.0}, before=1)
    v = v.withColumn("gross_log_return", F.col("_pos_sign") * F.col("forward_log_return"))
    net = with_costs(reuse(v), costs)
    ck = [*tk, "cost_bps"]
    return _risk(net, ck, extra=[F.avg("turnover").alias("turnover_avg")]).select(
        *ck, F.col("n_periods").alias("n_obs"), F.col("net_cumulative_log_return").alias("cumulative_log_return"),
        F.col("net_cumulative_simple_return").alias("cumulative_simple_return"), "sharpe", "max_drawdown", "turnover_avg", "hit_rate")


def buy_and_hold(returns: DataFrame, universe: DataFrame = None, costs=COSTS) -> DataFrame:
    """Equal weight over the assets available at each time."""
    r = returns.join(universe.select("ticker"), "ticker", "left_semi") if universe is not None else returns
    r = r.where(F.col("forward_log_return").isNotNull())
    keys = ["horizon"]
    w = W.partitionBy("horizon", "timestamp")
    held = r.withColumns({"weight": 1.0 / F.count(F.lit(1)).over(w), "side": F.lit(1)})
    pf = portfolio(held, keys)
    return performance(pf, keys, costs).withColumns({
        "set_id": F.lit("BUY_HOLD"), "model_type": F.lit("benchmark"), "portfolio_mode": F.lit("buy_and_hold")})


def benchmark_lifts(perf: DataFrame, benchmark="ECON") -> DataFrame:
    """Sharpe and return lift over the same family's benchmark row of the same cost."""
    fam = ["horizon", "cost_bps", "model_type", "panel_mode", "hpo_variant"]
    perf = reuse(perf)
    b = perf.where(F.col("set_id") == benchmark).select(
        *fam, F.col("sharpe").alias("_s"), F.col("net_cumulative_simple_return").alias("_r"))
    x = benchmark.lower()
    return perf.join(b, fam, "left").withColumns({
        f"sharpe_lift_vs_{x}": F.col("sharpe") - F.col("_s"),
        f"cumulative_return_lift_vs_{x}": F.col("net_cumulative_simple_return") - F.col("_r")}).drop("_s", "_r")


def backtest_diagnostics(merged: DataFrame, n_returns: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    """Counts and the gate each attempted group stopped at."""
    keys = list(keys)
    fr, pr = F.col("forward_log_return").isNotNull(), F.col("probability").isNotNull()
    g = merged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signal_rows"), F.count_distinct("timestamp").alias("n_unique_timestamps"),
        F.count_distinct("ticker").alias("n_unique_tickers"), F.count_if(fr).alias("n_joined_non_null_forward_returns"),
        F.count_if(fr & pr).alias("_valid"))
    pf = weigh(quantile_legs(merged, keys), keys).groupBy(*keys).agg(F.count_distinct("timestamp").alias("n_portfolio_periods"))
    j = g.join(pf, keys, "left").fillna(0, ["n_portfolio_periods"]).join(n_returns, "horizon", "left") \
        .fillna(0, ["n_forward_return_rows"])
    status = F.when(F.col("n_forward_return_rows") == 0, "skip_no_forward_returns") \
        .when(F.col("n_joined_non_null_forward_returns") == 0, "skip_zero_forward_matches") \
        .when(F.col("_valid") == 0, "skip_no_valid_probability") \
        .when(F.col("n_portfolio_periods") == 0, "skip_no_portfolio_periods").otherwise("ok")
    return j.withColumn("status", status).drop("_valid")
