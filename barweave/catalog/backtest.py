"""Portfolio backtests."""
from pyspark.sql import functions as F

from ..functions.identity import GROUP_KEYS
from ..operators import backtest as B
from ..operators import prices
from ..sources import standins as S
from .base import cte, query

G = "horizon, set_id, sentiment_model, model_type, panel_mode, hpo_variant"
GL = GROUP_KEYS

cte("fwd", """SELECT horizon, ticker, timestamp, ln(nullif(lead(close) OVER (PARTITION BY ticker ORDER BY timestamp) / nullif(close, 0), 0)) AS forward_log_return FROM bars_1d
UNION ALL SELECT horizon, ticker, timestamp, ln(nullif(lead(close) OVER (PARTITION BY ticker ORDER BY timestamp) / nullif(close, 0), 0)) FROM bars_6h""", "bars_1d", "bars_6h")
cte("merged", "SELECT s.*, f.forward_log_return FROM signals s LEFT JOIN fwd f USING (horizon, ticker, timestamp)", "signals", "fwd")


def returns(t):
    b = S.bars(t, "1d").unionByName(S.bars(t, "6h")).select("horizon", "ticker", "timestamp", "close")
    return prices.forward_returns(b, ["horizon", "ticker"]).select("horizon", "ticker", "timestamp", "forward_log_return")


def merged(t):
    return t.once("merged", lambda: B.signals_with_returns(S.signals(t), returns(t)))


@query("signals_with_returns", f"SELECT {G}, ticker, timestamp, probability, forward_log_return FROM merged", ["merged"],
       doubles="probability forward_log_return")
def _(t):
    return merged(t).select(*GL, "ticker", "timestamp", "probability", "forward_log_return")


cte("legs", f"""SELECT {G}, timestamp, ticker, forward_log_return, side FROM (
 SELECT *, CASE WHEN clash THEN CASE WHEN rk <= nl2 THEN 1 WHEN rk > n - ns2 THEN -1 END WHEN lg THEN 1 WHEN sh THEN -1 END AS side FROM (
 SELECT *, least(greatest(nl, 1), n) AS nl2, CASE WHEN least(greatest(nl, 1), n) < n THEN least(greatest(ns, 1), n - least(greatest(nl, 1), n)) ELSE 0 END AS ns2 FROM (
 SELECT *, bool_or(lg AND sh) OVER w AS clash, count(*) FILTER (lg) OVER w AS nl, count(*) FILTER (sh) OVER w AS ns,
  row_number() OVER (PARTITION BY {G}, timestamp ORDER BY probability DESC, ticker) AS rk FROM (
 SELECT *, probability >= quantile_cont(probability, 0.8) OVER w AS lg, probability <= quantile_cont(probability, 0.2) OVER w AS sh, count(*) OVER w AS n
 FROM merged WHERE forward_log_return IS NOT NULL WINDOW w AS (PARTITION BY {G}, timestamp)) WINDOW w AS (PARTITION BY {G}, timestamp)))) WHERE side IS NOT NULL""", "merged")


@query("quantile_legs", "SELECT * EXCLUDE (forward_log_return) FROM legs", ["legs"], longs="side")
def _(t):
    return B.quantile_legs(merged(t), GL).drop("forward_log_return")


def _weights(src, keys):
    return f"""SELECT {keys}, timestamp, ticker, forward_log_return, side, CASE WHEN side = 1 THEN 1.0 / nl ELSE -1.0 / ns END AS weight FROM (
SELECT *, count(*) FILTER (side = 1) OVER w AS nl, count(*) FILTER (side = -1) OVER w AS ns FROM {src} WINDOW w AS (PARTITION BY {keys}, timestamp)) WHERE nl >= 1 AND ns >= 1"""


def _portfolio(src, keys):
    return f"""SELECT * FROM (SELECT {keys}, timestamp, sum(weight * forward_log_return) AS gross_log_return, count(*) FILTER (side = 1) AS long_n,
 count(*) FILTER (side = -1) AS short_n, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp) AS idx FROM {src} GROUP BY {keys}, timestamp) JOIN (
SELECT {keys}, idx, 0.5 * sum(abs(dw)) AS turnover FROM (SELECT {keys}, idx, ticker, sum(w) AS dw FROM (
 SELECT {keys}, idx, ticker, weight AS w, last FROM {src}_i UNION ALL SELECT {keys}, idx + 1, ticker, -weight, last FROM {src}_i) WHERE idx <= last GROUP BY {keys}, idx, ticker) GROUP BY {keys}, idx)
 USING ({keys}, idx)"""


def _indexed(src, keys):
    return f"""SELECT *, max(idx) OVER (PARTITION BY {keys}) AS last FROM (SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY timestamp) AS idx FROM {src})"""


def _net(src, grid="(0.0), (5.0), (10.0)"):
    return f"SELECT *, gross_log_return - turnover * cost_bps / 1e4 AS net_log_return FROM {src} CROSS JOIN (VALUES {grid}) c(cost_bps)"


def _perf(src, keys, value="net_log_return"):
    """Performance columns of one series per (keys, cost)."""
    k = f"{keys}, cost_bps"
    return f"""SELECT *, mean_return * periods_per_year AS annualized_log_return, exp(mean_return * periods_per_year) - 1 AS annualized_simple_return,
 sd * sqrt(periods_per_year) AS annualized_volatility, mean_return / nullif(sd, 0) * sqrt(periods_per_year) AS sharpe,
 mean_return / nullif(dsd, 0) * sqrt(periods_per_year) AS sortino, CASE WHEN max_drawdown < 0 THEN mean_return * periods_per_year / abs(max_drawdown) END AS calmar_ratio,
 exp(net_cumulative_log_return) - 1 AS net_cumulative_simple_return
FROM (SELECT {k}, count(*) AS n_periods, count(*) * 1.0 / nullif((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0, 0) * 365 AS periods_per_year,
 sum({value}) AS net_cumulative_log_return, avg({value}) AS mean_return, median({value}) AS median_return, stddev_samp({value}) AS sd,
 stddev_samp({value}) FILTER ({value} < 0) AS dsd, count(*) FILTER ({value} > 0) * 1.0 / count(*) AS hit_rate,
 avg(turnover) AS turnover_avg, sum(gross_log_return) AS gross_cumulative_log_return, min(eq / pk - 1) AS max_drawdown{{extra}}
 FROM (SELECT *, max(eq) OVER (PARTITION BY {k} ORDER BY timestamp) AS pk FROM (SELECT *, exp(sum({value}) OVER (PARTITION BY {k} ORDER BY timestamp)) AS eq FROM {src})) GROUP BY {k})"""


AVG = ", avg(long_n + short_n) AS n_assets_avg, avg(long_n) AS long_assets_avg, avg(short_n) AS short_assets_avg"
cte("wq", _weights("legs", G), "legs")
cte("wq_i", _indexed("wq", G), "wq")
cte("pfq", _portfolio("wq", G), "wq_i")
cte("netq", _net("pfq"), "pfq")
cte("perfq", _perf("netq", G).format(extra=AVG), "netq")
cte("nper", f"SELECT {G}, count(DISTINCT timestamp) AS nall, max(category) AS category FROM signals GROUP BY {G}", "signals")

PERF = ("periods_per_year net_cumulative_log_return net_cumulative_simple_return:2 mean_return median_return hit_rate turnover_avg "
        "gross_cumulative_log_return max_drawdown annualized_log_return annualized_volatility sharpe sortino calmar_ratio")
PERF_ALL = PERF + " cost_bps n_assets_avg long_assets_avg short_assets_avg coverage"


def qpf(t):
    return B.portfolio(B.weigh(B.quantile_legs(merged(t), GL), GL), GL)


@query("portfolio_weights", f"SELECT {G}, timestamp, ticker, weight FROM wq", ["wq"], doubles="weight")
def _(t):
    return B.weigh(B.quantile_legs(merged(t), GL), GL).select(*GL, "timestamp", "ticker", "weight")


@query("portfolio_returns", f"SELECT {G}, timestamp, gross_log_return, long_n, short_n, turnover FROM pfq", ["pfq"],
       doubles="gross_log_return turnover", longs="long_n short_n", dp=9)
def _(t):
    return qpf(t)


@query("transaction_costs", f"SELECT {G}, timestamp, cost_bps, net_log_return FROM netq", ["netq"], doubles="cost_bps net_log_return", dp=9)
def _(t):
    return B.with_costs(qpf(t)).select(*GL, "timestamp", "cost_bps", "net_log_return")


@query("equity_drawdown", f"SELECT {G}, cost_bps, max_drawdown FROM perfq", ["perfq"], doubles="cost_bps max_drawdown")
def _(t):
    return B.drawdown(B.with_costs(qpf(t)), [*GL, "cost_bps"])


cte("hl", f"""SELECT * EXCLUDE (sd, dsd, nall, annualized_simple_return), n_periods * 1.0 / nall AS coverage FROM perfq JOIN nper USING ({G})""", "perfq", "nper")


def hl(t):
    return B.high_low_backtest(merged(t)).drop("annualized_simple_return")


@query("high_low_backtest", "SELECT * FROM hl", ["hl"], doubles=PERF_ALL, longs="n_periods")
def _(t):
    return hl(t)


@query("benchmark_lifts", f"""SELECT a.set_id, a.model_type, a.horizon, a.cost_bps, a.sharpe - e.sharpe AS sharpe_lift_vs_econ,
 a.net_cumulative_simple_return - e.net_cumulative_simple_return AS cumulative_return_lift_vs_econ FROM hl a
 LEFT JOIN (SELECT * FROM hl WHERE set_id = 'ECON') e USING (horizon, cost_bps, model_type, panel_mode, hpo_variant)""", ["hl"],
       doubles="cost_bps sharpe_lift_vs_econ cumulative_return_lift_vs_econ:2")
def _(t):
    return B.benchmark_lifts(hl(t)).select(
        "set_id", "model_type", "horizon", "cost_bps", "sharpe_lift_vs_econ", "cumulative_return_lift_vs_econ")


GT = G + ", threshold"
cte("tlegs", f"""SELECT {G}, threshold, timestamp, ticker, forward_log_return, CASE WHEN probability > threshold THEN 1 WHEN probability < 1.0 - threshold THEN -1 END AS side
FROM merged CROSS JOIN (VALUES (0.55::DOUBLE), (0.60), (0.65)) t(threshold) WHERE forward_log_return IS NOT NULL AND (probability > threshold OR probability < 1.0 - threshold)""", "merged")
cte("wt", _weights("tlegs", GT), "tlegs")
cte("wt_i", _indexed("wt", GT), "wt")
cte("pft", _portfolio("wt", GT), "wt_i")
cte("nett", _net("pft"), "pft")
cte("perft", _perf("nett", GT).format(extra=AVG), "nett")


@query("threshold_backtest", f"""SELECT {GT}, cost_bps, category, coalesce(n_periods, 0) AS n_periods, coalesce(n_assets_avg, 0) AS n_assets_avg, coalesce(long_assets_avg, 0) AS long_assets_avg,
 coalesce(short_assets_avg, 0) AS short_assets_avg, coalesce(turnover_avg, 0) AS turnover_avg, coalesce(n_periods, 0) * 1.0 / nall AS coverage,
 {PERF.replace(' turnover_avg', '').replace(':2', '').replace(' ', ', ')} FROM nper CROSS JOIN (VALUES (0.55::DOUBLE), (0.60), (0.65)) t(threshold) CROSS JOIN (VALUES (0.0), (5.0), (10.0)) c(cost_bps)
 LEFT JOIN perft USING ({GT}, cost_bps)""", ["perft", "nper"], doubles=PERF_ALL + " threshold", longs="n_periods")
def _(t):
    return B.threshold_backtest(merged(t)).drop("annualized_simple_return")


cte("tk", f"""SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY {G}, ticker ORDER BY timestamp), 0)) / 2.0 AS turnover, pos * forward_log_return AS gross_log_return,
 0 AS long_n, 0 AS short_n FROM (SELECT *, prediction * 2 - 1 AS pos FROM merged WHERE forward_log_return IS NOT NULL)""", "merged")
cte("nettk", _net("tk"), "tk")
cte("perftk", _perf("nettk", G + ", ticker").format(extra=AVG), "nettk")


@query("ticker_backtest", f"""SELECT {G}, ticker, cost_bps, n_periods AS n_obs, net_cumulative_log_return AS cumulative_log_return,
 net_cumulative_simple_return AS cumulative_simple_return, sharpe, max_drawdown, turnover_avg, hit_rate FROM perftk""", ["perftk"],
       doubles="cost_bps cumulative_log_return cumulative_simple_return:2 sharpe max_drawdown turnover_avg hit_rate", longs="n_obs", dp=5)
def _(t):
    return B.ticker_backtest(merged(t))


cte("wb", """SELECT horizon, timestamp, ticker, forward_log_return, 1 AS side, 1.0 / count(*) OVER (PARTITION BY horizon, timestamp) AS weight FROM fwd WHERE forward_log_return IS NOT NULL""", "fwd")
cte("wb_i", _indexed("wb", "horizon"), "wb")
cte("pfb", _portfolio("wb", "horizon"), "wb_i")
cte("netb", _net("pfb"), "pfb")
cte("perfb", _perf("netb", "horizon").format(extra=AVG), "netb")


@query("buy_and_hold", "SELECT * EXCLUDE (sd, dsd, annualized_simple_return), 'BUY_HOLD' AS set_id, 'benchmark' AS model_type, 'buy_and_hold' AS portfolio_mode FROM perfb",
       ["perfb"], doubles=PERF_ALL.replace(" coverage", ""), longs="n_periods")
def _(t):
    return B.buy_and_hold(returns(t)).drop("annualized_simple_return")


@query("backtest_diagnostics", f"""SELECT {G}, n_signal_rows, n_unique_timestamps, n_unique_tickers, n_joined_non_null_forward_returns, coalesce(n_portfolio_periods, 0) AS n_portfolio_periods,
 n_forward_return_rows, CASE WHEN n_joined_non_null_forward_returns = 0 THEN 'skip_zero_forward_matches' WHEN coalesce(n_portfolio_periods, 0) = 0 THEN 'skip_no_portfolio_periods' ELSE 'ok' END AS status
FROM (SELECT {G}, count(*) AS n_signal_rows, count(DISTINCT timestamp) AS n_unique_timestamps, count(DISTINCT ticker) AS n_unique_tickers,
 count(forward_log_return) AS n_joined_non_null_forward_returns FROM merged GROUP BY {G}) LEFT JOIN (SELECT {G}, count(DISTINCT timestamp) AS n_portfolio_periods FROM wq GROUP BY {G}) USING ({G})
 JOIN (SELECT horizon, count(*) AS n_forward_return_rows FROM fwd GROUP BY 1) USING (horizon)""", ["wq"],
       longs="n_signal_rows n_unique_timestamps n_unique_tickers n_joined_non_null_forward_returns n_portfolio_periods n_forward_return_rows")
def _(t):
    n = returns(t).groupBy("horizon").agg(F.count(F.lit(1)).alias("n_forward_return_rows"))
    return B.backtest_diagnostics(merged(t), n)


@query("duplicate_return_keys", "SELECT horizon, ticker, timestamp, count(*) AS n FROM (SELECT * FROM fwd UNION ALL SELECT * FROM fwd WHERE ticker = 'T1') GROUP BY ALL HAVING count(*) > 1", ["fwd"], longs="n")
def _(t):
    """One ticker's returns come twice."""
    r = returns(t)
    return B.duplicate_return_keys(r.unionByName(r.where("ticker = 'T1'")))
