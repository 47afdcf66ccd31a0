"""The evaluation of a forecast table: matched pairs and regimes are written once, every report reads them."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import GROUP_KEYS, with_group_defaults
from ..operators import backtest, inference, matching, metrics, regimes
from ..session import reuse
from ..sources.registry import benchmark_map, feature_sets


def evaluate(signals: DataFrame, ohlc: DataFrame, caps: DataFrame, returns: DataFrame, n_boot=inference.N_BOOT,
             require_complete=False) -> dict:
    """All report tables of one forecast table over every bar width (corrections pool across widths).

    ``ohlc`` (ticker, date, open..close) and ``caps`` (ticker, date, market_cap) feed the regimes;
    ``returns`` (horizon, ticker, timestamp, forward_log_return) the backtest.
    """
    spark = signals.sparkSession
    signals = reuse(with_group_defaults(signals))
    universe = signals.select("ticker").distinct()
    vol = regimes.volatility_lookup(ohlc)
    size = regimes.size_lookup(caps, universe)
    sig = reuse(regimes.attach_both(signals, vol, size))
    mapping = benchmark_map(feature_sets(spark))
    complete = matching.completeness(sig)
    if require_complete:
        bad = complete.where(~F.col("is_complete")).select(*GROUP_KEYS, "reason").limit(1).collect()
        if bad:
            raise ValueError(f"incomplete forecasts: {bad[0].asDict()}")

    pairs = reuse(matching.benchmark_pairs(sig, extra=["vol_regime", "mcap_regime"]))
    combined = pairs.where(F.col("category") == "combined")
    pooled = reuse(metrics.classification_metrics(sig))
    thresholds = metrics.threshold_analysis(sig)
    vol_table = reuse(regimes.volatility_table(sig))
    size_table = reuse(regimes.size_table(sig))
    inter = reuse(regimes.interaction_table(sig))
    mcnemar = reuse(matching.mcnemar_table(pairs))
    incremental = reuse(matching.incremental_value(sig, mapping))
    d = matching.improvement_indicator(combined)
    vol_diff = reuse(inference.cluster_difference(d, GROUP_KEYS, regime="vol_regime", treatment="high", control="low"))
    size_diff = reuse(inference.cluster_difference(d, GROUP_KEYS, regime="mcap_regime", treatment="small", control="large"))
    diff = reuse(inference.differentials(combined))
    ll = reuse(inference.timestamp_test(None, "ll", n_boot=n_boot, diff=diff))
    acc = reuse(inference.timestamp_test(None, "acc", n_boot=n_boot, diff=diff))
    se = "se_boot" if n_boot else "se_hac"
    c_ll = inference.horizon_contrasts(ll, se=se, family="E1_horizon_logloss")
    c_acc = inference.horizon_contrasts(acc, se=se, family="E2_horizon_accuracy")
    families = reuse(inference.assemble_families(
        ll, incremental, vol_diff, size_diff, c_ll, c_acc, mcnemar.where(F.col("category") == "sentiment")))
    merged = reuse(backtest.signals_with_returns(sig, returns))
    perf = reuse(backtest.high_low_backtest(merged))
    return {
        "completeness": complete,
        "pooled_metrics": inference.pooled_verdicts(pooled, families),
        "ticker_metrics": metrics.classification_metrics(sig, [*GROUP_KEYS, "ticker"]),
        "class_balance": metrics.class_balance(sig),
        "threshold_analysis": thresholds,
        "threshold_lift": matching.threshold_lift(sig),
        "mcnemar": mcnemar,
        "mcnemar_wide": matching.mcnemar_wide(mcnemar, ["ECON"]),
        "volatility_stratification": vol_table,
        "size_stratification": size_table,
        "regime_interaction": inter,
        "regime_mcnemar_volatility": matching.mcnemar_by_regime(pairs, ["vol_regime"]),
        "regime_mcnemar_size": matching.mcnemar_by_regime(pairs, ["mcap_regime"]),
        "regime_mcnemar_interaction": matching.mcnemar_by_regime(pairs, ["mcap_regime", "vol_regime"]),
        "regime_lags": regimes.regime_lag_summary(sig, ["horizon"], "vol_regime", "vol"),
        "difference_volatility": inference.distribute_q(vol_diff, families, "C_H2_volatility"),
        "difference_size": inference.distribute_q(size_diff, families, "D_H3_marketcap"),
        "incremental_value": inference.distribute_q(incremental, families, "B_H1_directional"),
        "absolute_vs_naive": matching.absolute_vs_naive(sig),
        "logloss_test": inference.distribute_q(ll, families, "A_H1_logloss"),
        "accuracy_test": acc,
        "horizon_contrasts": c_ll.unionByName(c_acc),
        "test_families": families,
        "family_manifest": inference.family_manifest(families),
        "high_low_backtest": backtest.benchmark_lifts(perf),
        "threshold_backtest": backtest.threshold_backtest(merged),
        "ticker_backtest": backtest.ticker_backtest(merged),
        "buy_and_hold": backtest.buy_and_hold(returns, universe),
        "backtest_diagnostics": backtest.backtest_diagnostics(
            merged, returns.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_forward_return_rows"))),
        "leaderboard": metrics.leaderboard(pooled),
        "summary": metrics.summary_sections(pooled, vol_table, thresholds, size_table, inter, mcnemar),
    }


# The order reports are written in. A run's family comes first, so runs never interleave; "-" is descending.
FAMILY_FIRST = ["horizon", "model_type", "panel_mode", "hpo_variant"]
RUN_ORDER = [*FAMILY_FIRST, "set_id", "sentiment_model"]
FURTHER = {
    "ticker_metrics": ["ticker"], "threshold_analysis": ["threshold"], "threshold_lift": ["benchmark", "threshold"], "mcnemar": ["benchmark"],
    "volatility_stratification": ["vol_regime"], "size_stratification": ["mcap_regime"], "regime_interaction": ["mcap_regime", "vol_regime"],
    "regime_mcnemar_volatility": ["benchmark", "vol_regime"], "regime_mcnemar_size": ["benchmark", "mcap_regime"],
    "regime_mcnemar_interaction": ["benchmark", "mcap_regime", "vol_regime"], "ticker_backtest": ["ticker", "cost_bps"],
    "absolute_vs_naive": ["train_window_mode", "rolling_window_days"], "buy_and_hold": ["cost_bps"],
}
OWN_ORDER = {
    "pooled_metrics": [*FAMILY_FIRST, "-accuracy", "set_id", "sentiment_model"],
    "high_low_backtest": [*FAMILY_FIRST, "cost_bps", "-sharpe", "set_id", "sentiment_model"],
    "threshold_backtest": [*FAMILY_FIRST, "threshold", "cost_bps", "-sharpe", "set_id", "sentiment_model"],
    "horizon_contrasts": ["family", "horizon_pair", *RUN_ORDER], "test_families": ["family", "test_id"], "family_manifest": ["family"],
    "leaderboard": ["horizon", "rank"], "summary": ["section", "horizon", "item"],
}


def report_order(name, columns):
    """The columns a report is sorted by."""
    keys = OWN_ORDER.get(name, [*RUN_ORDER, *FURTHER.get(name, [])])
    return [F.col(k[1:]).desc() if k[0] == "-" else F.col(k) for k in keys if k.lstrip("-") in columns]


def write_reports(tables: dict, folder, overwrite=False):
    """One CSV folder per report, in its declared order."""
    from ..sources.posts import write_csv
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}", report_order(name, df.columns), overwrite)
