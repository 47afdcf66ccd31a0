"""Forecast evaluation: metrics, thresholds, matched pairs, regimes, inference."""
from pyspark.sql import functions as F

from ..functions import identity, times
from ..functions.identity import GROUP_KEYS
from ..operators import inference as I
from ..operators import matching as M
from ..operators import metrics as E
from ..operators import regimes as R
from ..sources import registry
from ..sources import standins as S
from ..sources.posts import attach_set_metadata, normalise_signals
from .base import chi2_sql, cte, normal_sql, query, t_sql

G = "horizon, set_id, sentiment_model, model_type, panel_mode, hpo_variant"
FAM = "horizon, model_type, panel_mode, hpo_variant"
GL = GROUP_KEYS


def sig(t):
    return t.once("signals", lambda: S.signals(t))


def counts_sql(y="target", p="prediction", q="probability", pre="", cond="TRUE"):
    def n(c):
        return f"count(*) FILTER ({cond} AND {c})"
    cq = f"greatest(least({q}, 1 - 1e-15), 1e-15)"
    ll = f"-({y} * ln({cq}) + (1 - {y}) * ln(1 - {cq}))"
    return (f"{n(f'{p}=1 AND {y}=1')} AS {pre}tp, {n(f'{p}=0 AND {y}=0')} AS {pre}tn, {n(f'{p}=1 AND {y}=0')} AS {pre}fp, "
            f"{n(f'{p}=0 AND {y}=1')} AS {pre}fn, avg({ll}) FILTER ({cond}) AS {pre}ll, "
            f"avg(({cq} - {y}) * ({cq} - {y})) FILTER ({cond}) AS {pre}bs")


def metrics_sql(pre="", balanced_single=True, brier_single=False):
    tp, tn, fp, fn = (f"{pre}{c}" for c in ("tp", "tn", "fp", "fn"))
    n = f"({tp}+{tn}+{fp}+{fn})"
    two = f"({tp}+{fn} > 0 AND {tn}+{fp} > 0)"
    tpr, tnr = f"({tp}*1.0/nullif({tp}+{fn},0))", f"({tn}*1.0/nullif({tn}+{fp},0))"
    bal = f"CASE WHEN {two} THEN ({tpr}+{tnr})/2 END"
    return {
        "accuracy": f"({tp}+{tn})*1.0/nullif({n},0)",
        "balanced_accuracy": f"coalesce({bal}, {tpr}, {tnr})" if balanced_single else bal,
        "f1": f"CASE WHEN {two} THEN coalesce(2.0*{tp}/nullif(2*{tp}+{fp}+{fn},0), 0) END",
        "precision": f"CASE WHEN {two} THEN coalesce({tp}*1.0/nullif({tp}+{fp},0), 0) END",
        "recall": f"CASE WHEN {two} THEN {tpr} END",
        "log_loss": f"CASE WHEN {two} THEN {pre}ll END",
        "brier_score": f"{pre}bs" if brier_single else f"CASE WHEN {two} THEN {pre}bs END",
    }


def named(d, pre=""):
    return ", ".join(f'{v} AS "{pre}{k}"' for k, v in d.items())


METRICS = "accuracy balanced_accuracy f1 precision recall log_loss brier_score"
POOLED_D = f"{METRICS} positive_accuracy negative_accuracy"
SIDED = "tp*1.0/nullif(tp+fp,0) AS positive_accuracy, tn*1.0/nullif(tn+fn,0) AS negative_accuracy"


def pooled_sql(keys, extra_d=""):
    return f"""SELECT {keys}, category, tp, tn, fp, fn, tp+tn+fp+fn AS n_obs, first_test_timestamp, last_test_timestamp,
first_forecast_origin, last_forecast_origin, n_tickers, {named(metrics_sql())}, {SIDED} FROM (
SELECT {keys}{'' if 'category' in keys else ', max(category) AS category'}, {counts_sql()}, min(timestamp) AS first_test_timestamp, max(timestamp) AS last_test_timestamp,
 min(forecast_origin) AS first_forecast_origin, max(forecast_origin) AS last_forecast_origin, count(DISTINCT ticker) AS n_tickers
FROM signals GROUP BY {keys})"""


cte("pooled", pooled_sql(G), "signals")


@query("pooled_metrics", "SELECT * FROM pooled", ["pooled"], doubles=POOLED_D, longs="tp tn fp fn n_obs n_tickers")
def _(t):
    return E.classification_metrics(sig(t), dp=12)


@query("ticker_metrics", pooled_sql(G + ", ticker"), ["signals"], doubles=POOLED_D, longs="tp tn fp fn n_obs n_tickers")
def _(t):
    return E.classification_metrics(sig(t), [*GL, "ticker"], dp=12)


@query("run_metrics_summary", f"""SELECT {G}, ticker, category, tp, tn, fp, fn, tp+tn+fp+fn AS n_obs, first_test_timestamp, last_test_timestamp,
{named(metrics_sql())}, {SIDED} FROM (
SELECT {G}, CASE WHEN grouping(ticker) = 1 THEN 'pooled' ELSE ticker END AS ticker, max(category) AS category, {counts_sql()},
 min(timestamp) AS first_test_timestamp, max(timestamp) AS last_test_timestamp
FROM signals GROUP BY GROUPING SETS (({G}), ({G}, ticker)))""", ["signals"], doubles=POOLED_D, longs="tp tn fp fn n_obs")
def _(t):
    return E.metrics_summary(sig(t), dp=12)


def _threshold_sql():
    parts = []
    for th in E.THRESHOLDS:
        cond = "TRUE" if th <= 0.5 else f"(p > {th!r} OR p < 1.0 - {th!r})"
        pred = "CAST(p >= 0.5 AS INT)" if th <= 0.5 else f"CAST(p > {th!r} AS INT)"
        m = metrics_sql(brier_single=True)
        parts.append(f"""SELECT {G}, category, {th!r} AS threshold, n_obs, tp+tn+fp+fn AS n_trades, (tp+tn+fp+fn)*1.0/n_obs AS coverage,
{named({k: m[k] for k in ('accuracy', 'precision', 'recall', 'f1', 'brier_score')})} FROM (
SELECT {G}, max(category) AS category, count(*) AS n_obs, {counts_sql(p=pred, q='p', cond=cond)}
FROM (SELECT *, greatest(least(probability, 1 - 1e-15), 1e-15) AS p FROM signals) GROUP BY {G})""")
    return " UNION ALL ".join(parts)


cte("thresholds", _threshold_sql(), "signals")


@query("threshold_analysis", "SELECT * FROM thresholds", ["thresholds"],
       doubles="threshold coverage accuracy precision recall f1 brier_score", longs="n_obs n_trades")
def _(t):
    return E.threshold_analysis(sig(t), dp=12)


@query("class_balance", """SELECT horizon, count(*) AS n, avg(target) AS base_rate_up, abs(avg(target) - 0.5) AS delta_from_half,
abs(avg(target) - 0.5) > 0.05 AS imbalance_flag FROM signals GROUP BY 1""", ["signals"], doubles="base_rate_up delta_from_half", longs="n")
def _(t):
    return E.class_balance(sig(t))


@query("leaderboard", f"""SELECT {G}, accuracy, n_obs, rank FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(accuracy, 6) DESC,
set_id, sentiment_model, model_type, panel_mode, hpo_variant) AS rank FROM pooled) WHERE rank <= 5""", ["pooled"], doubles="accuracy", longs="n_obs rank")
def _(t):
    return E.leaderboard(E.classification_metrics(sig(t)), 5).select(*GL, "accuracy", "n_obs", "rank")


# ---- identity, origin, loading -------------------------------------------------------------------

@query("forecast_origin", "SELECT horizon, ticker, timestamp, set_id, model_type, forecast_origin FROM signals", ["signals"])
def _(t):
    s = sig(t).drop("forecast_origin")
    return s.select("horizon", "ticker", "timestamp", "set_id", "model_type", times.forecast_origin().alias("forecast_origin"))


@query("origin_mismatch", "SELECT ticker, timestamp FROM bars_6h WHERE hour(timestamp) = 6", ["bars_6h"])
def _(t):
    b = S.bars(t, "6h").withColumn("forecast_origin", times.forecast_origin())
    wrong = b.withColumn("forecast_origin", F.when(F.hour("timestamp") == 6, F.col("timestamp")).otherwise(F.col("forecast_origin")))
    return times.origin_mismatches(wrong).select("ticker", "timestamp")


@query("forecast_sample", """SELECT ticker, timestamp, set_id, model_type FROM signals
WHERE forecast_origin >= TIMESTAMP '1998-01-01' AND forecast_origin < TIMESTAMP '1999-01-01'""", ["signals"])
def _(t):
    return sig(t).where(times.in_forecast_sample("1998-01-01", "1999-01-01")).select("ticker", "timestamp", "set_id", "model_type")


@query("signal_scan", """SELECT horizon, set_id, CASE sentiment_model WHEN '-' THEN '-' ELSE sentiment_model END AS sentiment_model,
 CASE WHEN model_type = 'per_asset' THEN 'per_asset' ELSE model_type END AS model_type, panel_mode, 'fixed' AS hpo_variant, 'expanding' AS train_window_mode,
 count(*) AS n FROM signals WHERE NOT (ticker = 'T3' AND horizon = '6h') GROUP BY ALL""", ["signals"], longs="n")
def _(t):
    raw = sig(t).withColumns({
        "sentiment_model": F.when(F.col("sentiment_model") == "-", "None").otherwise(F.concat(F.lit(" "), "sentiment_model")),
        "model_type": F.when(F.col("model_type") == "per_asset", " ").otherwise(F.col("model_type")),
        "hpo_variant": F.lit("nan"),
        "probability": F.when((F.col("ticker") == "T3") & (F.col("horizon") == "6h"), F.lit(None)).otherwise(F.col("probability"))})
    return normalise_signals(raw).groupBy("horizon", "set_id", "sentiment_model", "model_type", "panel_mode", "hpo_variant",
                                          "train_window_mode").agg(F.count(F.lit(1)).alias("n"))


@query("set_metadata", """SELECT set_id, category, count(*) AS n FROM (SELECT set_id, CASE WHEN set_id = 'NAIVE' THEN NULL ELSE category END AS category FROM signals)
GROUP BY ALL""", ["signals"], longs="n")
def _(t):
    return attach_set_metadata(sig(t), registry.feature_sets(t.spark)).groupBy("set_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("strict_sets", "SELECT set_id, count(*) AS n FROM signals WHERE set_id IN ('ECON', 'ECON_VAD_L', 'NAIVE') GROUP BY 1", ["signals"], longs="n")
def _(t):
    reg = registry.feature_sets(t.spark).where("set_id in ('ECON', 'ECON_VAD_L')")
    return M.strict_sets(sig(t), reg).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


@query("naive_rows", "SELECT ticker, timestamp, horizon FROM signals WHERE set_id = 'NAIVE'", ["signals"])
def _(t):
    s = sig(t)
    return s.where(identity.is_naive(s)).select("ticker", "timestamp", "horizon")


cte("hpo", f"""SELECT {G}, CASE WHEN d % 7 <> 0 THEN CASE d % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.1 WHEN 2 THEN 1.0 ELSE 10.0 END END AS best_C,
CASE WHEN d % 7 = 0 THEN 'fallback_insufficient_data' WHEN d % 31 = 4 THEN 'fallback_all_failed' WHEN d % 37 = 5 THEN 'fallback_refit_failed' WHEN d % 5 <> 0 THEN 'ok' END AS hpo_status,
d % 13 <> 0 AS hpo_enabled, CASE WHEN d % 3 = 0 THEN 'balanced' ELSE 'none' END AS best_class_weight, 'log_loss' AS hpo_objective, ticker, category, target, prediction, probability, timestamp FROM (SELECT *, epoch_us(timestamp) // 86400000000 AS d FROM signals)""", "signals")


def _hpo_sql(keys):
    return f"""SELECT a.*, (SELECT string_agg(st || ':' || n, ';' ORDER BY st) FROM (SELECT coalesce(hpo_status, 'ok') AS st, count(*) AS n FROM hpo h
   WHERE hpo_enabled AND {' AND '.join(f'h.{k} = a.{k}' for k in keys.split(', '))} GROUP BY 1)) AS hpo_status_counts
 FROM (SELECT {keys}, max(hpo_objective) AS hpo_objective, median(best_C) AS best_C_median, count(*) AS n_tuned,
   (list(best_C ORDER BY nc DESC, best_C) FILTER (best_C IS NOT NULL))[1] AS best_C_mode, (list(best_class_weight ORDER BY nw DESC, best_class_weight))[1] AS best_class_weight_mode
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, best_C) AS nc, count(*) OVER (PARTITION BY {keys}, best_class_weight) AS nw FROM hpo WHERE hpo_enabled) GROUP BY {keys}) a"""


def tuned(t):
    d = F.floor(times.micros("timestamp") / 86400000000)
    c = F.element_at(F.array(*[F.lit(x) for x in (0.01, 0.1, 1.0, 10.0)]), (d % 4 + 1).cast("int"))
    a, b, e = identity.HPO_FALLBACKS
    status = F.when(d % 7 == 0, a).when(d % 31 == 4, b).when(d % 37 == 5, e).when(d % 5 != 0, identity.HPO_OK)
    return sig(t).withColumns({"best_C": F.when(d % 7 != 0, c), "hpo_status": status, "hpo_enabled": d % 13 != 0,
                               "best_class_weight": F.when(d % 3 == 0, "balanced").otherwise("none"), "hpo_objective": F.lit("log_loss")})


@query("hpo_summary", _hpo_sql(G), ["hpo"], doubles="best_C_median best_C_mode", longs="n_tuned")
def _(t):
    return E.hpo_summary(tuned(t))


TUNED = "hpo_objective, best_C_median, best_C_mode, best_class_weight_mode, hpo_status_counts"


@query("tuned_metrics_summary", f"""SELECT {G}, ticker, n_obs, round(accuracy, 6) AS accuracy, {TUNED} FROM (
 SELECT {G}, 'pooled' AS ticker, count(*) AS n_obs, avg(CAST(prediction = target AS INT)) AS accuracy FROM hpo GROUP BY ALL) LEFT JOIN ({_hpo_sql(G)}) USING ({G})
 UNION ALL SELECT {G}, ticker, n_obs, round(accuracy, 6), {TUNED} FROM (
 SELECT {G}, ticker, count(*) AS n_obs, avg(CAST(prediction = target AS INT)) AS accuracy FROM hpo GROUP BY ALL) LEFT JOIN ({_hpo_sql(G + ", ticker")}) USING ({G}, ticker)""",
       ["hpo"], doubles="accuracy best_C_median best_C_mode", longs="n_obs")
def _(t):
    return E.metrics_summary(tuned(t)).select(*identity.GROUP_KEYS, "ticker", "n_obs", "accuracy", *TUNED.split(", "))


# ---- matched pairs -------------------------------------------------------------------------------

cte("pairs", f"""SELECT m.*, e.probability AS probability_b, e.prediction AS prediction_b, e.target AS target_b,
 CAST(m.prediction = m.target AS INT) AS correct_m, CAST(e.prediction = m.target AS INT) AS correct_b
FROM (SELECT * FROM signals WHERE category IN ('sentiment', 'combined')) m JOIN (SELECT * FROM signals WHERE set_id = 'ECON') e
 USING ({FAM}, timestamp, ticker)""", "signals")
cte("pairs_c", "SELECT * FROM pairs WHERE category = 'combined'", "pairs")
BC = "count(*) FILTER (correct_b = 1 AND correct_m = 0) AS b, count(*) FILTER (correct_b = 0 AND correct_m = 1) AS c, count(*) AS n_matched"
STAT = "CASE WHEN b + c = 0 THEN 0.0 ELSE (abs(b - c) - 1.0) * (abs(b - c) - 1.0) / (b + c) END"
cte("mcnemar", f"""SELECT *, {chi2_sql('mcnemar_stat')} AS mcnemar_pval FROM (SELECT *, {STAT} AS mcnemar_stat FROM
(SELECT {G}, category, 'ECON' AS benchmark, {BC} FROM pairs GROUP BY {G}, category))""", "pairs")


@query("mcnemar", "SELECT *, mcnemar_pval < 0.05 AS significant_vs_benchmark FROM mcnemar", ["mcnemar"],
       doubles="mcnemar_stat mcnemar_pval", longs="b c n_matched")
def _(t):
    return M.mcnemar_table(M.benchmark_pairs(sig(t)))


@query("mcnemar_wide", f"SELECT {G}, mcnemar_stat AS mcnemar_stat_vs_econ, mcnemar_pval AS mcnemar_pval_vs_econ, "
       "mcnemar_pval < 0.05 AS significant_vs_benchmark_vs_econ, n_matched AS n_matched_vs_econ FROM mcnemar", ["mcnemar"],
       doubles="mcnemar_stat_vs_econ mcnemar_pval_vs_econ", longs="n_matched_vs_econ")
def _(t):
    return M.mcnemar_wide(M.mcnemar_table(M.benchmark_pairs(sig(t))), ["ECON"])


@query("cross_family_benchmark", f"""SELECT set_id, model_type, benchmark, count(*) AS n FROM (
SELECT m.set_id, m.model_type, 'ECON' AS benchmark FROM (SELECT * FROM signals WHERE category IN ('sentiment', 'combined') AND model_type = 'panel_logit') m
 JOIN (SELECT * FROM signals WHERE set_id = 'ECON' AND model_type = 'per_asset') e USING (horizon, hpo_variant, timestamp, ticker)
UNION ALL SELECT set_id, model_type, 'ECON' FROM pairs WHERE model_type = 'per_asset') GROUP BY ALL""", ["pairs"], longs="n")
def _(t):
    s = sig(t).where(~((F.col("set_id") == "ECON") & (F.col("model_type") == "panel_logit")))
    return M.benchmark_pairs(s, cross_family=True).groupBy("set_id", "model_type", "benchmark").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_intersection", """SELECT count(*) FILTER (c IS NOT NULL) AS n_candidate, count(*) FILTER (r IS NOT NULL) AS n_reference,
 count(*) FILTER (c IS NOT NULL AND r IS NOT NULL) AS n_matched, count(*) FILTER (c IS NOT NULL AND r IS NULL) AS n_unmatched_candidate,
 count(*) FILTER (c IS NULL AND r IS NOT NULL) AS n_unmatched_reference, sum(c - 1) AS n_duplicate_candidate, sum(r - 1) AS n_duplicate_reference
FROM (SELECT ticker, timestamp, count(*) c FROM signals WHERE set_id = 'ECON_VAD_L' GROUP BY 1, 2) FULL JOIN
 (SELECT ticker, timestamp, count(*) r FROM signals WHERE set_id = 'SENT_VAD_L' GROUP BY 1, 2) USING (ticker, timestamp)""", ["signals"],
       longs="n_candidate n_reference n_matched n_unmatched_candidate n_unmatched_reference n_duplicate_candidate n_duplicate_reference")
def _(t):
    s = sig(t)
    return M.coverage_counts(s.where("set_id = 'ECON_VAD_L'"), s.where("set_id = 'SENT_VAD_L'"), ["ticker", "timestamp"])


def _lift_sql():
    parts = []
    for th in E.THRESHOLDS:
        on = "TRUE" if th <= 0.5 else f"(probability > {th!r} OR probability < 1.0 - {th!r})"
        cm = "CAST((probability >= 0.5) = (target = 1) AS INT)" if th <= 0.5 else f"CAST((probability > {th!r}) = (target = 1) AS INT)"
        parts.append(f"""SELECT {G}, category, 'ECON' AS benchmark, {th!r} AS threshold, n_traded, n_matched, n_traded * 1.0 / n_obs AS coverage_model,
 m * 1.0 / nullif(n_matched, 0) AS accuracy_model, k * 1.0 / nullif(n_matched, 0) AS accuracy_benchmark, (m - k) * 1.0 / nullif(n_matched, 0) AS lift_accuracy,
 CASE WHEN n_matched > 0 THEN {STAT} END AS mcnemar_stat FROM (
 SELECT {G}, category, count(*) FILTER ({on}) AS n_matched, sum({cm}) FILTER ({on}) AS m, sum(correct_b) FILTER ({on}) AS k,
  count(*) FILTER ({on} AND correct_b = 1 AND {cm} = 0) AS b, count(*) FILTER ({on} AND correct_b = 0 AND {cm} = 1) AS c FROM pairs GROUP BY {G}, category)
 JOIN (SELECT {G}, count(*) AS n_obs, count(*) FILTER ({on}) AS n_traded FROM signals GROUP BY {G}) USING ({G})""")
    return " UNION ALL ".join(parts)


@query("threshold_lift", f"""SELECT *, coalesce(mcnemar_pval < 0.05, FALSE) AS significant_vs_benchmark FROM (
SELECT *, {chi2_sql('mcnemar_stat')} AS mcnemar_pval FROM ({_lift_sql()}))""", ["pairs"],
       doubles="threshold coverage_model accuracy_model accuracy_benchmark lift_accuracy mcnemar_stat mcnemar_pval", longs="n_traded n_matched")
def _(t):
    return M.threshold_lift(sig(t), dp=12)


def mapping(t):
    return registry.benchmark_map(registry.feature_sets(t.spark))


@query("benchmark_pick", f"""SELECT {G}, 'expanding' AS window_mode, 0.0 AS window_size, -1.0 AS window_days, 'ECON' AS benchmark_set_id,
 'fixed' AS benchmark_hpo_variant FROM signals WHERE category = 'combined' GROUP BY {G}""", ["signals"], doubles="window_size window_days")
def _(t):
    return M.pick_benchmarks(identity.with_group_defaults(sig(t)), mapping(t))


def _sides_sql(a, b, src, keys):
    ma, mb = metrics_sql("m_", False, True), metrics_sql("b_", False, True)
    names = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "brier_score": "brier", "log_loss": "log_loss", "f1": "f1"}
    cols = ", ".join(f"{m[k]} AS {n}_{v}" for n, m in ((a, ma), (b, mb)) for k, v in names.items())
    return f"""SELECT *, {a}_accuracy - {b}_accuracy AS accuracy_lift, {a}_balanced_accuracy - {b}_balanced_accuracy AS balanced_accuracy_lift,
 {b}_brier - {a}_brier AS brier_improvement, {b}_log_loss - {a}_log_loss AS log_loss_improvement, {a}_f1 - {b}_f1 AS f1_lift,
 b AS mcnemar_b, c AS mcnemar_c, {STAT} AS mcnemar_stat FROM (SELECT {keys}, n_matched, b, c, model_correct, benchmark_correct, {cols} FROM (
 SELECT {keys}, {counts_sql(pre='m_')}, {counts_sql(p='prediction_b', q='probability_b', pre='b_')}, {BC},
  sum(correct_m) AS model_correct, sum(correct_b) AS benchmark_correct FROM {src} GROUP BY {keys}))"""


SIDE_D = "accuracy_lift balanced_accuracy_lift brier_improvement log_loss_improvement mcnemar_stat mcnemar_p_value " + " ".join(
    f"{{0}}_{x} {{1}}_{x}" for x in ("accuracy", "balanced_accuracy", "brier", "log_loss"))
INC_D = SIDE_D.format("model", "benchmark") + " model_f1 benchmark_f1 f1_lift"
cte("incremental", f"""SELECT *, {chi2_sql('mcnemar_stat')} AS mcnemar_p_value FROM ({_sides_sql('model', 'benchmark', 'pairs_c', G)})""", "pairs_c")


@query("incremental_value", f"""SELECT * EXCLUDE (b, c), 'ok' AS status, CASE WHEN accuracy_lift > 0 THEN CASE WHEN mcnemar_p_value < 0.05 THEN 'improved_significant' ELSE 'improved' END
 WHEN accuracy_lift < 0 THEN CASE WHEN mcnemar_p_value < 0.05 THEN 'degraded_significant' ELSE 'degraded' END ELSE 'no_change' END AS interpretation_flag,
 mcnemar_p_value < 0.05 AS significant_raw_5pct FROM incremental""", ["incremental"], doubles=INC_D,
       longs="n_matched mcnemar_b mcnemar_c model_correct benchmark_correct")
def _(t):
    s = identity.with_group_defaults(sig(t))
    return M.incremental_value(s, mapping(t)).drop(
        "window_mode", "window_size", "window_days", "benchmark_set_id", "benchmark_hpo_variant")


cte("gappy", """SELECT * EXCLUDE (hpo_variant), CASE WHEN set_id = 'ECON' AND horizon = '6h' AND panel_mode = 'pooled' THEN 'tuned' ELSE hpo_variant END AS hpo_variant,
 CASE WHEN model_type = 'per_asset' THEN 'rolling_fixed' ELSE 'expanding' END AS mode, CASE WHEN model_type = 'per_asset' THEN CASE WHEN set_id LIKE '%VAD%' THEN 90.0 ELSE 180.0 END END AS days
FROM signals WHERE NOT (horizon = '1d' AND panel_mode = 'pooled' AND ((set_id = 'ECON' AND epoch_us(timestamp) // 86400000000 % 2 = 1) OR (set_id = 'ECON_CBT_L' AND epoch_us(timestamp) // 86400000000 % 2 = 0)))""", "signals")


def gappy(t):
    """Forecasts of which some have no benchmark with their training window, some one of another tuning variant, some none at their times."""
    odd = F.floor(times.micros("timestamp") / 86400000000) % 2 == 1
    pooled, econ, per = F.col("panel_mode") == "pooled", F.col("set_id") == "ECON", F.col("model_type") == "per_asset"
    s = identity.with_group_defaults(sig(t)).where(~((F.col("horizon") == "1d") & pooled & ((econ & odd) | ((F.col("set_id") == "ECON_CBT_L") & ~odd))))
    days = F.when(per, F.when(F.col("set_id").contains("VAD"), 90.0).otherwise(180.0))
    return s.withColumns({"hpo_variant": F.when(econ & (F.col("horizon") == "6h") & pooled, "tuned").otherwise(F.col("hpo_variant")), "rolling_window_days": days,
                          "train_window_timestamps": days, "train_window_mode": F.when(per, "rolling_fixed").otherwise("expanding")})


@query("incremental_value_gaps", f"""SELECT {G}, window_mode, window_size, window_days, benchmark_set_id, benchmark_hpo_variant, coalesce(n, 0) AS n_matched,
 CASE WHEN benchmark_hpo_variant IS NULL THEN 'missing_benchmark' WHEN n IS NULL THEN 'no_overlap' ELSE 'ok' END AS status
FROM (SELECT {G}, any_value(mode) AS window_mode, coalesce(max(days), 0.0) AS window_size, coalesce(max(days), -1.0) AS window_days, 'ECON' AS benchmark_set_id FROM gappy WHERE category = 'combined' GROUP BY {G}) m
LEFT JOIN (SELECT horizon, model_type, panel_mode, coalesce(max(days), -1.0) AS window_days, hpo_variant AS benchmark_hpo_variant FROM gappy WHERE set_id = 'ECON'
 GROUP BY horizon, model_type, panel_mode, hpo_variant) b USING (horizon, model_type, panel_mode, window_days)
LEFT JOIN (SELECT {", ".join("x." + k for k in G.split(", "))}, count(*) AS n FROM gappy x JOIN gappy e ON e.set_id = 'ECON' AND x.category = 'combined' AND x.horizon = e.horizon AND x.model_type = e.model_type
 AND x.panel_mode = e.panel_mode AND x.timestamp = e.timestamp AND x.ticker = e.ticker AND x.days IS NOT DISTINCT FROM e.days GROUP BY ALL) n USING ({G})""", ["gappy"],
       doubles="window_size window_days", longs="n_matched")
def _(t):
    return M.incremental_value(gappy(t), mapping(t)).select(
        *[c.strip() for c in G.split(",")], "window_mode", "window_size", "window_days", "benchmark_set_id", "benchmark_hpo_variant", "n_matched", "status")


NG = "horizon, set_id, sentiment_model, model_type, panel_mode, hpo_variant"
cte("npairs", """SELECT m.*, e.probability AS probability_b, e.prediction AS prediction_b, CAST(m.prediction = m.target AS INT) AS correct_m,
 CAST(e.prediction = m.target AS INT) AS correct_b FROM (SELECT * FROM signals WHERE set_id <> 'NAIVE') m
 JOIN (SELECT * FROM signals WHERE set_id = 'NAIVE') e USING (horizon, model_type, panel_mode, timestamp, ticker)""", "signals")
cte("vs_naive", f"SELECT *, {chi2_sql('mcnemar_stat')} AS mcnemar_p_value FROM ({_sides_sql('model', 'naive', 'npairs', NG)})", "npairs")


@query("absolute_vs_naive", f"""SELECT {G}, 'expanding' AS train_window_mode, CAST(NULL AS DOUBLE) AS rolling_window_days, coin_universe_hash,
 naive_coin_universe_hash, n_model, coalesce(n_naive, 0) AS n_naive, coalesce(n_matched, 0) AS n_matched, n_model - coalesce(n_matched, 0) AS n_unmatched_model,
 coalesce(n_naive, 0) - coalesce(n_matched, 0) AS n_unmatched_naive, 0 AS n_duplicate_model_keys, 0 AS n_duplicate_naive_keys,
 CASE WHEN n_matched IS NOT NULL THEN TRUE END AS targets_identical, coalesce(mcnemar_p_value < 0.05, FALSE) AS significant_raw_5pct,
 CASE WHEN naive_coin_universe_hash IS NULL THEN 'missing_naive' ELSE 'ok' END AS status,
 model_accuracy, naive_accuracy, accuracy_lift, model_balanced_accuracy, naive_balanced_accuracy, balanced_accuracy_lift, model_brier, naive_brier,
 brier_improvement, model_log_loss, naive_log_loss, log_loss_improvement, mcnemar_b, mcnemar_c, mcnemar_stat, mcnemar_p_value
FROM (SELECT {G}, count(*) AS n_model, substr(sha256(string_agg(DISTINCT ticker, '|' ORDER BY ticker)), 1, 8) AS coin_universe_hash FROM signals
 WHERE set_id <> 'NAIVE' GROUP BY {G}) LEFT JOIN (SELECT horizon, model_type, panel_mode, count(*) AS n_naive,
 substr(sha256(string_agg(DISTINCT ticker, '|' ORDER BY ticker)), 1, 8) AS naive_coin_universe_hash FROM signals WHERE set_id = 'NAIVE' GROUP BY 1, 2, 3)
 USING (horizon, model_type, panel_mode) LEFT JOIN vs_naive USING ({NG})""", ["vs_naive"], doubles=SIDE_D.format("model", "naive") + " rolling_window_days",
       longs="n_model n_naive n_matched n_unmatched_model n_unmatched_naive n_duplicate_model_keys n_duplicate_naive_keys mcnemar_b mcnemar_c")
def _(t):
    return M.absolute_vs_naive(identity.with_group_defaults(sig(t)).drop("train_window_timestamps"))


cte("noisy", """SELECT * EXCLUDE (d, copies, target, copy), CASE WHEN set_id = 'ECON_CBT_L' AND horizon = '1d' AND ticker = 'T0' AND d % 97 = 0 THEN 1 - target ELSE target END AS target
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM (SELECT *, CASE WHEN (set_id = 'ECON' AND ticker = 'T1' AND d % 3 = 0) OR (set_id = 'NAIVE' AND ticker = 'T2' AND d % 5 = 0) THEN 2 ELSE 1 END AS copies
 FROM (SELECT *, epoch_us(timestamp) // 86400000000 AS d FROM signals) WHERE NOT (set_id = 'NAIVE' AND horizon = '6h' AND model_type = 'per_asset')))""", "signals")


def noisy(t):
    """Forecasts with repeated model and reference rows, a family without reference, and one set whose targets differ in places."""
    d, of = F.floor(times.micros("timestamp") / 86400000000), lambda k: F.col("set_id") == k
    twice = (of("ECON") & (F.col("ticker") == "T1") & (d % 3 == 0)) | (of("NAIVE") & (F.col("ticker") == "T2") & (d % 5 == 0))
    other = of("ECON_CBT_L") & (F.col("horizon") == "1d") & (F.col("ticker") == "T0") & (d % 97 == 0)
    s = identity.with_group_defaults(sig(t)).drop("train_window_timestamps").where(~(of("NAIVE") & (F.col("horizon") == "6h") & (F.col("model_type") == "per_asset")))
    s = s.withColumn("target", F.when(other, 1 - F.col("target")).otherwise(F.col("target")))
    return s.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(twice, 2).otherwise(1)))).drop("_copy")


@query("absolute_vs_naive_gaps", f"""SELECT {G}, n_model, coalesce(n_naive, 0) AS n_naive, coalesce(n_matched, 0) AS n_matched, n_duplicate_model_keys, coalesce(n_duplicate_naive_keys, 0) AS n_duplicate_naive_keys,
 wrong = 0 AS targets_identical, CASE WHEN n_naive IS NULL THEN 'missing_naive' WHEN n_matched IS NULL THEN 'no_overlap' WHEN wrong > 0 THEN 'target_mismatch' ELSE 'ok' END AS status
FROM (SELECT {G}, count(*) AS n_model, sum(k - 1) AS n_duplicate_model_keys FROM (SELECT {G}, timestamp, ticker, count(*) AS k FROM noisy WHERE set_id <> 'NAIVE' GROUP BY ALL) GROUP BY {G})
LEFT JOIN (SELECT horizon, model_type, panel_mode, count(*) AS n_naive, sum(k - 1) AS n_duplicate_naive_keys FROM (SELECT horizon, model_type, panel_mode, timestamp, ticker, count(*) AS k
 FROM noisy WHERE set_id = 'NAIVE' GROUP BY ALL) GROUP BY 1, 2, 3) USING (horizon, model_type, panel_mode)
LEFT JOIN (SELECT {", ".join("x." + k for k in G.split(", "))}, count(*) AS n_matched, count(*) FILTER (x.target IS DISTINCT FROM e.target) AS wrong FROM (SELECT DISTINCT {G}, timestamp, ticker, target FROM noisy WHERE set_id <> 'NAIVE') x
 JOIN (SELECT DISTINCT horizon, model_type, panel_mode, timestamp, ticker, target FROM noisy WHERE set_id = 'NAIVE') e ON x.horizon = e.horizon AND x.model_type = e.model_type AND x.panel_mode = e.panel_mode
 AND x.timestamp = e.timestamp AND x.ticker = e.ticker GROUP BY ALL) USING ({G})""", ["noisy"], longs="n_model n_naive n_matched n_duplicate_model_keys n_duplicate_naive_keys")
def _(t):
    return M.absolute_vs_naive(noisy(t)).select(
        *G.split(", "), "n_model", "n_naive", "n_matched", "n_duplicate_model_keys", "n_duplicate_naive_keys", "targets_identical", "status")


cte("complete_base", f"""SELECT {G}, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT timestamp) AS n_timestamps,
 min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, count(DISTINCT (ticker, timestamp)) AS np FROM signals GROUP BY {G}""", "signals")
cte("complete_all", f"""SELECT b.*, e.x AS expected_timestamps, g.x AS grid, coalesce(h.hit, 0) AS hit FROM complete_base b
 LEFT JOIN (SELECT {FAM}, count(DISTINCT timestamp) x FROM signals WHERE set_id = 'ECON' GROUP BY {FAM}) e USING ({FAM})
 JOIN (SELECT horizon, count(DISTINCT timestamp) x FROM signals GROUP BY 1) g USING (horizon)
 LEFT JOIN (SELECT {G}, count(DISTINCT timestamp) hit FROM signals s WHERE EXISTS (SELECT 1 FROM signals z WHERE z.set_id = 'ECON' AND z.horizon = s.horizon
   AND z.model_type = s.model_type AND z.panel_mode = s.panel_mode AND z.hpo_variant = s.hpo_variant AND z.timestamp = s.timestamp) GROUP BY {G}) h USING ({G})""",
    "complete_base")


@query("signal_completeness", f"""SELECT *, status = 'complete' AS is_complete FROM (SELECT {G}, n_rows, n_tickers, n_timestamps, first_timestamp, last_timestamp,
 expected_timestamps, n_rows - np AS n_duplicate_rows, expected_timestamps - hit AS missing_timestamps, n_tickers * expected_timestamps AS expected_combinations,
 greatest(n_tickers * expected_timestamps - np, 0) AS missing_combinations, n_timestamps * 1.0 / expected_timestamps AS coverage_vs_econ, n_timestamps * 1.0 / grid AS coverage_vs_forecast_sample,
 CASE WHEN expected_timestamps IS NULL THEN 'unknown' WHEN set_id = 'ECON' THEN CASE WHEN grid > n_timestamps THEN 'incomplete' ELSE 'complete' END
  WHEN expected_timestamps > hit OR n_tickers * expected_timestamps > np THEN 'incomplete' ELSE 'complete' END AS status FROM complete_all)""", ["complete_all"],
       doubles="coverage_vs_econ coverage_vs_forecast_sample",
       longs="n_rows n_tickers n_timestamps expected_timestamps n_duplicate_rows missing_timestamps expected_combinations missing_combinations")
def _(t):
    return M.completeness(sig(t)).drop("reason")


@query("improvement_indicator", f"SELECT {G}, timestamp, ticker, correct_m - correct_b AS d FROM pairs", ["pairs"], longs="d")
def _(t):
    return M.improvement_indicator(M.benchmark_pairs(sig(t))).select(*GL, "timestamp", "ticker", "d")


# ---- regimes -------------------------------------------------------------------------------------

cte("gk", """SELECT ticker, timestamp AS date, 0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open) AS gk_var
FROM bars_1d""", "bars_1d")
cte("vol_series", """SELECT *, CASE WHEN count(gk_var) OVER w >= 7 THEN avg(gk_var) OVER w END AS vol FROM gk
WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""", "gk")
cte("vol_lookup", """SELECT ticker, date, gk_var, vol, CASE WHEN 3 * k < n - 1 THEN 'low' WHEN 3 * k < 2 * (n - 1) THEN 'mid' ELSE 'high' END AS vol_regime
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY vol, date) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS n FROM vol_series WHERE vol IS NOT NULL)""",
    "vol_series")
cte("cap_lag", "SELECT ticker, date, lag(market_cap) OVER (PARTITION BY ticker ORDER BY date) AS market_cap_lag FROM caps", "caps")
cte("size_lookup", """SELECT ticker, date, market_cap_lag, CASE WHEN 3 * k < n - 1 THEN 'small' WHEN 3 * k < 2 * (n - 1) THEN 'mid' ELSE 'large' END AS mcap_regime
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY market_cap_lag, ticker) - 1 AS k, count(*) OVER (PARTITION BY date) AS n,
 count(DISTINCT market_cap_lag) OVER (PARTITION BY date) AS u FROM cap_lag WHERE market_cap_lag > 0) WHERE n >= 3 AND u >= 3""", "cap_lag")


def vol_lookup(t):
    return t.once("vol", lambda: R.volatility_lookup(S.bars(t, "1d").withColumnRenamed("timestamp", "date")))


def size_lookup(t):
    return t.once("size", lambda: R.size_lookup(S.market_caps(t)))


@query("garman_klass_volatility", "SELECT * FROM vol_series WHERE vol IS NOT NULL", ["vol_series"], doubles="gk_var vol", dp=9)
def _(t):
    return vol_lookup(t).select("ticker", "date", "gk_var", "vol")


@query("volatility_regimes", "SELECT ticker, date, vol_regime AS regime FROM vol_lookup", ["vol_lookup"])
def _(t):
    return vol_lookup(t).select("ticker", "date", "regime")


@query("size_regimes", "SELECT * FROM size_lookup", ["size_lookup"], doubles="market_cap_lag", dp=2)
def _(t):
    return size_lookup(t).select("ticker", "date", "market_cap_lag", "mcap_regime")


cte("vreg", """SELECT s.*, v.vol_regime, v.date AS vol_available FROM signals s ASOF LEFT JOIN vol_lookup v ON s.ticker = v.ticker AND s.timestamp > v.date""",
    "signals", "vol_lookup")
cte("breg", "SELECT s.*, v.mcap_regime FROM vreg s ASOF LEFT JOIN size_lookup v ON s.ticker = v.ticker AND s.timestamp > v.date", "vreg", "size_lookup")


def both(t):
    return t.once("both", lambda: R.attach_both(sig(t), vol_lookup(t), size_lookup(t)))


def vreg(t):
    return t.once("vreg", lambda: R.attach_regime(
        sig(t), vol_lookup(t).withColumnRenamed("regime", "vol_regime"), "vol_regime", "vol"))


@query("regime_asof", f"""SELECT {G}, ticker, timestamp, vol_regime, vol_available AS vol_regime_available_at, vol_available - INTERVAL 1 DAY AS vol_regime_source_date,
 (epoch_us(timestamp) - epoch_us(vol_available)) / 86400000000.0 AS vol_regime_lag_days FROM vreg""", ["vreg"], doubles="vol_regime_lag_days")
def _(t):
    return vreg(t).select(*GL, "ticker", "timestamp", "vol_regime", "vol_regime_available_at", "vol_regime_source_date", "vol_regime_lag_days")


@query("regime_lag_summary", """SELECT horizon, 1 - count(vol_regime) * 1.0 / count(*) AS share_unmatched_regime, median(g) AS median_regime_lag_days,
 min(g) AS min_regime_lag_days, max(g) AS max_regime_lag_days, avg(CAST(g > 1 AS INT)) AS share_regime_lag_gt_1_day FROM (
 SELECT *, (epoch_us(timestamp) - epoch_us(vol_available)) / 86400000000.0 AS g FROM vreg) GROUP BY 1""", ["vreg"],
       doubles="share_unmatched_regime median_regime_lag_days min_regime_lag_days max_regime_lag_days share_regime_lag_gt_1_day")
def _(t):
    return R.regime_lag_summary(vreg(t), ["horizon"], "vol_regime", "vol")


cte("vol_table", f"""SELECT g.*, r.vol_regime, d.accuracy, d.brier_score, coalesce(n_obs, 0) AS n_obs, coalesce(n_days, 0) AS n_days FROM
 (SELECT {G}, max(category) AS category FROM signals GROUP BY {G}) g CROSS JOIN (VALUES ('low'), ('mid'), ('high')) r(vol_regime)
 LEFT JOIN (SELECT {G}, vol_regime, CASE WHEN horizon = '1d' THEN sum(ok) * 1.0 / sum(n) ELSE avg(ok * 1.0 / n) END AS accuracy,
  CASE WHEN horizon = '1d' THEN sum(sq) / sum(n) ELSE avg(sq / n) END AS brier_score, sum(n) AS n_obs, count(*) AS n_days FROM (
   SELECT {G}, vol_regime, ticker, CAST(timestamp AS DATE) AS date, sum(CAST(prediction = target AS INT)) AS ok, sum((probability - target) * (probability - target)) AS sq, count(*) AS n
   FROM vreg WHERE vol_regime IS NOT NULL GROUP BY ALL) GROUP BY {G}, vol_regime) d USING ({G}, vol_regime)""", "vreg")


@query("volatility_stratification", "SELECT * FROM vol_table", ["vol_table"], doubles="accuracy brier_score", longs="n_obs n_days")
def _(t):
    return R.volatility_table(vreg(t))


def _strat_sql(regimes, spine, cols):
    m = metrics_sql(balanced_single=False)
    r = ", ".join(regimes)
    return f"""SELECT g.*, {', '.join('sp.' + x for x in regimes)}, {', '.join('d."' + c + '"' for c in cols)}, coalesce(n_obs, 0) AS n_obs, coalesce(n_days, 0) AS n_days,
 coalesce(n_tickers, 0) AS n_tickers FROM (SELECT {G}, max(category) AS category FROM signals GROUP BY {G}) g CROSS JOIN {spine}
 LEFT JOIN (SELECT {G}, {r}, n_obs, n_days, n_tickers, {named({c: m[c] for c in cols})} FROM (SELECT {G}, {r}, {counts_sql()}, count(*) AS n_obs,
  count(DISTINCT CAST(timestamp AS DATE)) AS n_days, count(DISTINCT ticker) AS n_tickers FROM breg WHERE {' AND '.join(x + ' IS NOT NULL' for x in regimes)} GROUP BY {G}, {r})) d
 USING ({G}, {r})"""


SIZE_COLS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "brier_score"]
cte("size_table", _strat_sql(["mcap_regime"], "(VALUES ('small'), ('mid'), ('large')) sp(mcap_regime)", SIZE_COLS), "breg")
cte("inter_table", _strat_sql(["mcap_regime", "vol_regime"], """(SELECT * FROM (VALUES ('small'), ('mid'), ('large')) a(mcap_regime)
 CROSS JOIN (VALUES ('low'), ('mid'), ('high')) b(vol_regime)) sp""", ["accuracy", "brier_score"]), "breg")


@query("size_stratification", "SELECT * FROM size_table", ["size_table"], doubles=" ".join(SIZE_COLS), longs="n_obs n_days n_tickers")
def _(t):
    return R.size_table(R.attach_regime(sig(t), size_lookup(t), "mcap_regime", "mcap"))


@query("regime_interaction", "SELECT *, mcap_regime || '_' || vol_regime AS interaction FROM inter_table", ["inter_table"],
       doubles="accuracy brier_score", longs="n_obs n_days n_tickers")
def _(t):
    return R.interaction_table(both(t))


def _regime_pairs(t):
    return t.once("rpairs", lambda: M.benchmark_pairs(both(t), extra=["vol_regime", "mcap_regime"]))


cte("rpairs", f"""SELECT p.*, r.vol_regime, r.mcap_regime FROM pairs p JOIN (SELECT {G}, timestamp, ticker, vol_regime, mcap_regime FROM breg) r USING ({G}, timestamp, ticker)""",
    "pairs", "breg")


def _reg_mcnemar_sql(regs):
    r = ", ".join(regs)
    return f"""SELECT *, coalesce(mcnemar_pval < 0.05, FALSE) AS significant_5pct, coalesce(mcnemar_pval < 0.10, FALSE) AS significant_10pct,
 coalesce(mcnemar_pval < 0.05 AND c > b, FALSE) AS model_better_raw_5pct, coalesce(mcnemar_pval < 0.05 AND b > c, FALSE) AS benchmark_better_raw_5pct,
 test_valid AND abs(improvement_rate) >= 0.01 AS practical_effect_flag FROM (SELECT *, {chi2_sql('mcnemar_stat')} AS mcnemar_pval FROM (
 SELECT *, b + c AS discordant_n, n_matched >= 50 AND b + c >= 20 AS test_valid, CASE WHEN n_matched >= 50 AND b + c >= 20 THEN {STAT} END AS mcnemar_stat,
 c - b AS net_improvement, abs(c - b) AS abs_net_improvement, (c - b) * 1.0 / n_matched AS improvement_rate, c * 1.0 / nullif(b + c, 0) AS discordant_advantage,
 CASE WHEN c > b THEN 'model_better' WHEN b > c THEN 'benchmark_better' ELSE 'tie' END AS direction
 FROM (SELECT {G}, category, 'ECON' AS benchmark, {r}, {BC} FROM rpairs WHERE {' AND '.join(x + ' IS NOT NULL' for x in regs)} GROUP BY {G}, category, {r})))"""


RM_D, RM_L = "mcnemar_stat mcnemar_pval improvement_rate discordant_advantage", "b c n_matched discordant_n net_improvement abs_net_improvement"


def _register_regime(name, regs):
    @query(name, _reg_mcnemar_sql(regs), ["rpairs"], doubles=RM_D, longs=RM_L)
    def _(t):
        return M.mcnemar_by_regime(_regime_pairs(t), regs)


_register_regime("regime_mcnemar_volatility", ["vol_regime"])
_register_regime("regime_mcnemar_size", ["mcap_regime"])
_register_regime("regime_mcnemar_interaction", ["mcap_regime", "vol_regime"])


# ---- inference -----------------------------------------------------------------------------------

def _diff_sql(reg, treat, ctrl):
    return f"""SELECT *, {t_sql('t_stat', 'dof')} AS p_value, t_stat IS NOT NULL AS test_valid FROM (SELECT *, CASE WHEN se_diff < 1e-12 THEN CASE WHEN abs(diff_in_improvement) < 1e-12 THEN 0.0 END
 ELSE diff_in_improvement / se_diff END AS t_stat FROM (SELECT {G}, n_treatment, n_control, n_clusters, m1 AS mean_d_treatment, m0 AS mean_d_control,
 m1 - m0 AS diff_in_improvement, sqrt(n_clusters * 1.0 / (n_clusters - 1) * (n_treatment + n_control - 1) / (n_treatment + n_control - 2) * v) AS se_diff,
 n_clusters - 1 AS dof, n_clusters < 10 AS small_cluster_warning FROM (
 SELECT {G}, any_value(n_treatment) AS n_treatment, any_value(n_control) AS n_control, count(*) AS n_clusters, any_value(m1) AS m1, any_value(m0) AS m0,
  sum(((s1 - n1 * m1) / n_treatment - (s0 - n0 * m0) / n_control) * ((s1 - n1 * m1) / n_treatment - (s0 - n0 * m0) / n_control)) AS v FROM
 (SELECT *, sum(n1) OVER w AS n_treatment, sum(n0) OVER w AS n_control, sum(s1) OVER w / sum(n1) OVER w AS m1, sum(s0) OVER w / sum(n0) OVER w AS m0 FROM (
  SELECT {G}, ticker, count(*) FILTER ({reg} = '{treat}') AS n1, count(*) FILTER ({reg} = '{ctrl}') AS n0,
   coalesce(sum(correct_m - correct_b) FILTER ({reg} = '{treat}'), 0) AS s1, coalesce(sum(correct_m - correct_b) FILTER ({reg} = '{ctrl}'), 0) AS s0
  FROM rpairs WHERE category = 'combined' AND {reg} IN ('{treat}', '{ctrl}') GROUP BY {G}, ticker) WINDOW w AS (PARTITION BY {G})) GROUP BY {G})))"""


DIFF_D, DIFF_L = "mean_d_treatment mean_d_control diff_in_improvement se_diff t_stat p_value", "n_treatment n_control n_clusters dof"
cte("vol_diff", _diff_sql("vol_regime", "high", "low"), "rpairs")
cte("size_diff", _diff_sql("mcap_regime", "small", "large"), "rpairs")


def vol_diff(t):
    p = M.improvement_indicator(_regime_pairs(t)).where("category = 'combined'")
    return I.cluster_difference(p, GL, regime="vol_regime", treatment="high", control="low")


def size_diff(t):
    p = M.improvement_indicator(_regime_pairs(t)).where("category = 'combined'")
    return I.cluster_difference(p, GL, regime="mcap_regime", treatment="small", control="large")


@query("diff_in_improvement_volatility", "SELECT * FROM vol_diff", ["vol_diff"], doubles=DIFF_D, longs=DIFF_L)
def _(t):
    return vol_diff(t).drop("inference_skip_reason")


@query("diff_in_improvement_size", "SELECT * FROM size_diff", ["size_diff"], doubles=DIFF_D, longs=DIFF_L)
def _(t):
    return size_diff(t).drop("inference_skip_reason")


def _cl(x):
    return f"greatest(least({x}, 1 - 1e-15), 1e-15)"


def _llsql(p):
    return f"-(target * ln({_cl(p)}) + (1 - target) * ln(1 - {_cl(p)}))"


cte("dt", f"""SELECT {G}, timestamp, count(*) AS n_t, avg({_llsql('probability_b')} - ({_llsql('probability')})) AS ll, avg(correct_m - correct_b) AS acc
FROM pairs_c GROUP BY {G}, timestamp""", "pairs_c")


def _dm_sql(v):
    return f"""SELECT {G}, n_timestamps, n_matched, effect, effect_ntweighted, degenerate, hac_lag, block_length, CASE WHEN NOT degenerate THEN se_hac END AS se_hac, z_hac,
 {normal_sql('z_hac')} AS p_hac, NOT degenerate AS test_valid, CASE WHEN degenerate THEN 'degenerate_zero_variance' ELSE '' END AS skip_reason FROM (
 SELECT *, CASE WHEN NOT degenerate AND se_hac > 0 THEN effect / se_hac END AS z_hac FROM (
 SELECT {G}, any_value(n) AS n_timestamps, any_value(nm) AS n_matched, any_value(mu) AS effect, any_value(nw) AS effect_ntweighted, any_value(l) AS hac_lag,
  any_value(n) < 2 OR any_value(spread) < 1e-18 AS degenerate, any_value(blk) AS block_length, sqrt(greatest(CASE WHEN sum(w * p) < 0 THEN sum(CASE WHEN k = 0 THEN p END) ELSE sum(w * p) END, 0) / any_value(n) / any_value(n)) AS se_hac FROM (
  SELECT a.*, k, a.x * b.x AS p, CASE WHEN k = 0 THEN 1.0 ELSE 2 * (1 - k / (a.l + 1.0)) END AS w FROM dtc_{v} a CROSS JOIN range(0, 40) r(k)
   JOIN (SELECT {G}, pos AS pb, x FROM dtc_{v}) b USING ({G}) WHERE k <= a.l AND b.pb = a.pos + k) GROUP BY {G}))"""


for _v in ("ll", "acc"):
    cte(f"dtc_{_v}", f"""SELECT *, {_v} - mu AS x, CAST(floor(4 * pow(n / 100.0, 2.0 / 9)) AS BIGINT) AS l, greatest(CAST(round_even(pow(n, 1.0 / 3), 0) AS BIGINT), 1) AS blk FROM (
 SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY timestamp) AS pos, count(*) OVER w AS n, sum(n_t) OVER w AS nm, avg({_v}) OVER w AS mu, var_pop({_v}) OVER w AS spread,
  sum({_v} * n_t) OVER w / sum(n_t) OVER w AS nw FROM dt WINDOW w AS (PARTITION BY {G}))""", "dt")
    cte(f"dm_{_v}", _dm_sql(_v), f"dtc_{_v}")
DM_D, DM_L = "effect effect_ntweighted se_hac z_hac p_hac", "n_timestamps n_matched hac_lag block_length"


def cpairs(t):
    return t.once("cpairs", lambda: M.benchmark_pairs(sig(t), eligible=["combined"]))


@query("timestamp_differentials", "SELECT * FROM dt", ["dt"], doubles="ll acc", longs="n_t")
def _(t):
    return I.differentials(cpairs(t))


@query("logloss_timestamp_test", "SELECT * FROM dm_ll", ["dm_ll"], doubles=DM_D, longs=DM_L)
def _(t):
    return I.timestamp_test(cpairs(t), "ll", n_boot=0)


@query("accuracy_timestamp_test", "SELECT * FROM dm_acc", ["dm_acc"], doubles=DM_D, longs=DM_L)
def _(t):
    return I.timestamp_test(cpairs(t), "acc", n_boot=0)


cte("boot_size", f"""SELECT *, ceil(t * 1.0 / length)::BIGINT AS blocks, t - length + 1 AS starts, t - (ceil(t * 1.0 / length)::BIGINT - 1) * length AS short,
 concat_ws('|', {", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in G.split(", "))}) AS g
FROM (SELECT {G}, effect, n_timestamps AS t, CASE WHEN n_timestamps > block_length THEN block_length ELSE 1 END AS length FROM dm_ll WHERE NOT degenerate)""", "dm_ll")
cte("boot_total", f"SELECT {G}, pos AS place, sum(ll) OVER (PARTITION BY {G} ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS total FROM dtc_ll UNION ALL SELECT {G}, 0, 0.0 FROM boot_size", "dtc_ll", "boot_size")
cte("boot_draws", f"""SELECT {G}, effect, t, r, b = blocks - 1 AS is_last, CAST('0x' || substr(md5('{I.BOOT_SEED}:' || g || ':' || r || ':' || b), 1, 8) AS BIGINT) % starts AS start
FROM (SELECT *, unnest(range(0, blocks)) AS b FROM boot_size, range(0, {I.N_BOOT}) reps(r))""", "boot_size")
cte("boot_sums", f"""SELECT s.*, f.total - s.total AS full_sum, q.total - s.total AS rest_sum FROM (SELECT {G}, place, total, length, short FROM boot_total JOIN boot_size USING ({G}) WHERE place < starts) s
 JOIN (SELECT {G}, place AS f_at, total FROM boot_total) f USING ({G}) JOIN (SELECT {G}, place AS q_at, total FROM boot_total) q USING ({G}) WHERE f_at = s.place + length AND q_at = s.place + short""", "boot_total")
cte("boot", f"""SELECT {G}, stddev_samp(m) AS se_boot, quantile_cont(m, 0.025) AS ci95_low, quantile_cont(m, 0.975) AS ci95_high, avg(CASE WHEN abs(m - effect) >= abs(effect) THEN 1.0 ELSE 0.0 END) AS p_boot
FROM (SELECT {G}, r, any_value(effect) AS effect, sum(CASE WHEN is_last THEN rest_sum ELSE full_sum END) / any_value(t) AS m FROM boot_draws d
 JOIN (SELECT {G}, place AS start, full_sum, rest_sum FROM boot_sums) s USING ({G}, start) GROUP BY {G}, r) GROUP BY {G}""", "boot_draws", "boot_sums")


@query("block_bootstrap", f"SELECT * FROM dm_ll LEFT JOIN boot USING ({G})", ["dm_ll", "boot"], doubles=f"{DM_D} se_boot ci95_low ci95_high p_boot", longs=DM_L)
def _(t):
    return I.timestamp_test(cpairs(t), "ll")


BY = "set_id, model_type, panel_mode, hpo_variant"


def _contrast_sql(v, fam):
    def pick(c, h):
        return f"max(CASE WHEN horizon = '{h}' THEN {c} END)"
    rows = " UNION ALL ".join(
        f"SELECT {BY}, '{a}_vs_{b}' AS horizon_pair, {pick('effect', a)} AS effect_h1, {pick('effect', b)} AS effect_h2, {pick('se_hac', a)} AS s1, {pick('se_hac', b)} AS s2 FROM dm_{v} GROUP BY {BY}"
        for a, b in I.HORIZON_PAIRS)
    return f"""SELECT *, {normal_sql('z_stat')} AS p_value_raw FROM (SELECT {BY}, horizon_pair, effect_h1, effect_h2, '{fam}' AS family, effect_h1 - effect_h2 AS diff,
 sqrt(s1 * s1 + s2 * s2) AS se_diff, (effect_h1 - effect_h2) / nullif(sqrt(s1 * s1 + s2 * s2), 0) AS z_stat FROM ({rows}))"""


cte("contrast_ll", _contrast_sql("ll", "E1_horizon_logloss"), "dm_ll")
cte("contrast_acc", _contrast_sql("acc", "E2_horizon_accuracy"), "dm_acc")


def contrasts(tests, fam):
    return I.horizon_contrasts(tests, se="se_hac", family=fam)


@query("horizon_contrasts", "SELECT * FROM contrast_ll", ["contrast_ll"], doubles="effect_h1 effect_h2 diff se_diff z_stat p_value_raw")
def _(t):
    return contrasts(I.timestamp_test(cpairs(t), "ll", n_boot=0), "E1_horizon_logloss")


RUN_SQL = "CASE model_type WHEN 'per_asset' THEN '-' ELSE 'pooled' END, 'fixed'"
cte("records", f"""
SELECT concat_ws('|', 'A_H1_logloss', horizon, set_id, model_type, {RUN_SQL}) AS test_id, 'A_H1_logloss' AS family, p_hac AS p FROM dm_ll
UNION ALL SELECT concat_ws('|', 'B_H1_directional', horizon, set_id, model_type, {RUN_SQL}), 'B_H1_directional', mcnemar_p_value FROM incremental
UNION ALL SELECT concat_ws('|', 'C_H2_volatility', horizon, set_id, model_type, {RUN_SQL}), 'C_H2_volatility', p_value FROM vol_diff
UNION ALL SELECT concat_ws('|', 'D_H3_marketcap', horizon, set_id, model_type, {RUN_SQL}), 'D_H3_marketcap', p_value FROM size_diff
UNION ALL SELECT concat_ws('|', 'E1_horizon_logloss', horizon_pair, set_id, model_type, {RUN_SQL}), 'E1_horizon_logloss', p_value_raw FROM contrast_ll
UNION ALL SELECT concat_ws('|', 'E2_horizon_accuracy', horizon_pair, set_id, model_type, {RUN_SQL}), 'E2_horizon_accuracy', p_value_raw FROM contrast_acc
UNION ALL SELECT concat_ws('|', 'EXPL_sentiment_only_directional', horizon, set_id, model_type, {RUN_SQL}), 'EXPL_sentiment_only_directional', mcnemar_pval FROM mcnemar WHERE category = 'sentiment'""",
    "dm_ll", "incremental", "vol_diff", "size_diff", "contrast_ll", "contrast_acc", "mcnemar")
cte("bh", """SELECT test_id, family, p AS p_value_raw, CASE WHEN p IS NOT NULL THEN least(min(q) OVER (PARTITION BY family ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) END AS q_value_bh FROM (
SELECT *, p * count(p) OVER (PARTITION BY family) / r AS q FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, test_id) AS r FROM records))""", "records")


def families(t):
    d = t.once("diff", lambda: I.differentials(cpairs(t)))
    ll, acc = (t.once(v, lambda v=v: I.timestamp_test(None, v, n_boot=0, diff=d)) for v in ("ll", "acc"))
    inc = M.incremental_value(identity.with_group_defaults(sig(t)), mapping(t))
    mc = M.mcnemar_table(M.benchmark_pairs(sig(t))).where("category = 'sentiment'")
    return I.assemble_families(
        ll, inc, vol_diff(t), size_diff(t), contrasts(ll, "E1_horizon_logloss"), contrasts(acc, "E2_horizon_accuracy"), mc)


@query("pooled_verdicts", f"""SELECT p.horizon, p.set_id, p.model_type, p.panel_mode, p.hpo_variant, round(p.accuracy, 6) AS accuracy, b.family, b.q_value_bh AS mcnemar_q_value_bh_vs_econ,
 b.q_value_bh < 0.05 AS mcnemar_significant_bh_vs_econ FROM pooled p LEFT JOIN (SELECT *, family || '|' AS f FROM bh WHERE family IN ('B_H1_directional', 'EXPL_sentiment_only_directional') AND p_value_raw IS NOT NULL) b
 ON b.test_id = concat_ws('|', b.family, p.horizon, p.set_id, p.model_type, p.panel_mode, p.hpo_variant)""", ["pooled", "bh"], doubles="accuracy mcnemar_q_value_bh_vs_econ")
def _(t):
    v = I.pooled_verdicts(E.classification_metrics(sig(t)), families(t))
    return v.select("horizon", "set_id", "model_type", "panel_mode", "hpo_variant", "accuracy", "family", "mcnemar_q_value_bh_vs_econ", "mcnemar_significant_bh_vs_econ")


@query("benjamini_hochberg", "SELECT *, coalesce(q_value_bh < 0.05, FALSE) AS significant_bh FROM bh", ["bh"], doubles="p_value_raw q_value_bh")
def _(t):
    return families(t).select("test_id", "family", "p_value_raw", "q_value_bh", "significant_bh")


@query("family_manifest", """SELECT family, count(p_value_raw) AS n_tests, count(*) FILTER (q_value_bh < 0.05) AS n_significant_bh,
 coalesce(string_agg(CASE WHEN p_value_raw IS NOT NULL THEN test_id END, ';' ORDER BY test_id), '') AS member_test_ids,
 CASE WHEN family[1] IN ('A', 'B', 'C', 'D') THEN 'confirmatory' ELSE 'exploratory' END AS family_role, 'BH' AS correction FROM bh GROUP BY family""", ["bh"],
       longs="n_tests n_significant_bh")
def _(t):
    return I.family_manifest(families(t))


@query("support_classes", """SELECT a.horizon, a.set_id, a.model_type, CASE WHEN a.p_hac < 0.05 AND b.mcnemar_p_value < 0.05 THEN 'strong' WHEN a.p_hac < 0.05 THEN 'probabilistic'
 WHEN b.mcnemar_p_value < 0.05 THEN 'directional' ELSE 'none' END AS support FROM dm_ll a JOIN incremental b USING (horizon, set_id, model_type)""", ["dm_ll", "incremental"])
def _(t):
    ll = I.timestamp_test(cpairs(t), "ll", n_boot=0).select("horizon", "set_id", "model_type", (F.col("p_hac") < 0.05).alias("a"))
    inc = M.incremental_value(identity.with_group_defaults(sig(t)), mapping(t)).select(
        "horizon", "set_id", "model_type", F.col("significant_raw_5pct").alias("b"))
    return ll.join(inc, ["horizon", "set_id", "model_type"]).select("horizon", "set_id", "model_type", I.support_class("a", "b").alias("support"))


@query("summary_sections", """
SELECT 'avg_accuracy_per_category' AS section, horizon, category AS item, NULL AS set_id, NULL AS model_type, 'accuracy' AS metric, avg(accuracy) AS value FROM (SELECT horizon, category, round(accuracy, 6) AS accuracy FROM pooled) GROUP BY 2, 3
UNION ALL SELECT 'best_sentiment_model', horizon, NULL, set_id, model_type, 'accuracy', round(accuracy, 6) FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(accuracy, 6) DESC, set_id, model_type, panel_mode) rn FROM pooled WHERE category IN ('sentiment', 'combined')) WHERE rn = 1
UNION ALL SELECT 'n_significant_vs_benchmark', horizon, NULL, NULL, NULL, 'count', count(*) FILTER (mcnemar_pval < 0.05) FROM mcnemar GROUP BY 2
UNION ALL SELECT 'avg_accuracy_per_vol_regime', horizon, vol_regime, NULL, NULL, 'accuracy', avg(accuracy) FROM vol_table WHERE accuracy IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'threshold_tradeoff', horizon, CAST(threshold AS VARCHAR), NULL, NULL, 'accuracy', avg(round(accuracy, 6)) FROM (SELECT horizon, CAST(threshold AS DOUBLE) AS threshold, accuracy FROM thresholds) WHERE accuracy IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'best_small_cap_model', horizon, NULL, set_id, model_type, 'accuracy', accuracy FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY accuracy DESC, set_id, model_type, panel_mode) rn FROM size_table WHERE mcap_regime = 'small' AND n_obs > 0) WHERE rn = 1
UNION ALL SELECT 'best_small_high_vol_model', horizon, NULL, set_id, model_type, 'accuracy', accuracy FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY accuracy DESC, set_id, model_type, panel_mode) rn FROM inter_table WHERE mcap_regime = 'small' AND vol_regime = 'high' AND n_obs > 0) WHERE rn = 1""",
       ["pooled", "mcnemar", "vol_table", "thresholds", "size_table", "inter_table"], doubles="value", dp=5)
def _(t):
    s, b = sig(t), both(t)
    return E.summary_sections(
        E.classification_metrics(s), R.volatility_table(vreg(t)), E.threshold_analysis(s), R.size_table(b),
        R.interaction_table(b), M.mcnemar_table(M.benchmark_pairs(s)), dp=12)
