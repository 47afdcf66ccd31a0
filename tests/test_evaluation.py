import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions.identity import with_group_defaults
from barweave.operators import backtest as B
from barweave.operators import matching as M
from barweave.operators import metrics as E
from barweave.operators import prices as P
from barweave.plans.evaluation import evaluate, report_order, write_reports
from barweave.plans.pipelines import final_matrix, run_models, validate_prices
from barweave.sources.registry import benchmark_map, feature_sets


def sp(spark, pdf, *ts):
    df = spark.createDataFrame(pdf)
    for c in ts:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def signals(n=60, tickers=("A", "B", "C", "D"), seed=0):
    rng = np.random.default_rng(seed)
    base = pd.DataFrame([(t, k, int(rng.random() < .5)) for t in pd.date_range("2022-01-01", periods=n) for k in tickers],
                        columns=["timestamp", "ticker", "target"])
    out = []
    for sid, cat, sm in (("ECON", "benchmark", "-"), ("ECON_VAD_L", "combined", "vader"), ("SENT_VAD_L", "sentiment", "vader"), ("NAIVE", "reference", "-")):
        p = np.clip(.5 + .1 * (base.target - .5) + .2 * rng.normal(size=len(base)), .01, .99)
        out.append(base.assign(probability=p, prediction=(p >= .5).astype(int), set_id=sid, category=cat, sentiment_model=sm, horizon="1d",
                               model_type="panel_logit", panel_mode="pooled", hpo_variant="fixed"))
    s = pd.concat(out, ignore_index=True)
    s["forecast_origin"] = s["timestamp"] + pd.Timedelta(days=1)
    return s


def sig(spark, pdf=None):
    return sp(spark, signals() if pdf is None else pdf, "timestamp", "forecast_origin")


def test_mcnemar_by_hand(spark):
    df = spark.createDataFrame([(8, 2), (0, 0)], "b long, c long")
    stat, p = M.mcnemar_columns()
    a, z = df.select(stat.alias("s"), p.alias("p")).collect()
    assert a["s"] == 2.5 and a["p"] == pytest.approx(math.erfc(math.sqrt(1.25))) and (z["s"], z["p"]) == (0.0, 1.0)


def test_metrics_against_definitions(spark):
    s = signals()
    got = E.classification_metrics(sig(spark)).toPandas().set_index("set_id").loc["ECON"]
    e = s[s.set_id == "ECON"]
    assert got["accuracy"] == pytest.approx((e.target == e.prediction).mean(), abs=1e-6)
    tpr = e[e.target == 1].prediction.mean()
    tnr = 1 - e[e.target == 0].prediction.mean()
    assert got["balanced_accuracy"] == pytest.approx((tpr + tnr) / 2, abs=1e-6)
    assert got["log_loss"] == pytest.approx(-np.where(e.target == 1, np.log(e.probability), np.log(1 - e.probability)).mean(), abs=1e-6)


def test_single_class_slices(spark):
    s = signals(5)
    s["target"] = 1
    r = E.classification_metrics(sig(spark, s)).where("set_id = 'ECON'").first()
    assert r["f1"] is None and r["log_loss"] is None and r["balanced_accuracy"] == r["accuracy"]


def test_thresholds_keep_empty_rows(spark):
    s = signals(10)
    s["probability"] = .52
    r = {x["threshold"]: x for x in E.threshold_analysis(sig(spark, s)).where("set_id = 'ECON'").collect()}
    assert r[.5]["n_trades"] == 40 and r[.55]["n_trades"] == 0 and r[.55]["accuracy"] is None and r[.55]["coverage"] == 0


def test_duplicates_do_not_fan_out(spark):
    s = signals(20)
    twice = pd.concat([s, s])
    a = M.mcnemar_table(M.benchmark_pairs(sig(spark, s))).orderBy("set_id").collect()
    b = M.mcnemar_table(M.benchmark_pairs(sig(spark, twice))).orderBy("set_id").collect()
    assert a == b and a[0]["n_matched"] == 80
    c = M.completeness(sig(spark, twice)).where("set_id = 'ECON_VAD_L'").first()
    assert c["n_duplicate_rows"] == 80 and c["status"] == "incomplete"


def test_weighted_effect_equals_pooled_lift(spark):
    from barweave.operators import inference as I
    s = signals(40)
    s = s[~((s.set_id == "ECON_VAD_L") & (s.ticker == "A") & (s.timestamp < "2022-01-20"))]
    df = with_group_defaults(sig(spark, s))
    m = benchmark_map(feature_sets(spark))
    inc = M.incremental_value(df, m).first()
    ll = I.timestamp_test(M.incremental_pairs(df, m), "ll", n_boot=0).first()
    assert ll["effect_ntweighted"] == pytest.approx(inc["log_loss_improvement"], abs=1e-12)
    assert inc["n_matched"] == 40 * 4 - 19 and inc["status"] == "ok"


def test_missing_benchmark_and_no_overlap(spark):
    s = signals(20)
    m = benchmark_map(feature_sets(spark))
    none = M.incremental_value(with_group_defaults(sig(spark, s[s.set_id != "ECON"])), m).first()
    assert none["status"] == "missing_benchmark" and none["interpretation_flag"] == "n/a"
    s.loc[s.set_id == "ECON", "timestamp"] += pd.Timedelta(days=500)
    assert M.incremental_value(with_group_defaults(sig(spark, s)), m).first()["status"] == "no_overlap"


def test_naive_statuses(spark):
    s = signals(20)
    ok = M.absolute_vs_naive(with_group_defaults(sig(spark, s))).collect()
    assert len(ok) == 3 and {r["status"] for r in ok} == {"ok"} and all(r["n_unmatched_model"] == 0 for r in ok)
    none = M.absolute_vs_naive(with_group_defaults(sig(spark, s[s.set_id != "NAIVE"]))).collect()
    assert {r["status"] for r in none} == {"missing_naive"}
    two = pd.concat([s.assign(coin_universe_hash="m"), s[s.set_id == "NAIVE"].assign(coin_universe_hash="u2")])
    amb = M.absolute_vs_naive(with_group_defaults(sig(spark, two.assign(coin_universe_hash=two.coin_universe_hash.where(two.set_id == "NAIVE", "other"))))).collect()
    assert {r["status"] for r in amb} == {"ambiguous_naive_identity"}
    told = M.absolute_vs_naive(with_group_defaults(sig(spark, two))).collect()
    assert {r["status"] for r in told} == {"ok"}
    flip = s.copy()
    flip.loc[flip.set_id == "NAIVE", "target"] = 1 - flip.loc[flip.set_id == "NAIVE", "target"]
    assert {r["status"] for r in M.absolute_vs_naive(with_group_defaults(sig(spark, flip))).collect()} == {"target_mismatch"}


def book(spark, rows):
    df = spark.createDataFrame(rows, "timestamp string, ticker string, probability double, forward_log_return double")
    return df.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "g": F.lit("g"), "category": F.lit("x")})


def test_legs_turnover_and_costs_by_hand(spark):
    rows = [("2022-01-01", "A", .9, .02), ("2022-01-01", "B", .5, .0), ("2022-01-01", "C", .1, -.01),
            ("2022-01-02", "A", .8, .01), ("2022-01-02", "B", .5, .0), ("2022-01-02", "C", .2, .01),
            ("2022-01-03", "A", .1, .01), ("2022-01-03", "B", .5, .0), ("2022-01-03", "C", .9, .03)]
    legs = B.quantile_legs(book(spark, rows), ["g"])
    pf = B.portfolio(B.weigh(legs, ["g"]), ["g"]).orderBy("timestamp").collect()
    assert [round(r["gross_log_return"], 10) for r in pf] == [.03, 0.0, .02]
    assert [r["turnover"] for r in pf] == [1.0, 0.0, 2.0]
    perf = B.performance(B.portfolio(B.weigh(legs, ["g"]), ["g"]), ["g"], costs=(0.0, 10.0)).orderBy("cost_bps").collect()
    assert perf[0]["net_cumulative_log_return"] == pytest.approx(.05) and perf[1]["net_cumulative_log_return"] == pytest.approx(.05 - 3 * .001)
    assert perf[0]["max_drawdown"] == 0.0 and perf[0]["calmar_ratio"] is None and perf[0]["sortino"] is None


def test_tied_cross_section_is_split_by_rank(spark):
    rows = [("2022-01-01", k, .5, .0) for k in "ABCDE"]
    got = {r["ticker"]: r["side"] for r in B.quantile_legs(book(spark, rows), ["g"]).collect()}
    assert got == {k: 1 for k in "ABCDE"}


def test_drawdown_has_no_initial_one(spark):
    df = spark.createDataFrame([("2022-01-01", -.1), ("2022-01-02", .05), ("2022-01-03", -.2)], "timestamp string, net_log_return double")
    df = df.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz"), "g": F.lit(1)})
    assert B.drawdown(df, ["g"]).first()["max_drawdown"] == pytest.approx(math.exp(-.2) - 1)


def test_risk_free_rate_shifts_the_ratios(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(.001, .01, 50)
    pf = sp(spark, pd.DataFrame({"g": 1, "timestamp": pd.date_range("2022-01-01", periods=50), "gross_log_return": r, "turnover": 0.0, "long_n": 1, "short_n": 1}), "timestamp")
    got = B.performance(pf, ["g"], costs=(0.0,), rf=.05).first()
    ppy = 50 / 49 * 365
    ex = r - .05 / ppy
    assert got["sharpe"] == pytest.approx(ex.mean() / r.std(ddof=1) * math.sqrt(ppy))
    assert got["sortino"] == pytest.approx(ex.mean() / ex[ex < 0].std(ddof=1) * math.sqrt(ppy))


def test_whole_chain(spark, tmp_path):
    """Bars, market values and posts through features, models and every report."""
    rng = np.random.default_rng(1)
    tickers, n = ["BTC", "ETH", "LTC", "XNO"], 150
    bars, caps, posts = [], [], []
    for i, t in enumerate(tickers):
        c = 100 * np.exp(np.cumsum(rng.normal(0, .03, n)))
        d = pd.date_range("2022-01-01", periods=n)
        bars.append(pd.DataFrame({"ticker": t, "horizon": "1d", "timestamp": d, "open": c * .99, "high": c * 1.02, "low": c * .97, "close": c, "volume": rng.uniform(1, 5, n)}))
        caps.append(pd.DataFrame({"ticker": t, "date": d, "market_cap": c * 10 ** (i + 3)}))
        posts.append(pd.DataFrame({"ticker": t, "date": d + pd.to_timedelta(rng.integers(0, 86000, n), "s"), "selftext": "x", "post_id": np.arange(n) + 1000 * i,
                                   "vader_title_sentiment": rng.choice(["positive", "negative", "neutral"], n), "vader_title_score": rng.uniform(-1, 1, n),
                                   "vader_selftext_score": rng.uniform(-1, 1, n), "cryptobert_title_sentiment": "neutral",
                                   "cryptobert_title_score": rng.uniform(-1, 1, n), "cryptobert_selftext_score": rng.uniform(-1, 1, n)}))
    b = sp(spark, pd.concat(bars), "timestamp").withColumn("ticker", F.when(F.col("ticker") == "XNO", "NANO").otherwise(F.col("ticker")))
    c = sp(spark, pd.concat(caps), "date")
    p = sp(spark, pd.concat(posts), "date").withColumn("ticker", F.when(F.col("ticker") == "XNO", "NANO").otherwise(F.col("ticker")))
    final = final_matrix(b, c, p, "1d")
    assert final.count() == 4 * (n - 22)
    s = run_models(final, "1d", ["ECON", "SENT_VAD_L", "ECON_VAD_L"], days=40, grid=None, sample=None)
    def fits(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas")
    assert fits(s) == 0  # forecasts are stored, not fitted again by each reader
    late = run_models(final, "1d", ["ECON"], days=40, grid=None, sample=("2022-04-10", "2022-04-20"))
    whole = s.where("set_id in ('ECON', 'NAIVE') and forecast_origin >= timestamp'2022-04-10' and forecast_origin < timestamp'2022-04-20'")
    both = [sorted(map(tuple, x.select("set_id", "ticker", "timestamp", F.round("probability", 12)).collect())) for x in (late, whole)]
    assert both[0] == both[1] and len(both[0]) == 80
    ids = {r["set_id"]: r["count"] for r in s.groupBy("set_id").count().collect()}
    assert set(ids) == {"ECON", "SENT_VAD_L", "ECON_VAD_L", "NAIVE"} and len(set(ids.values())) == 1
    fr = P.forward_returns(b.select("ticker", "timestamp", "close")).select(F.lit("1d").alias("horizon"), "ticker", "timestamp", "forward_log_return")
    canon = c.withColumn("ticker", F.when(F.col("ticker") == "XNO", "NANO").otherwise(F.col("ticker")))
    tables = evaluate(s, b.withColumnRenamed("timestamp", "date"), canon, fr, n_boot=500)
    fit_free = [n for n in tables if n not in ("logloss_test", "accuracy_test", "horizon_contrasts")]
    assert all(fits(tables[n]) == 0 for n in fit_free)
    for name, df in tables.items():
        rows = df.limit(1000).toPandas()
        assert len(rows) > 0 or name == "threshold_lift", name
    assert all(report_order(n, t.columns) for n, t in tables.items()) and len(report_order("high_low_backtest", tables["high_low_backtest"].columns)) == 8
    write_reports({k: tables[k] for k in ("leaderboard", "mcnemar", "pooled_metrics")}, str(tmp_path / "out"))
    pooled = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / "pooled_metrics")).toPandas()
    assert list(pooled.accuracy) == sorted(pooled.accuracy, reverse=True)
    assert tables["completeness"].where("is_complete").count() >= 1


def test_price_validation_blocks(spark):
    rng = np.random.default_rng(2)
    frames = []
    for h, freq, k in (("1h", "h", 24), ("6h", "6h", 4), ("1d", "D", 1)):
        n = 5 * k
        frames.append(pd.DataFrame({"ticker": "A", "horizon": h, "timestamp": pd.date_range("2022-01-01", periods=n, freq=freq), "open": 1.0, "high": 2.0, "low": .5,
                                    "close": rng.uniform(1, 2, n), "volume": 24.0 / k, "seq": np.arange(n)}))
    out = validate_prices(sp(spark, pd.concat(frames), "timestamp"))
    assert out["quality"].where("status = 'ok'").count() == 3
    v = out["summary"].where("metric = 'volume'").collect()
    assert len(v) == 2 and all(r["max_abs_deviation"] == pytest.approx(0, abs=1e-9) for r in v)
