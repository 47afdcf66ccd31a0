import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barweave.operators import forecasts as L
from barweave.operators import inference as I
from barweave.operators import windows as N
from barweave.sources import registry
from tests import reference_models as R

SF = "/root/testdata/sf0.001"


def panel(n=160, tickers=("A", "B", "C"), seed=0):
    rng = np.random.default_rng(seed)
    frames = []
    for t in tickers:
        s = rng.normal(size=n)
        frames.append(pd.DataFrame({
            "timestamp": pd.date_range("2020-01-01", periods=n, freq="D"), "ticker": t,
            "target": (2 * s + 0.3 * rng.normal(size=n) > 0).astype(int), "signal": s, "noise": rng.normal(size=n)}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_solver_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    for c in (0.01, 1.0, 10.0):
        w = R.fit_logit(x, y, c)
        p = R.predict_logit(w, x)
        grad = np.r_[c * np.sum(p - y), w[1:] + c * x.T @ (p - y)]
        assert np.abs(grad).max() < 1e-6


def brute(pdf, features, days, c, init=0.5, least=30):
    """The walk-forward spelled out: one window, clip, scale and fit per test time."""
    pdf = pdf.sort_values(["timestamp", "ticker"])
    ts = np.sort(pdf["timestamp"].unique())
    out = {}
    for tau in ts[max(int(len(ts) * init), least):]:
        tr = pdf[(pdf["timestamp"] < tau) & (pdf["timestamp"] >= tau - np.timedelta64(days, "D"))]
        te = pdf[pdf["timestamp"] == tau]
        x, xt = tr[features].to_numpy(float), te[features].to_numpy(float)
        mu, sd = x.mean(0), x.std(0)
        w = R.fit_logit((x - mu) / sd, tr["target"].to_numpy(float), c)
        for t, p in zip(te["ticker"], R.predict_logit(w, (xt - mu) / sd)):
            out[(pd.Timestamp(tau), t)] = p
    return out


def test_walk_forward_equals_brute_force(spark):
    pdf = panel(90)
    want = brute(pdf, ["signal", "noise"], 40, 1.0)
    for chunk in (7, 30, 400):
        got = L.panel_walk_forward(to_spark(spark, pdf), {"S": ["signal", "noise"]}, days=40, chunk_days=chunk).toPandas()
        assert len(got) == len(want)
        for r in got.itertuples():
            assert abs(r.probability - want[(r.timestamp, r.ticker)]) < 1e-8


def test_signal_is_learned_and_noise_is_not(spark):
    got = L.panel_walk_forward(to_spark(spark, panel(200)), {"S": ["signal"], "N": ["noise"]}, days=90, chunk_days=30).toPandas()
    acc = got.assign(ok=got.target == got.prediction).groupby("set_id")["ok"].mean()
    assert acc["S"] > 0.9 and 0.35 < acc["N"] < 0.65


def test_future_rows_change_nothing(spark):
    pdf = panel(120)
    more = pdf[pdf["timestamp"] >= "2020-04-01"].copy()
    more["signal"] = 1e6
    more["timestamp"] += pd.Timedelta(days=60)
    sets = {"S": ["signal", "noise"]}
    a = L.panel_walk_forward(to_spark(spark, pdf), sets, days=40, chunk_days=20, fraction=0.0).toPandas()
    b = L.panel_walk_forward(to_spark(spark, pd.concat([pdf, more])), sets, days=40, chunk_days=20, fraction=0.0).toPandas()
    j = a.merge(b, on=["timestamp", "ticker"])
    assert len(j) == len(a)
    np.testing.assert_allclose(j["probability_x"], j["probability_y"], atol=1e-10)


def test_tuning_picks_from_the_grid_and_falls_back(spark):
    got = L.panel_walk_forward(to_spark(spark, panel(130)), {"S": ["signal", "noise"]}, days=60, chunk_days=30, grid=L.C_GRID).toPandas()
    assert set(got["hpo_status"]) == {"ok"} and set(got["best_C"]) <= set(L.C_GRID)
    short = L.panel_walk_forward(to_spark(spark, panel(80)), {"S": ["signal"]}, days=12, chunk_days=30, grid=L.C_GRID).toPandas()
    assert set(short["hpo_status"]) == {"fallback_insufficient_data"} and set(short["best_C"]) == {1.0}


def test_per_asset_is_expanding_and_chunk_free(spark):
    df = to_spark(spark, panel(100))
    a = L.asset_walk_forward(df, {"S": ["signal"]}, chunk=13).toPandas().sort_values(["ticker", "timestamp"])
    b = L.asset_walk_forward(df, {"S": ["signal"]}, chunk=1000).toPandas().sort_values(["ticker", "timestamp"])
    assert len(a) == 3 * 50
    np.testing.assert_allclose(a["probability"], b["probability"], atol=1e-10)
    assert (a["train_window_timestamps"].to_numpy() == np.tile(np.arange(50, 100), 3)).all()


def test_winsoriser_uses_own_limits_then_pooled():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 1))
    x[0] = 50.0
    tk = np.array(["A"] * 50 + ["B"] * 10)
    pre = R.Preprocessor(x, tk, ["log_return_t"], False)
    lo, hi = np.quantile(x[:50, 0], [0.005, 0.995])
    assert np.isclose(pre.clip(np.array([[99.0]]), np.array(["A"]))[0, 0], hi)
    assert pre.limits["B"] is None
    assert np.isclose(pre.clip(np.array([[99.0]]), np.array(["B"]))[0, 0], np.quantile(x[:, 0], 0.995))
    assert R.Preprocessor(x, tk, ["other"], False).clip(x, tk).max() == 50.0


def test_rolling_probability_by_hand(spark):
    pdf = panel(70)
    got = N.panel_rolling_probability(to_spark(spark, pdf), days=10).toPandas()
    assert got["timestamp"].min() == pd.Timestamp("2020-01-01") + pd.Timedelta(days=35)
    r = got.iloc[5]
    w = pdf[(pdf.ticker == r.ticker) & (pdf.timestamp < r.timestamp) & (pdf.timestamp >= r.timestamp - pd.Timedelta(days=10))]
    assert np.isclose(r.probability, w["target"].mean()) and r.train_window_timestamps == 10


# ---- inference -----------------------------------------------------------------------------------

def pairs_frame(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for t in pd.date_range("2021-01-01", periods=n, freq="D"):
        for k in range(4):
            y = int(rng.random() < 0.5)
            pm, pb = rng.uniform(0.05, 0.95, 2)
            rows.append((t, f"K{k}", y, pm, pb, int((pm >= .5) == y), int((pb >= .5) == y), "high" if k % 2 else "low", "g"))
    pdf = pd.DataFrame(rows, columns=["timestamp", "ticker", "target", "probability", "probability_b", "correct_m", "correct_b", "regime", "grp"])
    return pdf, to_spark(spark, pdf)


def test_effect_and_hac_match_numpy(spark):
    pdf, df = pairs_frame(spark)
    got = I.timestamp_test(df, "ll", keys=["grp"], n_boot=0).first()
    ll = lambda p: -(pdf.target * np.log(p) + (1 - pdf.target) * np.log(1 - p))
    pdf["d"] = ll(pdf.probability_b) - ll(pdf.probability)
    d = pdf.groupby("timestamp")["d"].mean().to_numpy()
    n, lag = len(d), int(np.floor(4 * (len(d) / 100) ** (2 / 9)))
    c = d - d.mean()
    om = c @ c / n + 2 * sum((1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
    assert got["hac_lag"] == lag and np.isclose(got["effect"], d.mean()) and np.isclose(got["se_hac"], np.sqrt(om / n))
    assert np.isclose(got["effect_ntweighted"], pdf["d"].mean())


def test_bootstrap_matches_brute_force_in_distribution(spark):
    pdf, df = pairs_frame(spark, 80)
    diff = I.differentials(df, ["grp"])
    st = I.effects(diff, "acc", ["grp"])
    a = I.bootstrap(diff, st, "acc", ["grp"], n_boot=4000).first()
    b = I.bootstrap(diff, st, "acc", ["grp"], n_boot=4000).first()
    assert a["se_boot"] == b["se_boot"]
    d = diff.orderBy("timestamp").toPandas()["acc"].to_numpy()
    length = st.first()["block_length"]
    rng = np.random.default_rng(9)
    k = -(-len(d) // length)
    means = [np.concatenate([d[s:s + length] for s in rng.integers(0, len(d) - length + 1, k)])[:len(d)].mean() for _ in range(4000)]
    assert abs(a["se_boot"] - np.std(means, ddof=1)) < 0.05 * np.std(means)
    assert abs(a["ci95_low"] - np.quantile(means, .025)) < 0.1 * np.std(means) * 2


def untested_differences(spark):
    """One valid size test; of the volatility tests one lacks controls, one has a single ticker on either side."""
    cols = ", ".join(f"'{v}' {k}" for k, v in {"horizon": "6h", "model_type": "m", "panel_mode": "p", "hpo_variant": "f", "sentiment_model": "-"}.items())
    d = spark.sql(f"""SELECT {cols}, set_id, 'K' || k AS ticker, (id * 7 + k) % 3 - 1 AS d, CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE CASE set_id WHEN 'B' THEN 'low' ELSE 'high' END END AS regime,
        CASE WHEN id % 2 = 0 THEN 'small' ELSE 'large' END AS size FROM range(40), (SELECT explode(array(0, 1, 2)) AS k), (SELECT explode(array('A', 'B')) AS set_id)""")
    vol = I.cluster_difference(d, I.GROUP_KEYS)
    size = I.cluster_difference(d.where("set_id = 'A'"), I.GROUP_KEYS, regime="size", treatment="small", control="large")
    return vol, size


def test_difference_without_controls_is_no_test(spark):
    got = {r["set_id"]: r for r in untested_differences(spark)[0].collect()}
    assert got["A"]["n_control"] == 0 and got["A"]["mean_d_control"] is None and got["A"]["p_value"] is None
    assert not got["A"]["test_valid"] and got["A"]["inference_skip_reason"] == "too_few_clusters_or_obs"
    assert not got["B"]["test_valid"] and got["B"]["p_value"] is None and got["B"]["n_clusters"] == 2


def test_untested_differences_are_listed(spark):
    vol, size = untested_differences(spark)
    got = I.assemble_families(vol_diff=vol, size_diff=size)
    rows = {r["test_id"].split("|")[0] + r["set_id"]: r for r in got.collect()}
    assert set(rows) == {"C_H2_volatilityA", "C_H2_volatilityB", "D_H3_marketcapA"}
    for k in ("C_H2_volatilityA", "C_H2_volatilityB"):
        assert rows[k]["p_value_raw"] is None and rows[k]["q_value_bh"] is None and not rows[k]["significant_bh"]
    assert rows["D_H3_marketcapA"]["q_value_bh"] == rows["D_H3_marketcapA"]["p_value_raw"]


def test_family_without_tests_is_in_the_manifest(spark):
    vol, size = untested_differences(spark)
    got = {r["family"]: (r["n_tests"], r["n_significant_bh"], r["member_test_ids"]) for r in I.family_manifest(I.assemble_families(vol_diff=vol, size_diff=size)).collect()}
    assert got["C_H2_volatility"] == (0, 0, "") and got["D_H3_marketcap"][0] == 1 and len(got) == 2


def test_bootstrap_sends_no_draws_to_the_driver(spark):
    _, df = pairs_frame(spark, 80)
    diff = I.differentials(df, ["grp"])
    st = I.effects(diff, "acc", ["grp"])
    sizes = "spark.sql.maxBroadcastTableSize", "spark.sql.autoBroadcastJoinThreshold"
    before, got = [spark.conf.get(k) for k in sizes], []
    try:
        for values in (before[0], before[1]), (str(40 << 20), before[1]), (before[0], "-1"):  # a small table counts as 32 MB, 800,000 draws as more
            for k, v in zip(sizes, values):
                spark.conf.set(k, v)
            got.append(I.bootstrap(diff, st, "acc", ["grp"], n_boot=40_000).first())
    finally:
        for k, v in zip(sizes, before):
            spark.conf.set(k, v)
    assert all(np.allclose(list(x)[1:], list(got[0])[1:], rtol=1e-12) for x in got) and {x["grp"] for x in got} == {"g"}


def test_cluster_difference_equals_sandwich(spark):
    pdf, df = pairs_frame(spark, 50)
    got = I.cluster_difference(df.withColumn("d", F.col("correct_m") - F.col("correct_b")), ["grp"]).first()
    d = (pdf.correct_m - pdf.correct_b).to_numpy(float)
    t = (pdf.regime == "high").to_numpy(float)
    x = np.column_stack([np.ones_like(t), t])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ d
    u = d - x @ beta
    mid = sum(np.outer(s, s) for s in (x[m].T @ u[m] for m in (pdf.ticker.to_numpy() == k for k in pdf.ticker.unique())))
    g, n = pdf.ticker.nunique(), len(d)
    se = np.sqrt((inv @ mid @ inv)[1, 1] * g / (g - 1) * (n - 1) / (n - 2))
    assert np.isclose(got["diff_in_improvement"], beta[1]) and np.isclose(got["se_diff"], se) and got["dof"] == g - 1


def test_zero_standard_error_policy(spark):
    same = spark.createDataFrame([("g", f"k{i}", r, 0) for i in range(4) for r in ("high", "low")], "grp string, ticker string, regime string, d int")
    r = I.cluster_difference(same, ["grp"]).first()
    assert r["t_stat"] == 0 and r["p_value"] == 1 and r["test_valid"]
    shift = same.withColumn("d", F.when(F.col("regime") == "high", 1).otherwise(0))
    r = I.cluster_difference(shift, ["grp"]).first()
    assert not r["test_valid"] and r["inference_skip_reason"] == "zero_cluster_robust_se_nonzero_effect"


def test_bh_is_monotone_and_separate_by_family(spark):
    df = spark.createDataFrame([("A", "1", 0.01), ("A", "2", 0.04), ("A", "3", 0.03), ("B", "4", 0.04), ("B", "5", None)],
                               "family string, test_id string, p_value_raw double")
    q = {r["test_id"]: r["q_value_bh"] for r in I.benjamini_hochberg(df).collect()}
    assert q["1"] == pytest.approx(0.03) and q["2"] == pytest.approx(0.04) and q["3"] == pytest.approx(0.04)
    assert q["4"] == pytest.approx(0.04) and q["5"] is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", ["panel_walk_forward", "asset_walk_forward", "panel_walk_forward_tuned"])
def test_queries_forecast_every_registered_set(spark, monkeypatch, name):
    seen = {}
    monkeypatch.setattr(L, name.removesuffix("_tuned"), lambda df, sets, **how: seen.update(df=df, sets=sets) or df)
    entry.queries()[name](spark, SF)
    assert seen["sets"] == {r[0]: r[4] for r in registry.set_rows()} and len(seen["sets"]) == 17
    assert {f for fs in seen["sets"].values() for f in fs} | {"ticker", "timestamp", "target"} <= set(seen["df"].columns)


# ---- limits, gaps, effects and searches against one window at a time --------------------------------

def rough_panel(n=100, seed=5):
    """Heavy tails, gaps in one feature, a ticker that starts late and one that ends early."""
    rng = np.random.default_rng(seed)
    pdf = panel(n, ("A", "B", "C", "D"), seed)
    pdf["log_return_t"] = rng.standard_t(2, len(pdf)) + pdf["signal"]
    pdf["volume_diff"] = np.where(rng.random(len(pdf)) < 0.15, np.nan, rng.standard_t(3, len(pdf)))
    day = (pdf["timestamp"] - pdf["timestamp"].min()).dt.days
    return pdf[~((pdf.ticker == "D") & (day < n - 32)) & ~((pdf.ticker == "B") & (day > n - 12))].reset_index(drop=True)


def one_by_one(pdf, sets, days, grid=None, effects=False, assets=False, objective="log_loss"):
    out = {}
    pdf = pdf.sort_values(["timestamp", "ticker"])
    for part in ([g for _, g in pdf.groupby("ticker")] if assets else [pdf]):
        times = np.sort(part["timestamp"].unique())
        for tau in times[max(int(len(times) * 0.5), 30):]:
            for s, feats in sets.items():
                rows = part[(part["timestamp"] < tau) & ((part["timestamp"] >= tau - np.timedelta64(days, "D")) if days else True)].dropna(subset=feats)
                te = part[part["timestamp"] == tau].dropna(subset=feats)
                x, y, tk, ts = rows[feats].to_numpy(float), rows["target"].to_numpy(float), rows["ticker"].to_numpy(str), rows["timestamp"].to_numpy()
                if len(rows) < 20 or not len(te) or len(np.unique(y)) < 2:
                    continue
                if grid:
                    pre, w, c, score, status = R.tune(x, y, tk, ts, feats, effects, grid, objective, not assets)
                else:
                    pre = R.Preprocessor(x, tk, feats, effects)
                    w, c, score, status = R.fit_logit(pre(x, tk), y, 1.0), 1.0, None, "fixed"
                for t, p in zip(te["ticker"], R.predict_logit(w, pre(te[feats].to_numpy(float), te["ticker"].to_numpy(str)))):
                    out[s, pd.Timestamp(tau), t] = p, c, score, status
    return out


ROUGH = {"R": ["log_return_t", "signal"], "V": ["volume_diff", "noise"], "RV": ["volume_diff", "log_return_t", "signal"]}


@pytest.mark.parametrize("how", [{}, {"fixed_effects": True}, {"grid": L.C_GRID, "fixed_effects": True}, {"grid": (0.1, 10.0), "objective": "accuracy"}], ids=str)
def test_panel_fits_equal_one_window_at_a_time(spark, how):
    pdf = rough_panel()
    want = one_by_one(pdf, ROUGH, 45, how.get("grid"), how.get("fixed_effects", False), objective=how.get("objective", "log_loss"))
    got = L.panel_walk_forward(to_spark(spark, pdf).replace(float("nan"), None), ROUGH, days=45, chunk_days=20, **how).toPandas()
    assert len(got) == len(want)
    for r in got.itertuples():
        p, c, score, status = want[r.set_id, r.timestamp, r.ticker]
        assert r.hpo_status == status and r.best_C == c and abs(r.probability - p) < 1e-7, (r, p, c, status)
        assert (score is None and np.isnan(r.hpo_score)) or abs(r.hpo_score - score) < 1e-7


@pytest.mark.parametrize("how", [{}, {"grid": (0.1, 1.0)}], ids=str)
def test_asset_fits_equal_one_window_at_a_time(spark, how):
    pdf = rough_panel(130)
    want = one_by_one(pdf, ROUGH, None, how.get("grid"), assets=True)
    got = L.asset_walk_forward(to_spark(spark, pdf).replace(float("nan"), None), ROUGH, chunk=17, **how).toPandas()
    assert len(got) == len(want)
    for r in got.itertuples():
        p, c, _, status = want[r.set_id, r.timestamp, r.ticker]
        assert r.hpo_status == status and r.best_C == c and abs(r.probability - p) < 1e-7


@pytest.mark.parametrize("bucket_rows", [10 ** 6, 60, 7])
def test_quantiles_of_ranges(spark, bucket_rows):
    from barweave.operators.ranges import range_quantiles
    rng = np.random.default_rng(2)
    v = pd.DataFrame({"k": rng.choice(["a", "b"], 700, p=[0.9, 0.1]), "t": rng.integers(0, 200, 700), "v": np.round(rng.standard_cauchy(700), 1)})
    q = pd.DataFrame([(k, i, lo, lo + span) for k in "abc" for i, (lo, span) in enumerate([(0, 200), (10, 5), (50, 80), (199, 1), (300, 9), (20, 180), (7, 0)])], columns=["k", "win", "lo", "hi"])
    got = range_quantiles(spark.createDataFrame(v), spark.createDataFrame(q), ["k"], (0.005, 0.5, 0.995), bucket_rows).collect()
    assert {(r["k"], r["win"]) for r in got} == {(k, i) for k in "ab" for i in range(7)} and len(got) == 14
    for r in got:
        a = q[(q.k == r["k"]) & (q.win == r["win"])].iloc[0]
        seg = v[(v.k == r["k"]) & (v.t >= a.lo) & (v.t < a.hi)].v.to_numpy()
        assert r["n"] == len(seg)
        if len(seg):
            np.testing.assert_allclose(r["q"], np.quantile(seg, (0.005, 0.5, 0.995)), rtol=1e-12, atol=1e-12)
        else:
            assert all(np.isnan(x) for x in r["q"])
