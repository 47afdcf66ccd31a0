import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barweave.functions.tails import kolmogorov_tail
from barweave.operators import series as S
from tests import reference_series as R


def test_unit_root_battery_separates_noise_from_walks():
    rng = np.random.default_rng(0)
    hits = {"noise": 0, "walk": 0}
    for _ in range(20):
        e = rng.normal(size=300)
        for name, y in (("noise", e), ("walk", np.cumsum(e))):
            o = R._battery(y)
            hits[name] += all(o[f"{t}_c_reject"] for t in ("adf", "pp", "dfgls"))
            if name == "noise":
                assert o["adf_c_stat"] < -5
    assert hits["noise"] >= 19 and hits["walk"] <= 2


def test_adf_statistic_by_hand():
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=80))
    stat, lag = R.adf_stat(y, "c", 0)
    dy, x = np.diff(y), np.column_stack([y[:-1], np.ones(79)])
    b = np.linalg.solve(x.T @ x, x.T @ dy)
    u = dy - x @ b
    assert lag == 0 and np.isclose(stat, b[0] / math.sqrt(u @ u / 77 * np.linalg.inv(x.T @ x)[0, 0]))


def test_kpss_rejects_a_walk():
    rng = np.random.default_rng(2)
    e = rng.normal(size=400)
    assert R.kpss_stat(e, "c")[0] < 0.463 < R.kpss_stat(np.cumsum(e), "c")[0]
    trend = e + 0.1 * np.arange(400)
    assert R.kpss_stat(trend, "c")[0] > 0.463 and R.kpss_stat(trend, "ct")[0] < 0.146


def test_long_memory_of_noise_and_walk():
    rng = np.random.default_rng(3)
    e = rng.normal(size=4096)
    assert abs(R.gph(e)[0]) < 0.3 and 0.7 < R.gph(np.cumsum(e))[0] < 1.3


def test_breaks_are_found_where_they_are():
    rng = np.random.default_rng(4)
    y = np.r_[rng.normal(0, 1, 100), rng.normal(6, 1, 100), rng.normal(-3, 1, 100)]
    b, _ = R.detect_breaks(y)
    assert len(b) == 2 and abs(b[0] - 100) <= 2 and abs(b[1] - 200) <= 2
    assert R.detect_breaks(rng.normal(size=200))[0] == []
    assert len(R.detect_breaks(y, fixed=1)[0]) == 1


def test_segment_is_the_best_single_split():
    rng = np.random.default_rng(5)
    y = rng.normal(size=50)
    best = min(range(10, 41), key=lambda k: ((y[:k] - y[:k].mean()) ** 2).sum() + ((y[k:] - y[k:].mean()) ** 2).sum())
    assert R.segment(y, 10, 1) == [best]


def long(spark, n=240, walk=False, tickers=6):
    rng = np.random.default_rng(6)
    common = np.cumsum(rng.normal(size=n))
    rows = []
    for k in range(tickers):
        e = rng.normal(size=n)
        y = np.cumsum(e) + common if walk else e + common
        rows.append(pd.DataFrame({"ticker": f"K{k}", "timestamp": pd.date_range("2020-01-01", periods=n), "feature": "f", "v": y}))
    return spark.createDataFrame(pd.concat(rows)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def test_cips_rejects_only_without_unit_roots(spark):
    a, b = S.cips(long(spark)).first(), S.cips(long(spark, walk=True)).first()
    assert a["cips_reject"] and a["n_sections"] == 6 and not b["cips_reject"]


def test_fold_statistics_match_definitions(spark):
    df = long(spark, 200, tickers=1).withColumn("v", F.round("v", 0))
    got = S.fold_stability(df, 4).orderBy("fold").collect()
    y = df.orderBy("timestamp").toPandas()["v"].to_numpy()
    for r in got:
        tr, va = y[:40 * r["fold"]], y[40 * r["fold"]:40 * (r["fold"] + 1)]
        grid = np.unique(np.r_[tr, va])
        ks = max(abs((tr <= g).mean() - (va <= g).mean()) for g in grid)
        assert np.isclose(r["ks_stat"], ks)
        rank = pd.Series(np.r_[tr, va]).rank().to_numpy()
        nx, ny = len(tr), len(va)
        u = nx * ((np.sort(rank[:nx]) - np.arange(1, nx + 1)) ** 2).sum() + ny * ((np.sort(rank[nx:]) - np.arange(1, ny + 1)) ** 2).sum()
        assert np.isclose(r["cvm_stat"], u / (nx * ny * (nx + ny)) - (4 * nx * ny - 1) / (6 * (nx + ny)))


def test_tail_tables():
    # published 5 % points: Kolmogorov 1.358, Cramer-von Mises 0.461
    assert abs(kolmogorov_tail(1.358) - 0.05) < 5e-4
    assert abs(S.cvm_tail(0.461, 5000, 5000) - 0.05) < 2e-3


def test_half_life(spark):
    rng = np.random.default_rng(7)
    y = np.zeros(2000)
    for i in range(1, 2000):
        y[i] = 0.8 * y[i - 1] + rng.normal()
    rho, se, half = R.ar1(y)
    assert abs(rho - 0.8) < 4 * se and np.isclose(half, -math.log(2) / math.log(rho))


def panel(spark):
    """Series of many lengths and shapes, with gaps, a flat one and nulls."""
    rng = np.random.default_rng(11)
    frames, arrays = [], {}
    for k, (n, kind) in enumerate([(40, "noise"), (60, "walk"), (180, "trend"), (420, "noise"), (700, "walk"), (900, "ar"), (1500, "steps"), (250, "flat"), (35, "ar")]):
        e = rng.normal(size=n)
        y = {"noise": e, "walk": np.cumsum(e), "trend": e + 0.05 * np.arange(n), "flat": np.full(n, 3.0),
             "steps": e + np.repeat([0, 4, -3], -(-n // 3))[:n]}.get(kind)
        if y is None:
            y = np.zeros(n)
            for i in range(1, n):
                y[i] = 0.7 * y[i - 1] + e[i]
        y = y + 5 * k
        times = pd.date_range("2020-01-01", periods=n)
        arrays[f"K{k}"] = (y, times)
        frames.append(pd.DataFrame({"ticker": f"K{k}", "timestamp": times, "feature": "f", "v": y}))
        frames.append(pd.DataFrame({"ticker": [f"K{k}"], "timestamp": [pd.Timestamp("2019-01-01")], "feature": "f", "v": [np.nan]}))
    df = spark.createDataFrame(pd.concat(frames).sample(frac=1, random_state=1)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return df, arrays


def close(a, b, tol=1e-6):
    a, b = (None if x is None or x != x else x for x in (a, b))
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= tol * max(1, abs(b))


def test_battery_from_sums_equals_whole_series(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 128)  # many chunks a series
    monkeypatch.setattr(S._chunked, "__defaults__", (128,))
    df, arrays = panel(spark)
    got = {r["ticker"]: r.asDict() for r in S.series_tests(df).collect()}
    assert set(got) == set(arrays)
    for k, (y, _) in arrays.items():
        want = R._battery(y)
        for name, value in want.items():
            if not name.startswith("gph"):
                have = got[k][name]
                assert have == value if isinstance(value, (bool, int)) else close(have, value), (k, name, have, value)
        if got[k]["joint_class"] == "conflicting":
            assert close(got[k]["gph_d"], want["gph_d"])


def test_kpss_bandwidth_has_no_cap(spark, monkeypatch):
    """Negative autocovariances bring the rule's denominator near 0, and the bandwidth far above n^(1/3)."""
    monkeypatch.setattr(S, "CHUNK", 64)
    monkeypatch.setattr(S._chunked, "__defaults__", (64,))
    rng = np.random.default_rng(12)
    arrays, frames = {}, []
    for k, (n, kind) in enumerate([(300, "diff"), (1000, "diff"), (3000, "diff"), (700, "ar"), (1500, "ar"), (900, "trended")]):
        e = rng.normal(size=n + 1)
        y = np.diff(e) + (0.01 * np.arange(n) if kind == "trended" else 0)
        if kind == "ar":
            y = np.zeros(n)
            for i in range(1, n):
                y[i] = -0.9 * y[i - 1] + e[i]
        arrays[f"K{k}"] = y
        frames.append(pd.DataFrame({"ticker": f"K{k}", "timestamp": pd.date_range("2020-01-01", periods=n), "feature": "f", "v": y}))
    df = spark.createDataFrame(pd.concat(frames)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    wide = 0
    for r in S.series_tests(df).collect():
        y = arrays[r["ticker"]]
        for kind in ("c", "ct"):
            stat, lags = R.kpss_stat(y, kind)
            wide += lags > 64
            assert close(r[f"kpss_{kind}_stat"], stat) and r[f"kpss_{kind}_reject"] == (stat > S.KPSS_5[kind]), (r["ticker"], kind, lags)
    assert wide >= 4


def test_long_memory_equals_whole_series(spark):
    df, arrays = panel(spark)
    for r in S.long_memory(df).collect():
        y = arrays[r["ticker"]][0]
        g = R.gph(y) if len(y) >= 200 and np.ptp(y) > 0 else None
        assert r["gph_n"] == len(y) and all(close(a, b) for a, b in zip((r["gph_d"], r["gph_se"], r["gph_pval_d0"], r["gph_m"]), g or (None,) * 4))


def test_long_memory_does_not_depend_on_chunks(spark, monkeypatch):
    df, _ = panel(spark)
    whole = sorted(map(tuple, S.long_memory(df).collect()))
    monkeypatch.setattr(S, "CHUNK", 37)
    parts = sorted(map(tuple, S.long_memory(df).collect()))
    assert len(whole) == len(parts) and all(close(a, b) if isinstance(a, float) else a == b for x, y in zip(whole, parts) for a, b in zip(x, y))


def test_breaks_equal_whole_series(spark):
    df, arrays = panel(spark)
    for fixed in (None, 2):
        for r in S.structural_breaks(df, fixed=fixed).collect():
            y, times = arrays[r["ticker"]]
            if np.ptp(y) == 0:
                continue  # every split gains nothing
            b, score = R.detect_breaks(y, fixed=fixed)
            assert [pd.Timestamp(x) for x in r["break_timestamps"]] == [times[i] for i in b] and close(r["best_bic"], score)
            seg = np.diff([0, *b, len(y)])
            assert r["segment_lengths"] == list(seg) and r["median_segment_length"] == np.median(seg) and close(r["mean_segment_length"], seg.mean())


def test_cips_equals_sections(spark):
    df = long(spark, 120).where("not (ticker = 'K2' and dayofmonth(timestamp) = 9)")
    pdf = df.toPandas()
    pdf["bar"] = pdf.groupby("timestamp").v.transform("mean")
    at = {t: i for i, t in enumerate(sorted(pdf.timestamp.unique()))}
    for kind in ("c", "ct"):
        ts = []
        for _, g in pdf.groupby("ticker"):
            g = g.sort_values("timestamp")
            ts.append(R.cips_t(g.v.to_numpy(), g.bar.to_numpy(), np.array([at[t] for t in g.timestamp]), kind))
        want = np.mean(np.clip(ts, *S.CIPS_CLIP))
        assert close(S.cips(df, kind).first()["cips_stat"], want)


def test_corrected_p_values(spark):
    rows = [("1d", f"t{i}", "f", p, 0.5 if i == 0 else None) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.9])] + [("6h", "t0", "f", 0.02, 0.1)]
    got = {(r["horizon"], r["ticker"]): r for r in S.corrected(spark.createDataFrame(rows, "horizon string, ticker string, feature string, a_pval double, b_pval_c double"), ["a_pval", "b_pval_c"]).collect()}
    assert len(got) == 6
    q = [got["1d", f"t{i}"]["a_pval_bh"] for i in range(5)]
    np.testing.assert_allclose([q[0], q[1], q[2], q[4]], [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.9])
    assert q[3] is None and got["1d", "t0"]["a_reject_bh"] and not got["1d", "t4"]["a_reject_bh"] and got["1d", "t3"]["a_reject_bh"] is None
    assert got["6h", "t0"]["a_pval_bh"] is None and all(r["b_pval_c_bh"] is None and r["b_reject_c_bh"] is None for r in got.values())  # fewer than two p-values
