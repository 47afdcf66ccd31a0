import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions import text as X
from barweave.functions.identity import canonical_ticker, universe_digest
from barweave.operators import audits as A
from barweave.operators import prices as P
from barweave.operators import slots as Z
from barweave.sources import bars as B
from barweave.sources import market as M
from barweave.sources import posts as Q
from barweave.sources import registry
from barweave.streaming import slots as T


def bars(n=60, tickers=("A", "B"), freq="D", seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for t in tickers:
        c = 100 * np.exp(np.cumsum(rng.normal(0, .02, n)))
        out.append(pd.DataFrame({"ticker": t, "timestamp": pd.date_range("2022-01-01", periods=n, freq=freq), "open": c, "high": c * 1.01,
                                 "low": c * .99, "close": c, "volume": rng.uniform(1, 9, n)}))
    return pd.concat(out, ignore_index=True)


def caps(n=60, tickers=("A", "B")):
    return pd.concat([pd.DataFrame({"ticker": t, "date": pd.date_range("2021-12-25", periods=n + 10, freq="D"),
                                    "market_cap": 1e6 + 1000.0 * np.arange(n + 10)}) for t in tickers])


def sp(spark, pdf, *ts):
    df = spark.createDataFrame(pdf)
    for c in ts:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def features(spark, b, c):
    return P.price_features(sp(spark, b, "timestamp"), sp(spark, c, "date"), "1d").toPandas().sort_values(["ticker", "timestamp"])


def test_windows_against_pandas(spark):
    b = bars()
    got = features(spark, b, caps())
    b["r"] = b.groupby("ticker")["close"].transform(lambda s: np.log(s / s.shift(1)))
    b["cum"] = b.groupby("ticker")["r"].transform(lambda s: s.rolling(21, min_periods=21).sum())
    b["vol"] = b.groupby("ticker")["r"].transform(lambda s: s.rolling(14, min_periods=14).std())
    j = got.merge(b, on=["ticker", "timestamp"])
    assert len(got) == 2 * (60 - 22)
    np.testing.assert_allclose(j["cum_log_return_21d"], j["cum"], atol=1e-12)
    np.testing.assert_allclose(j["realized_vol_14d"], j["vol"], atol=1e-12)
    assert (j["market_cap_available_at"] < j["timestamp"]).all()
    assert ((j["timestamp"] - j["market_cap_source_date"]).dt.days == 2).all()


def test_future_bars_and_values_leave_the_past_alone(spark):
    b, c = bars(), caps()
    late = b["timestamp"] >= "2022-02-20"
    b2 = b.copy()
    b2.loc[late, ["close", "volume"]] *= 1000
    c2 = c.copy()
    c2.loc[c2["date"] >= "2022-02-20", "market_cap"] *= 1000
    x, y = features(spark, b, c), features(spark, b2, c2)
    cut = pd.Timestamp("2022-02-18")
    cols = P.PRICE_FEATURES + ["target"]
    np.testing.assert_allclose(x.loc[x.timestamp <= cut, cols].astype(float), y.loc[y.timestamp <= cut, cols].astype(float))


def test_flat_next_bar_counts_as_up(spark):
    b = bars(30, ("A",))
    b.loc[26, "close"] = b.loc[25, "close"]
    got = features(spark, b, caps(30, ("A",)))
    assert got.loc[got.timestamp == b.loc[25, "timestamp"], "target"].item() == 1


POSTS = [
    (1, "2022-01-01 00:10:00", "A", "text", "positive", 0.5, 0.1), (2, "2022-01-01 05:59:59", "A", "[Removed] ", "negative", -0.3, 0.9),
    (3, "2022-01-01 06:00:00", "A", None, "neutral", 0.1, None), (4, "2022-01-01 07:00:00", "B", "x", "positive", 0.2, None)]


def posts(spark):
    df = spark.createDataFrame(POSTS, "post_id long, date string, ticker string, selftext string, vader_title_sentiment string, "
                                      "vader_title_score double, vader_selftext_score double")
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


def test_slots_by_hand(spark):
    got = Z.aggregate_slots(Z.blend_posts(posts(spark), ["vader"]), "6h", ["vader"]).orderBy("ticker", "timestamp").collect()
    a, b, c = got
    assert a["post_count"] == 2 and a["vader_bullishness_ratio"] == 0.5 and a["vader_directional_post_count"] == 2
    assert a["vader_combined_score_mean"] == pytest.approx((0.7 * 0.5 + 0.3 * 0.1 - 0.3) / 2)
    assert a["vader_title_score_std"] == pytest.approx(np.std([.5, -.3], ddof=1))
    assert b["vader_bullishness_ratio"] is None and b["vader_title_score_std"] == 0.0 and b["vader_selftext_score_mean"] is None
    assert c["vader_bullishness_ratio"] == 1.0


def test_empty_slot_is_filled_neutrally(spark):
    price = spark.sql("select 'A' ticker, timestamp_ntz'2022-01-01 00:00:00' timestamp, 1.0 r union all "
                      "select 'A', timestamp_ntz'2022-01-03 00:00:00', cast(null as double)")
    s = Z.aggregate_slots(Z.blend_posts(posts(spark), ["vader"]), "6h", ["vader"])
    r = {x["timestamp"].day: x for x in Z.merge_features(price, s).collect()}[3]
    assert r["vader_bullishness_ratio"] == 0.5 and r["vader_title_score_mean"] == 0 and r["post_count"] == 0
    assert r["log1p_post_count"] == 0 and r["has_posts"] == 0 and r["r"] is None
    from barweave.sources.registry import count_partner, group_of, neutral_values
    assert neutral_values("vader_score_weighted_mean") == (None, 0.0) and neutral_values("post_count") == (0, None) and neutral_values("vader_title_score_std") == (0.0, 0.0)
    assert neutral_values("cryptobert_bullishness_ratio") == (0.5, 0.5) and group_of("Realized_vol_14d") == "volatility" and group_of("x_post_count") == "other"
    assert count_partner("vader_title_score_mean", ["post_count", "vader_post_count"]) == "vader_post_count" and count_partner("has_posts", ["post_count"]) == "post_count"
    assert count_partner("volume_diff", ["post_count"]) is None and count_partner("vader_title_score_mean", ["x"]) is None


def test_stream_emits_completed_slots_once(spark, tmp_path):
    src = str(tmp_path / "posts")
    p = Z.blend_posts(posts(spark), ["vader"]).drop("vader_combined_score", "has_usable_selftext")
    p.unionByName(p.where("post_id = 1")).coalesce(1).write.parquet(src)
    late = spark.sql("select 9L post_id, timestamp_ntz'2022-01-02 00:00:00' date, 'A' ticker, 'x' selftext, 'positive' vader_title_sentiment, "
                     "0.9D vader_title_score, cast(null as double) vader_selftext_score")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for extra in (None, late):
        if extra is not None:
            extra.coalesce(1).write.mode("append").parquet(src)
        T.write_available(T.stream_slots(T.read_posts(spark, src, p.schema), "6h", "1 hour", ["vader"]), out, ck)
    got = {(r["ticker"], r["timestamp"].hour): r["post_count"] for r in spark.read.parquet(out).collect()}
    assert got == {("A", 0): 2, ("A", 6): 1, ("B", 6): 1}


def test_cleaning_in_order(spark):
    cases = {
        "see https://a.b/c?d now": "see now", "u/bob and /r/sub hi": "and hi", "**bold** _it_ ~~no~~": "bold it no",
        "[label](http://x.y) end": "[label]( end", "[label](rel) end": "label end", "# Title\n> quote": "Title quote",
        "a &amp; b &lt;c": "a & b <c", "```x\ny``` `code`": "code", "  ": "  "}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("c", X.clean_text("t"))
    assert {r["t"]: r["c"] for r in df.collect()} == cases


def test_lexicon_context(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.5)], "token string, valence double")
    df = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "very good"), (4, "not a b c good"), (5, "plain words"), (6, None)], "id int, t string")
    s = {r["id"]: r for r in X.lexicon_scores(df, "id", "t", lex).collect()}
    f = lambda v: round(v / math.sqrt(v * v + 15), 4)
    assert s[1]["score"] == f(2) and s[2]["score"] == f(-1.48) and s[3]["score"] == f(2.293) and s[4]["score"] == f(2)
    assert s[5]["score"] == 0 and s[5]["sentiment"] == "neutral" and s[6]["score"] is None and s[2]["sentiment"] == "negative"


def test_bar_files(spark, tmp_path):
    for t, h, freq in (("xno", "1d", "D"), ("BTC", "6h", "6h")):
        b = bars(10, (t,), freq).drop(columns="ticker")
        b["open_time"] = b["timestamp"].astype("datetime64[ms]").astype("int64")
        b = b.drop(columns="timestamp").rename(columns={"close": "Close"})
        dup = pd.concat([b, b.tail(1).assign(Close=7.0)])
        d = tmp_path / h
        d.mkdir()
        dup.to_parquet(d / f"{t}USDT_{h}.parquet")
    raw = B.read_bars(spark, str(tmp_path))
    got = B.normalise_bars(raw)
    assert {(r["ticker"], r["horizon"]): r["count"] for r in got.groupBy("ticker", "horizon").count().collect()} == {("NANO", "1d"): 10, ("BTC", "6h"): 10}
    q = A.bar_quality(B.validation_bars(raw.withColumn("seq", F.monotonically_increasing_id()), "seq"), "seq").collect()
    assert all(r["n_duplicates"] == 1 and r["status"] == "issues" for r in q)
    assert got.agg(F.min("timestamp")).first()[0] == pd.Timestamp("2022-01-01")


def test_files_without_a_series_name(spark, tmp_path):
    for name, unit in (("BTCUSDT_1d", "ms"), ("ETHEUR_1d", "s"), ("notes", "s")):
        b = bars(3, ("x",), "D").drop(columns="ticker")
        b["open_time"] = b["timestamp"].astype(f"datetime64[{unit}]").astype("int64")
        b.drop(columns="timestamp").to_parquet(tmp_path / f"{name}.parquet")
    got = B.normalise_bars(B.read_bars(spark, str(tmp_path), quotes=("USDT", "EUR"))).groupBy("ticker").agg(F.count("*").alias("n"), F.min("timestamp").alias("t")).collect()
    assert {(r["ticker"], r["n"], str(r["t"])[:10]) for r in got} == {("BTC", 3, "2022-01-01"), ("ETH", 3, "2022-01-01")}
    assert [r["path"].rsplit("/")[-1] for r in B.unnamed_files(spark, str(tmp_path), ("USDT", "EUR")).collect()] == ["notes.parquet"]


def test_post_files_and_dedup(spark, tmp_path):
    (tmp_path / "a.csv").write_text('submission,subreddit,created,removed,upvote_ratio,score,total_awards_received,num_comments,num_crossposts,selftext,title\n'
                                    's1,aa,1640995200,0,0.9,3,0,1,0,"two\nlines, ""quoted""",hello\ns1,aa,1640998800,0,0.9,3,0,1,0,again,hello\n')
    (tmp_path / "b.csv").write_text('submission,subreddit,created,removed,upvote_ratio,score,total_awards_received,num_comments,num_crossposts,selftext,title\n'
                                    's2,bb,1640995200,1,0.5,1,0,0,0,,t\n')
    m = spark.createDataFrame([("aa", "BTC", "yes"), ("bb", "ETH", "no")], "subreddit string, ticker string, included string")
    got = Q.tidy_posts(Q.read_posts(spark, str(tmp_path / "*.csv"), m)).collect()
    gone = spark.createDataFrame([("aa", "BTC", "yes"), ("cc", "SOL", "yes")], m.schema)
    assert [r["subreddit"] for r in Q.missing_communities(Q.read_posts(spark, str(tmp_path / "*.csv"), gone), gone).collect()] == ["cc"]
    assert len(got) == 1 and got[0]["selftext"] == 'two\nlines, "quoted"' and got[0]["weekday"] == "Saturday" and got[0]["month"] == "2022-01"


def test_signal_files(spark, tmp_path):
    base = pd.DataFrame({"timestamp": pd.date_range("2022-01-01", periods=3), "ticker": "A", "target": [1, 0, 1], "prediction": [1, 1, 0],
                         "probability": [.6, .7, None], "set_id": "ECON", "sentiment_model": "None", "horizon": "1d"})
    (tmp_path / "1d").mkdir()
    base.to_parquet(tmp_path / "1d" / "a.parquet")
    base.assign(model_type="panel_logit", hpo_enabled="True").to_parquet(tmp_path / "1d" / "b.parquet")
    got = Q.read_signals(spark, str(tmp_path), "1d").orderBy("model_type").toPandas()
    assert len(got) == 4 and set(got.sentiment_model) == {"-"} and list(got.model_type.unique()) == ["panel_logit", "per_asset"]
    assert (got.forecast_origin - got.timestamp == pd.Timedelta(days=1)).all() and got.hpo_enabled.sum() == 2
    with pytest.raises(ValueError):
        Q.normalise_signals(spark.createDataFrame(base.drop(columns="target")))
    base.assign(horizon="6h", hpo_objective=" ").to_parquet(tmp_path / "1d" / "c.parquet")
    (tmp_path / "1d" / "d.parquet").write_bytes(b"PAR1 broken PAR1")
    with pytest.raises(Exception):
        Q.read_signals(spark, str(tmp_path), "1d").count()
    got = Q.read_signals(spark, str(tmp_path), "1d", skip_unreadable=True)
    assert got.count() == 4 and [r["path"].rsplit("/")[-1] for r in Q.skipped_files(spark, str(tmp_path), "1d").collect()] == ["d.parquet"]


def test_provenance_and_consistency(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ticker,Interval,Venue,Pair,quote_currency,gaps,coverage,start,end\nbtc,1H,x,BTC/USDT,USDT,2,99.5,2020,2021\nbtc,1d,y,BTC/USDT,USDT,0,100,2020,2021\n")
    (tmp_path / "b.csv").write_text("coin,horizon,exchange,symbol,quote,missing_bars\nBTC,1h,x,BTC/USDT,USDT,7\n")
    p = Q.read_provenance(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert p.count() == 2 and p.agg(F.sum("missing_bars")).first()[0] == 2
    r = A.source_consistency(p.withColumns({"first_date": F.col("first_date").cast("string"), "last_date": F.col("last_date").cast("string")})).first()
    assert not r["exchange_consistent"] and r["symbol_consistent"] and r["exchange_1d"] == "y" and r["n_horizons"] == 2


def overlapping_provenance(spark):
    rows = [("1h", 1, 10.0, "2021-05-01"), ("1h", 1, 90.0, "2020-05-01"), ("1h", 2, 5.0, "2019-05-01"), ("1h", None, 1.0, "2018-05-01"),
            ("6h", 3, 70.0, None), ("6h", 3, 80.0, "2020-01-01")]
    rows = spark.createDataFrame([("BTC", h, "x", "BTC/USDT", "USDT", *r) for h, *r in rows],
                                 "coin string, horizon string, exchange string, symbol string, quote string, missing_bars long, coverage_pct double, first_date string")
    a = Q.normalise_provenance(rows.withColumn("last_date", F.lit("2022-01-01")), "a.csv")
    return Q.union_provenance([a, a.withColumns({"missing_bars": F.lit(0).cast("long"), "source_file": F.lit("b.csv")})])


def test_provenance_overlap_within_a_table(spark):
    got = {r["horizon"]: (r["missing_bars"], r["coverage_pct"], r["first_date"], r["source_file"]) for r in overlapping_provenance(spark).collect()}
    assert got == {"1h": (1, 90.0, "2020-05-01", "a.csv"), "6h": (3, 80.0, "2020-01-01", "a.csv")}


def test_consistency_of_overlapping_provenance(spark):
    r = A.source_consistency(overlapping_provenance(spark)).first()
    assert (r["coverage_min"], r["coverage_max"], r["first_date"], r["missing_bars"]) == (80.0, 90.0, "2020-01-01", 4)


def test_consistency_passes_over_unknown_sources(spark):
    rows = [("BTC", "1h", None, "A", "USDT"), ("BTC", "1h", "x", None, "USDT"), ("BTC", "1h", "y", "B", "USD"), ("BTC", "6h", None, None, "USDT"),
            ("BTC", None, "a", "a", "a")]
    p = spark.createDataFrame(rows, "coin string, horizon string, exchange string, symbol string, quote string").withColumns({
        "coverage_pct": F.lit(1.0), "first_date": F.lit("2020"), "last_date": F.lit("2021"), "missing_bars": F.lit(0)})
    r = A.source_consistency(p).first()
    assert [r[f"{c}_1h"] for c in ("exchange", "symbol", "quote")] == ["x", "B", "USDT"]
    assert [r[f"{c}_6h"] for c in ("exchange", "symbol", "quote")] == [None, None, "USDT"] and r["exchange_1d"] is None


def test_wide_headers(spark):
    w = spark.sql("select date'2022-01-01' date, 5L `000000000001_BTC`, -1L `000000001027_ETH`, 7L `000000001567_XNO`, 9L `weird name!`")
    got = {r["ticker"]: r["market_cap"] for r in M.wide_to_long(w).collect()}
    assert got == {"BTC": 5.0, "NANO": 7.0}


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("1d", 1), ("6h", 2)], "horizon string, x int")
    Q.write_parquet(df, str(tmp_path / "t"), ["horizon"])
    with pytest.raises(Exception):
        Q.write_parquet(df, str(tmp_path / "t"), ["horizon"])
    assert spark.read.parquet(str(tmp_path / "t")).where("horizon = '6h'").count() == 1
    Q.write_csv(df, str(tmp_path / "c"), ["x"])


def test_registry_and_universe(spark):
    rows = registry.set_rows()
    assert len(rows) == 17 and sum(r[1] == "combined" for r in rows) == 8
    df = spark.createDataFrame([("btc",), ("ETH ",), ("BTC",)], "ticker string")
    import hashlib
    want = hashlib.sha256(b"BTC|ETH").hexdigest()[:8]
    assert df.agg(universe_digest(F.col("ticker")).alias("h")).first()["h"] == want
    assert [r[0] for r in df.select(canonical_ticker("ticker")).collect()] == ["BTC", "ETH", "BTC"]


def test_gate_stops_on_a_violation(spark):
    bad = spark.sql("select timestamp_ntz'2022-01-02' timestamp, timestamp_ntz'2022-01-02' market_cap_available_at")
    with pytest.raises(ValueError):
        A.require_empty(A.asof_violations(bad), "as-of")


def test_constant_columns_have_no_correlation_but_zero_moments(spark):
    from barweave.functions.numeric import correlation, sample_kurtosis, sample_skewness, slope
    df = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "a double, b double")
    r = df.agg(correlation("a", "b").alias("r"), slope("b", "a").alias("s"), F.count("a").alias("n"), F.skewness("a").alias("k"),
               F.kurtosis("a").alias("u"), correlation("b", "b").alias("one"))
    x = r.select("*", sample_skewness("n", "k").alias("sk"), sample_kurtosis("n", "u").alias("ku")).first()
    assert x["r"] is None and x["s"] is None and x["one"] == 1.0 and x["sk"] == 0 and x["ku"] == 0


def test_contract_checked_scan(spark, tmp_path):
    from barweave.sources.tables import SLOT_CONTRACT, read_features
    df = spark.sql("select '2022-01-01T06:00:00Z' timestamp, 'A' ticker, 1L post_count, '6h' horizon")
    Q.write_parquet(df, str(tmp_path / "s"), ["horizon"])
    assert read_features(spark, str(tmp_path / "s"), SLOT_CONTRACT, "6h").first()["timestamp"] == pd.Timestamp("2022-01-01 06:00:00")
    assert read_features(spark, str(tmp_path / "s"), SLOT_CONTRACT, "1d").count() == 0
    with pytest.raises(ValueError):
        read_features(spark, str(tmp_path / "s"))


def test_chunks_resume_and_gates_stop_them(spark, tmp_path):
    from barweave.sources import posts as Q
    path = str(tmp_path / "chunks")
    df = spark.createDataFrame([(k, i) for k in "abc" for i in range(4)], "k string, v int")
    assert Q.write_chunks(df.where("k < 'c'"), path, "k", "s1") == ["a", "b"]
    assert Q.write_chunks(df, path, "k", "s1") == ["c"] and Q.write_chunks(df, path, "k", "s1") == []
    (tmp_path / "chunks" / "k=b").rename(tmp_path / "gone")  # another signature writes everything again
    assert Q.write_chunks(df, path, "k", "s2") == ["a", "b", "c"]
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == sorted((k, i) for k in "abc" for i in range(4))
    with pytest.raises(ValueError, match="k=a: 1 rows break the gate"):
        Q.write_chunks(df, path, "k", "s3", gate=F.col("v") == 2)
    assert not (tmp_path / "chunks" / "k=a").exists() and not Q.committed(spark, path, "s3")
