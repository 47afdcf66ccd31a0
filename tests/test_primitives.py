import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions.tails import student_two_sided
from barweave.functions.times import epoch_unit, normalise_times
from barweave.operators.asof import asof_join
from barweave.operators.quantiles import average_ranks, percentiles, tercile, with_value_position
from barweave.operators.sequence import keep_first, keep_last, running, sliding, with_position


def series(n=900, tickers=("A", "B"), seed=1, hot=0):
    rng = np.random.default_rng(seed)
    frames = []
    for i, t in enumerate(tickers):
        m = n * (hot if i == 0 and hot else 1)
        steps = rng.integers(1, 40, m).cumsum()
        frames.append(pd.DataFrame({"ticker": t, "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(steps, "h"),
                                    "v": rng.normal(size=m)}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if "ts" in pdf else df


def test_position_matches_pandas(spark):
    pdf = series(hot=3)
    got = with_position(to_spark(spark, pdf), ["ticker"], "ts").toPandas().sort_values(["ticker", "ts"])
    exp = pdf.sort_values(["ticker", "ts"]).groupby("ticker").cumcount()
    assert (got["_pos"].to_numpy() == exp.to_numpy()).all()


def test_sliding_equals_whole_key_window(spark):
    pdf = series()
    got = sliding(to_spark(spark, pdf), ["ticker"], "ts", {
        "prev": lambda w: F.lag("v").over(w),
        "nxt": lambda w: F.lead("v").over(w),
        "s": lambda w: F.sum("v").over(w.rowsBetween(-9, 0)),
    }, before=10, after=1, chunk=32).toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)
    p = pdf.sort_values(["ticker", "ts"]).reset_index(drop=True)
    g = p.groupby("ticker")["v"]
    assert len(got) == len(p)
    np.testing.assert_allclose(got["prev"], g.shift(1), equal_nan=True)
    np.testing.assert_allclose(got["nxt"], g.shift(-1), equal_nan=True)
    np.testing.assert_allclose(got["s"], g.rolling(10, min_periods=1).sum().to_numpy(), atol=1e-12)


def test_running_total_and_max(spark):
    pdf = series(hot=2)
    got = running(to_spark(spark, pdf), ["ticker"], "ts", sums={"cs": F.col("v")}, maxes={"cm": F.col("v")}) \
        .toPandas().sort_values(["ticker", "ts"])
    g = pdf.sort_values(["ticker", "ts"]).groupby("ticker")["v"]
    np.testing.assert_allclose(got["cs"], g.cumsum(), atol=1e-10)
    np.testing.assert_allclose(got["cm"], g.cummax())


def test_asof_equals_merge_asof(spark):
    left, right = series(seed=2), series(n=120, seed=3).rename(columns={"v": "w"})
    right["ts2"] = right["ts"]
    extra = left.sample(60, random_state=0)[["ticker", "ts"]].assign(w=9.0)
    extra["ts2"] = extra["ts"]
    right = pd.concat([right, extra]).drop_duplicates(["ticker", "ts"])
    for strict in (True, False):
        r = spark.createDataFrame(right).withColumns(
            {"ts": F.col("ts").cast("timestamp_ntz"), "ts2": F.col("ts2").cast("timestamp_ntz")})
        got = asof_join(to_spark(spark, left), r, "ticker", "ts", "ts2", ["ts2", "w"], strict=strict,
                        block_days=5).toPandas()
        exp = pd.merge_asof(left.sort_values("ts"), right[["ticker", "ts", "w"]].sort_values("ts"), on="ts",
                            by="ticker", allow_exact_matches=not strict)
        a = got.sort_values(["ticker", "ts"])["w"].to_numpy()
        b = exp.sort_values(["ticker", "ts"])["w"].to_numpy()
        np.testing.assert_allclose(a, b, equal_nan=True)


def test_asof_equality_does_not_match(spark):
    d = spark.sql("select 'A' k, timestamp_ntz'2020-01-02' t")
    r = spark.sql("select 'A' k, timestamp_ntz'2020-01-02' a, 1.0 x")
    assert asof_join(d, r, "k", "t", "a", ["x"]).first()["x"] is None
    assert asof_join(d, r, "k", "t", "a", ["x"], strict=False).first()["x"] == 1


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", "z"], 5000, p=[.8, .15, .05]),
                        "v": np.where(rng.random(5000) < .3, 1.5, rng.lognormal(0, 3, 5000))})
    qs = [0.005, 0.25, 0.5, 0.9, 1.0]
    got = percentiles(spark.createDataFrame(pdf), ["g"], "v", qs, list("abcde"), buckets=64).toPandas().set_index("g")
    for g, grp in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, list("abcde")].astype(float), np.quantile(grp["v"], qs), rtol=1e-12)
    whole = percentiles(spark.createDataFrame(pdf), [], "v", [.5], ["m"]).first()["m"]
    assert abs(whole - pdf["v"].median()) < 1e-12


def test_average_ranks(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": "x", "v": rng.integers(0, 50, 400).astype(float)})
    got = average_ranks(spark.createDataFrame(pdf), ["g"], "v", buckets=8).toPandas().set_index("v")["rank"]
    exp = pdf["v"].rank()
    assert all(got[v] == r for v, r in zip(pdf["v"], exp))


def test_terciles_25_and_30(spark):
    for n, want in ((30, [10, 10, 10]), (25, [8, 8, 9])):
        df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 1.0).alias("v"), "id")
        out = with_value_position(df, ["k"], "v", ["id"]).withColumn("r", tercile("_pos", "_n"))
        c = {r["r"]: r["count"] for r in out.groupBy("r").count().collect()}
        assert [c["low"], c["mid"], c["high"]] == want


def test_dedup_directions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, seq int, v string")
    assert keep_first(df, ["k"], "seq").first()["v"] == "x"
    assert keep_last(df, ["k"], "seq").first()["v"] == "y"


def test_epoch_units(spark):
    for unit, scale in (("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)):
        df = spark.createDataFrame([(1_600_000_000 * scale,), (1_600_000_060 * scale,)], "t long")
        assert epoch_unit(df, "t").first()["unit"] == unit
        out = normalise_times(df, "t").select(F.min("timestamp").cast("string").alias("m")).first()["m"]
        assert out == "2020-09-13 12:26:40"
    text = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("bad",)], "t string")
    assert [r["timestamp"] is None for r in normalise_times(text, "t").collect()] == [False, True]


def test_student_tail():
    assert abs(student_two_sided(2.0, 10) - 0.0733880348) < 1e-9
    assert abs(student_two_sided(0.0, 5) - 1.0) < 1e-12


def test_epoch_units_per_series(spark):
    df = spark.createDataFrame([("A", 1640995200000), ("A", 1641081600000), ("B", 1640995200), (None, 1640995200000000)], "ticker string, t long")
    got = {r["ticker"]: str(r["m"]) for r in normalise_times(df, "t", by=["ticker"]).groupBy("ticker").agg(F.min("timestamp").alias("m")).collect()}
    assert set(got) == {"A", "B", None} and set(got.values()) == {"2022-01-01 00:00:00"}


def test_heavy_tails_do_not_crowd_a_bucket(spark):
    from barweave.operators.quantiles import BUCKETS, value_histogram
    rng = np.random.default_rng(5)
    v = np.append(np.exp(2.5 * rng.standard_normal(60_000)), 1e9)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v}))
    sizes = [r["count"] for r in value_histogram(df, ["k"], "v").groupBy("_bucket").count().collect()]
    assert len(sizes) == BUCKETS and max(sizes) <= 2 * len(v) / BUCKETS
    got = percentiles(df, ["k"], "v", [0.001, 0.5, 0.9999], ["a", "b", "c"]).first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.quantile(v, [0.001, 0.5, 0.9999]), rtol=1e-12)


def test_slot_scores_are_not_rounded(spark):
    from barweave.operators.slots import aggregate_slots, blend_posts
    rows = [("A", "2022-01-01 01:00:00", s) for s in (0.123456789, 0.000001, 0.000004)] + [("B", "2022-01-01 02:00:00", 1e-7), ("B", "2022-01-01 03:00:00", 2e-7)]
    p = spark.createDataFrame(rows, "ticker string, d string, s double").select(
        "ticker", F.col("d").cast("timestamp_ntz").alias("date"), F.lit("x").alias("selftext"), F.lit("neutral").alias("vader_title_sentiment"),
        F.col("s").alias("vader_title_score"), F.lit(None).cast("double").alias("vader_selftext_score"))
    for crowd in (100, 1):  # in one task, and by the distributed percentile
        got = {r["ticker"]: r["vader_title_score_median"] for r in aggregate_slots(blend_posts(p, ["vader"]), "6h", ["vader"], crowd).collect()}
        assert got["A"] == 0.000004 and abs(got["B"] - 1.5e-7) < 1e-20


def test_tokens_keep_letters_of_every_script(spark):
    from barweave.functions.text import tokens
    got = spark.createDataFrame([("Größe déçu qualité, l'été",)], "t string").select(tokens("t").alias("x")).first()["x"]
    assert got == ["größe", "déçu", "qualité", "l'été"]


def test_tables_of_a_block_are_released_alone(spark):
    from barweave.session import collecting, release, reuse
    kept = reuse(spark.range(3))
    with collecting() as mine:
        reuse(spark.range(4))
        reuse(spark.range(5))
    assert len(mine) == 2
    release(mine)
    release(mine)  # a second time is nothing
    assert kept.count() == 3


def test_a_cluster_needs_a_shared_folder():
    from barweave.session import shared_folder

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    def of(**conf):
        return shared_folder(Session(**conf))

    assert of(spark_checkpoint_dir="file:/shared/", spark_master="spark://x") == "file:/shared"
    named = "spark.sql.warehouse.dir"
    for master in ("local", "local[4]"):
        s = Session(spark_master=master)
        s.conf[named] = "file:/tmp/w"
        assert shared_folder(s) == "file:/tmp/w"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x:7077"):
        s = Session(spark_master=master)
        for folder in ("file:/tmp/w", "/tmp/w", "spark-warehouse"):
            s.conf[named] = folder
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                shared_folder(s)
        s.conf[named] = "hdfs://n/w/"
        assert shared_folder(s) == "hdfs://n/w"
