"""Panel inputs derived from the general-purpose test tables (the tables hold no market data)."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import bar_floor, bar_micros, from_micros, micros, utc
from ..session import reuse

SETS = [  # (salt, set_id, category, sentiment_model, model_type, panel_mode)
    (0, "ECON", "benchmark", "-", "panel_logit", "pooled"),
    (1, "SENT_VAD_L", "sentiment", "vader", "panel_logit", "pooled"),
    (2, "ECON_VAD_L", "combined", "vader", "panel_logit", "pooled"),
    (3, "SENT_CBT_L", "sentiment", "cryptobert", "panel_logit", "pooled"),
    (4, "ECON_CBT_L", "combined", "cryptobert", "panel_logit", "pooled"),
    (5, "ECON", "benchmark", "-", "per_asset", "-"),
    (6, "ECON_VAD_L", "combined", "vader", "per_asset", "-"),
    (9, "NAIVE", "reference", "-", "panel_logit", "pooled"),
]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._kept = spark, sf_dir, {}

    def once(self, name, build) -> DataFrame:
        """An intermediate of one query, built and written once however many branches read it."""
        if name not in self._kept:
            self._kept[name] = reuse(build())
        return self._kept[name]

    def __getattr__(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _ohlc(df, value, seq, keys) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.min_by(v, seq).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"),
        F.max_by(v, seq).alias("close"), F.sum(v).alias("volume"))


def daily_bars(t: Tables) -> DataFrame:
    o = t.orders.select(
        F.concat(F.lit("T"), (F.col("o_custkey") % 5).cast("string")).alias("ticker"),
        utc("o_orderdate").alias("timestamp"), "o_totalprice", "o_orderkey")
    return _ohlc(o, "o_totalprice", "o_orderkey", ["ticker", "timestamp"])


def intraday_bars(t: Tables, horizon) -> DataFrame:
    e = t.events.select(
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("ticker"),
        bar_floor("ts", horizon).alias("timestamp"), "value", "event_id")
    return _ohlc(e, "value", "event_id", ["ticker", "timestamp"])


def bars(t: Tables, horizon) -> DataFrame:
    """Bars of one width, stored once per query: the raw tables are scanned a single time."""
    return t.once(f"bars_{horizon}", lambda: (daily_bars(t) if horizon == "1d" else intraday_bars(t, horizon))
                  .withColumn("horizon", F.lit(horizon)))


def market_caps(t: Tables) -> DataFrame:
    return t.once("caps", lambda: t.lineitem.groupBy(
        F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string")).alias("ticker"),
        utc("l_shipdate").alias("date")).agg(F.round(F.sum("l_extendedprice"), 2).alias("market_cap")))


def wide_market_caps(t: Tables) -> DataFrame:
    """One column per instrument, headed <zero-padded id>_<symbol>."""
    caps = market_caps(t).withColumn("k", F.substring("ticker", 2, 1).cast("int"))
    return caps.groupBy("date").agg(*[
        F.max(F.when(F.col("k") == i, F.col("market_cap"))).alias(f"{i + 1:012d}_T{i}") for i in range(5)])


def scored_posts(t: Tables) -> DataFrame:
    """Posts with a label and scores from two scorers."""
    cents = F.round(F.col("value") * 100).cast("long")
    label = F.when(F.col("event_type").isin("purchase", "signup"), "positive") \
        .when(F.col("event_type") == "error", "negative").otherwise("neutral")
    label2 = F.when(cents % 3 == 0, "positive").when(cents % 3 == 1, "negative").otherwise("neutral")
    k = F.col("event_id") % 7
    selftext = F.when(k == 0, "[removed]").when(k == 1, " NaN ").when(k == 2, "") \
        .when(k == 3, F.lit(None)).otherwise(F.col("props"))
    return t.events.select(
        F.col("event_id").alias("post_id"), utc("ts").alias("date"),
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("ticker"),
        selftext.alias("selftext"),
        label.alias("vader_title_sentiment"),
        (((cents * 37) % 2000003 - 1000001) / 1000001.0).alias("vader_title_score"),
        F.when(F.col("event_id") % 5 != 0, ((cents * 53) % 2000003 - 1000001) / 1000001.0).alias("vader_selftext_score"),
        label2.alias("cryptobert_title_sentiment"),
        (((cents * 41) % 2000003 - 1000001) / 1000001.0).alias("cryptobert_title_score"),
        (((cents * 59) % 2000003 - 1000001) / 1000001.0).alias("cryptobert_selftext_score"),
    )


def raw_posts(t: Tables) -> DataFrame:
    """Unscored posts with the engagement columns of a community export."""
    e = t.events
    return e.select(
        F.col("event_id").alias("submission"),
        F.concat(F.lit("sub"), (F.col("user_id") % 7).cast("string")).alias("subreddit"),
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("ticker"),
        utc("ts").alias("date"),
        (F.col("event_id") % 11 == 0).cast("int").alias("removed"),
        (F.round(F.col("value") * 100).cast("long") % 100 / 100.0).alias("upvote_ratio"),
        F.floor(F.col("value")).cast("long").alias("score"),
        (F.col("event_id") % 4).alias("total_awards_received"),
        (F.col("user_id") % 23 + F.col("event_id") % 5).alias("num_comments"),
        (F.col("event_id") % 3).alias("num_crossposts"),
        F.when(F.col("event_id") % 7 == 0, "[removed]").when(F.col("event_id") % 7 == 3, F.lit(None))
        .otherwise(F.col("props")).alias("selftext"),
    )


def text_posts(t: Tables) -> DataFrame:
    """Document i posted at the time of event i; the first line is the title."""
    e = t.events.select(F.col("event_id").alias("doc_id"), utc("ts").alias("date"),
                        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("ticker"))
    return t.documents.join(e, "doc_id").select(
        "doc_id", "ticker", "date", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("selftext"))


def _grid(b: DataFrame) -> DataFrame:
    h = F.col("horizon")
    d = F.floor(micros("timestamp") / bar_micros(h)).cast("long")
    return b.select(
        "horizon", "ticker", "timestamp", d.alias("d"), F.substring("ticker", 2, 1).cast("long").alias("k"),
        (F.col("close") >= F.col("open")).cast("int").alias("target"))


def signals(t: Tables, horizons=("1d", "6h")) -> DataFrame:
    """Forecasts of several feature sets and two model families, with gaps in all but the benchmarks."""
    grid = None
    for h in horizons:
        g = _grid(bars(t, h))
        grid = g if grid is None else grid.unionByName(g)
    sets = F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(i).alias("set_id"), F.lit(c).alias("category"),
                 F.lit(m).alias("sentiment_model"), F.lit(mt).alias("model_type"), F.lit(pm).alias("panel_mode"))
        for s, i, c, m, mt, pm in SETS])
    x = grid.withColumn("z", F.explode(sets)).select("*", "z.*").drop("z")
    x = x.where((F.col("set_id") == "ECON") | ((F.col("d") + F.col("k") + F.col("s")) % 17 != 0))
    key = (F.col("d") * 7919 + F.col("k") * 104729 + F.col("s") * 15485863) % 1000
    p = (key + 150 * F.col("target")) / 1150.0
    return x.select(
        "timestamp", "ticker", "target", (p >= 0.5).cast("int").alias("prediction"), p.alias("probability"),
        "set_id", "category", "sentiment_model", "horizon", "model_type", "panel_mode",
        F.lit("fixed").alias("hpo_variant"),
        from_micros(micros("timestamp") + bar_micros("horizon")).alias("forecast_origin"))
