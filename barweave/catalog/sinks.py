"""Sinks and the scans that read them back: chunks under a signature, contract-checked tables, ordered reports."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import posts, tables
from ..sources import standins as S
from .base import query
from .features import price_1d


@query("chunked_sink", """SELECT ticker, count(*) AS n, avg(log_return_t) AS mean_return, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
 (SELECT count(DISTINCT ticker) FROM price_1d) AS n_first_run, (SELECT count(DISTINCT ticker) FROM price_1d WHERE ticker IN ('T1', 'T3')) AS n_second_run FROM price_1d GROUP BY ticker""", ["price_1d"],
       doubles="mean_return", longs="n n_first_run n_second_run")
def _(t):
    """Price features written by ticker in two runs: the second finds all chunks but two noted under its signature, and writes those."""
    path, p = scratch_path(t.spark), price_1d(t)
    gate = F.col("log_return_t").isNull()
    early = posts.write_chunks(p.where(~F.col("ticker").isin("T1", "T3")), path, "ticker", "run-1", gate)
    late = posts.write_chunks(p, path, "ticker", "run-1", gate)
    return t.spark.read.parquet(path).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_return_t").alias("mean_return"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.lit(len(early) + len(late)).alias("n_first_run"), F.lit(len(late)).alias("n_second_run"))


@query("feature_scan", "SELECT ticker, timestamp, target, log_return_t, log_market_cap_lag1 FROM price_1d", ["price_1d"], doubles="log_return_t log_market_cap_lag1", longs="target")
def _(t):
    """Price features through a table partitioned by bar width, read under the price contract."""
    path = scratch_path(t.spark)
    p = price_1d(t)
    posts.write_parquet(p.unionByName(p.withColumn("horizon", F.lit("6h"))), path, ["horizon"])
    return tables.read_features(t.spark, path, tables.PRICE_CONTRACT, horizon="1d").select("ticker", "timestamp", "target", "log_return_t", "log_market_cap_lag1")


@query("ordered_report", """SELECT row_number() OVER (ORDER BY n DESC, ticker, day) AS position, ticker, day, n FROM (
 SELECT ticker, CAST(CAST(date AS DATE) AS VARCHAR) AS day, count(*) AS n FROM scored GROUP BY 1, 2)""", ["scored"], longs="position n")
def _(t):
    """A report as CSV in its declared order, read back in the order of its files and lines."""
    path = scratch_path(t.spark)
    r = S.scored_posts(t).groupBy("ticker", F.to_date("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    posts.write_csv(r, path, [F.col("n").desc(), "ticker", "day"])
    back = t.spark.read.option("header", True).schema("ticker string, day string, n long").csv(path)
    back = back.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return back.select(F.row_number().over(W.orderBy("file", "line")).alias("position"), "ticker", "day", "n")  # one row per ticker and day
