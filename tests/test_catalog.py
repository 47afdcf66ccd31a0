"""Contract of the entry module, and a spread of queries against DuckDB on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")

SPREAD = ["price_features_1d", "slot_sentiment_1h", "final_matrix_6h", "bar_quality", "cross_width_report", "instrument_match_validation",
          "market_cap_unpivot", "pooled_metrics", "threshold_lift", "incremental_value", "volatility_regimes", "size_stratification",
          "logloss_timestamp_test", "portfolio_returns", "train_windows_days", "winsor_thresholds", "feature_correlations", "coin_stats",
          "clean_text", "lexicon_scores", "fold_stability", "confusion_matrix"]


def test_every_query_has_a_name_and_most_have_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 0.85 * len(q)


@pytest.mark.parametrize("name", SPREAD)
def test_against_duckdb(spark, name):
    from tools.check_oracle import TABLES, diff, normal
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert diff(normal(got), normal(con.execute(entry.oracle_sql()[name]).fetchdf())) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_a_hot_ticker_spreads_over_blocks(spark):
    """One key with most of the rows: no (key, block) or chunk group comes near the key's size."""
    from pyspark.sql import functions as F

    from barweave.operators.sequence import calendar_block, sliding
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), "id",
                               F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(0, cast(id as int))").alias("t"))
    biggest = df.withColumn("b", calendar_block("t")).groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert biggest <= 32 * 24
    out = sliding(df, ["k"], "t", {"p": lambda w: F.lag("id").over(w)}, before=1, chunk=1000)
    assert out.count() == n and out.where("p is null").count() == df.select("k").distinct().count()
