"""Stored feature tables, read under a column contract."""
from pyspark.sql import DataFrame, SparkSession

from ..functions.identity import require_columns
from ..functions.times import normalise_times

# Columns every table must have, and engagement-weighted ones none may have.
PRICE_CONTRACT = ["timestamp", "ticker", "target", "log_return_t", "volume_diff", "realized_vol_14d", "log_market_cap_lag1"]
SLOT_CONTRACT = ["timestamp", "ticker", "post_count"]
FINAL_CONTRACT = [*PRICE_CONTRACT, "post_count", "log1p_post_count", "has_posts"]
FORBIDDEN = ["vader_title_score_weighted_mean", "cryptobert_title_score_weighted_mean"]


def read_features(spark: SparkSession, path, contract=FINAL_CONTRACT, horizon=None, forbidden=FORBIDDEN) -> DataFrame:
    """A feature table with UTC times; a horizon becomes a partition filter. The contract costs no job."""
    df = require_columns(spark.read.parquet(path), contract, forbidden)
    if horizon is not None:
        df = df.where(df["horizon"] == horizon)
    return normalise_times(df, "timestamp")
