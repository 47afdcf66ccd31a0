"""Names and keys: tickers, evaluation groups, row ids, universes."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .times import col, micros

# Alternate symbols and the name each is reported under.
TICKER_ALIASES = {"XNO": "NANO", "MIOTA": "IOTA"}

# Columns that identify a group of forecasts, and what a blank one means.
GROUP_KEYS = ["horizon", "set_id", "sentiment_model", "model_type", "panel_mode", "hpo_variant"]
FAMILY_KEYS = ["horizon", "model_type", "panel_mode", "hpo_variant"]
GROUP_DEFAULTS = {"model_type": "per_asset", "panel_mode": "-", "hpo_variant": "fixed"}
WINDOW_DEFAULTS = {"train_window_mode": ("string", "expanding"),
                   "train_window_timestamps": ("double", None),
                   "rolling_window_days": ("double", None)}
NO_SENTIMENT_TOKENS = ["", "none", "nan", "null", "-"]

# How a tuned fit came about.
HPO_OK = "ok"
HPO_FALLBACKS = ("fallback_insufficient_data", "fallback_all_failed", "fallback_refit_failed")

NAIVE = "NAIVE"
ECON = "ECON"


def canonical_ticker(c) -> Column:
    t = F.upper(F.trim(col(c)))
    pairs = [F.lit(x) for kv in TICKER_ALIASES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[t], t)


def blank_to(c, default) -> Column:
    s = F.trim(col(c).cast("string"))
    return F.when(s.isNull() | s.isin("", "nan", "None"), F.lit(default)).otherwise(s)


def with_group_defaults(df: DataFrame) -> DataFrame:
    cols = {}
    for name, d in GROUP_DEFAULTS.items():
        cols[name] = blank_to(name, d) if name in df.columns else F.lit(d)
    for name, (kind, d) in WINDOW_DEFAULTS.items():
        if name not in df.columns:
            cols[name] = F.lit(d).cast(kind)
        elif d is not None:
            cols[name] = F.coalesce(F.col(name), F.lit(d))
    return df.withColumns(cols)


def canonical_sentiment_model(c) -> Column:
    s = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(NO_SENTIMENT_TOKENS), F.lit("-")).otherwise(s)


def is_naive(df: DataFrame) -> Column:
    hit = F.upper(F.col("set_id")) == NAIVE
    if "benchmark_model" in df.columns:
        hit = hit | F.coalesce(F.col("benchmark_model").contains("rolling_probability"), F.lit(False))
    return hit


def row_id(ticker="ticker", horizon="horizon", ts="timestamp") -> Column:
    return F.concat_ws("_", col(ticker), col(horizon), (micros(ts) * 1000).cast("string"))


def universe_digest(tickers: Column) -> Column:
    """First 8 hex digits of the SHA-256 of the sorted, upper-cased distinct tickers.

    The set is bounded by the number of listed instruments.
    """
    names = F.array_sort(F.collect_set(F.upper(F.trim(tickers))))
    return F.substring(F.sha2(F.array_join(names, "|"), 256), 1, 8)


def null_safe(left: DataFrame, right: DataFrame, keys) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def require_columns(df: DataFrame, required=(), forbidden=()) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    banned = [c for c in forbidden if c in df.columns]
    if missing or banned:
        raise ValueError(f"missing columns {missing}, forbidden columns {banned}")
    return df
