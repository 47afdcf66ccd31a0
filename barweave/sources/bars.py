"""Bar scans: one read for all tickers, ticker and bar width as columns."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_ticker, require_columns
from ..functions.numeric import clean
from ..functions.times import normalise_times
from ..operators.sequence import keep_first, keep_last

# Names a time column may carry, and the file name form <SYMBOL><QUOTE>_<width>.parquet.
TIME_NAMES = ["timestamp", "datetime", "date", "time", "open_time", "close_time"]
FILE_FORM = r"^([A-Za-z0-9]+?)(?:{quotes})_(1h|6h|1d|15min)\.parquet$"
QUOTES = ("USDT",)
OHLCV = ["open", "high", "low", "close", "volume"]


def read_bars(spark: SparkSession, root, merge_schema=False, quotes=QUOTES) -> DataFrame:
    """Every bar file under a folder, with ticker and horizon taken from the file name when absent.

    Rows of a file whose name has another form get null there and are left out of series; ``unnamed_files`` lists such
    files. ``merge_schema`` opens every footer first; leave it off where files share one schema.
    """
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", merge_schema).parquet(root)
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    name = F.col("_metadata.file_name")
    form = FILE_FORM.format(quotes="|".join(quotes))
    for group, column in ((1, "ticker"), (2, "horizon")):
        if column not in df.columns:
            df = df.withColumn(column, F.nullif(F.regexp_extract(name, form, group), F.lit("")))
    return df.withColumn("ticker", canonical_ticker("ticker"))


def unnamed_files(spark: SparkSession, root, quotes=QUOTES) -> DataFrame:
    """Files under a folder from whose names no ticker and bar width can be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike(FILE_FORM.format(quotes="|".join(quotes))))


def normalise_bars(df: DataFrame, seq=None, dedupe=True) -> DataFrame:
    """Lower-case names, UTC times, numeric values, one row per (ticker, horizon, time): the last one.

    The unit of epoch times is found for each series. ``seq`` is an ingest order; without it the values themselves order rows that share a time.
    """
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    tcol = next((c for c in TIME_NAMES if c in df.columns), df.columns[0])
    series = [c for c in ("ticker", "horizon") if c in df.columns]
    df = df.dropna(subset=series) if series else df
    df = normalise_times(df, tcol, "timestamp", by=series).where(F.col("timestamp").isNotNull())
    present = [c for c in OHLCV if c in df.columns]
    df = df.withColumns({c: clean(F.expr(f"try_cast(`{c}` AS double)")) for c in present})
    keep = ["ticker", "horizon", "timestamp", *present] + ([seq] if seq else [])
    df = df.select(*keep)
    if not dedupe:
        return df
    return keep_last(df, ["ticker", "horizon", "timestamp"], [seq] if seq else present)


def validation_bars(df: DataFrame, seq=None) -> DataFrame:
    """As normalise_bars, but all five values are required and duplicates stay to be counted."""
    return normalise_bars(require_columns(df, ["open", "high", "low", "close", "volume"]), seq, dedupe=False)


def close_series(df: DataFrame, horizon, seq="timestamp") -> DataFrame:
    """Closes for the backtest: one per day at 1d, one per exact time intraday; the last one counts."""
    at = F.date_trunc("day", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz") if horizon == "1d" \
        else F.col("timestamp")
    rows = df.where((F.col("horizon") == horizon) & F.col("close").isNotNull()).select(
        "ticker", at.alias("_at"), F.col(seq).alias("_seq"), "close")
    return keep_last(rows, ["ticker", "_at"], ["_seq", "close"]).select("ticker", F.col("_at").alias("timestamp"), "close")


def daily_ohlc(df: DataFrame, seq="timestamp") -> DataFrame:
    """Daily open/high/low/close on the UTC day; of several rows of a day the first stays."""
    day = F.date_trunc("day", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
    rows = df.dropna(subset=["timestamp", "open", "high", "low", "close"]).select(
        "ticker", day.alias("date"), F.col(seq).alias("_seq"), "open", "high", "low", "close")
    return keep_first(rows, ["ticker", "date"], ["_seq", "open", "close"]).drop("_seq")


def discover_tickers(df: DataFrame) -> DataFrame:
    return df.select("ticker").where(F.col("ticker").isNotNull()).distinct()
