"""Post exports, forecast files, provenance tables and sinks."""
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.identity import blank_to, canonical_sentiment_model, require_columns, with_group_defaults
from ..functions.times import calendar_parts, forecast_origin, normalise_times, origin_mismatches
from ..operators.sequence import keep_first
from ..session import drop

POST_SCHEMA = StructType([
    StructField("submission", StringType()), StructField("subreddit", StringType()),
    StructField("created", DoubleType()), StructField("removed", LongType()),
    StructField("upvote_ratio", DoubleType()), StructField("score", LongType()),
    StructField("total_awards_received", LongType()), StructField("num_comments", LongType()),
    StructField("num_crossposts", LongType()), StructField("selftext", StringType()),
    StructField("title", StringType())])

# Accepted header names of a provenance table.
PROVENANCE_NAMES = {
    "coin": ["coin", "ticker", "base", "base_asset", "asset", "symbol_base", "name"],
    "horizon": ["horizon", "interval", "timeframe", "tf"],
    "exchange": ["exchange", "source", "source_exchange", "venue"],
    "symbol": ["symbol", "pair", "market", "ccxt_symbol", "trading_pair"],
    "quote": ["quote", "quote_currency", "quote_asset", "quote_ccy"],
    "status": ["status", "state"],
    "missing_bars": ["missing_bars", "n_missing_bars", "gaps", "internal_gaps"],
    "first_date": ["first_date", "start", "start_date", "first", "from"],
    "last_date": ["last_date", "end", "end_date", "last", "to"],
    "coverage_pct": ["coverage_pct", "coverage", "coverage_percent", "coverage_%"],
    "n_bars": ["n_bars", "bars", "n_rows", "rows", "count"],
}
PROVENANCE_KEY = ["coin", "horizon", "exchange", "symbol", "quote"]
PROVENANCE_ORDER = ["missing_bars", "first_date"]

SIGNAL_COLUMNS = ["timestamp", "ticker", "target", "prediction", "probability"]


def read_posts(spark: SparkSession, glob, mapping: DataFrame) -> DataFrame:
    """Community CSV exports with the ticker each community belongs to.

    ``mapping`` (subreddit, ticker, included) keeps only the communities marked yes. Files are matched
    by a glob; ``missing_communities`` names those without a row.
    """
    df = (spark.read.schema(POST_SCHEMA).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').csv(glob))
    return attach_tickers(df, mapping)


def missing_communities(posts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Communities marked yes of which the scan has no post."""
    wanted = mapping.where(F.lower(F.trim("included")) == "yes").select("subreddit", "ticker").distinct()
    return wanted.join(posts.select("subreddit").distinct(), "subreddit", "left_anti")


def attach_tickers(posts: DataFrame, mapping: DataFrame) -> DataFrame:
    keep = mapping.where(F.lower(F.trim("included")) == "yes").select("subreddit", "ticker")
    return posts.join(keep, "subreddit")


def tidy_posts(posts: DataFrame, seq=None) -> DataFrame:
    """One row per (submission, subreddit), the first; UTC time and its calendar parts."""
    df = posts
    if "created" in df.columns:
        df = df.withColumn("date", F.timestamp_seconds("created").cast("timestamp_ntz")).drop("created")
    df = keep_first(df, ["submission", "subreddit"], [seq] if seq else ["date", "title"])
    return calendar_parts(df, "date")


def _forecast_files(spark, root, horizon, skip_unreadable):
    return (spark.read.option("mergeSchema", True).option("recursiveFileLookup", True)
            .option("ignoreCorruptFiles", skip_unreadable).parquet(f"{root}/{horizon}" if horizon else root))


def read_signals(spark: SparkSession, root, horizon=None, skip_unreadable=False) -> DataFrame:
    """Every forecast file under the folder, or one bar width's sub-folder and of it only rows of that width.

    An unreadable file fails the scan, unless ``skip_unreadable`` leaves it out; ``skipped_files`` then names it.
    """
    df = normalise_signals(_forecast_files(spark, root, horizon, skip_unreadable))
    return df.where(F.col("horizon").isin("", horizon)).withColumn("horizon", F.lit(horizon)) if horizon else df


def skipped_files(spark: SparkSession, root, horizon=None) -> DataFrame:
    """Parquet files of which a scan that skips unreadable files has no row (empty files among them)."""
    path = f"{root}/{horizon}" if horizon else root
    there = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "path"))
    seen = _forecast_files(spark, root, horizon, True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).distinct()
    return there.join(seen, "file", "left_anti").select("path")


def normalise_signals(df: DataFrame) -> DataFrame:
    """Typed columns, no null keys, default identity columns, one spelling for no sentiment."""
    df = require_columns(df, SIGNAL_COLUMNS)
    df = normalise_times(df, "timestamp").dropna(subset=["timestamp", "target", "prediction", "probability"])
    df = df.withColumns({"target": F.col("target").cast("int"), "prediction": F.col("prediction").cast("int"),
                         "probability": F.col("probability").cast("double")})
    if "hpo_objective" in df.columns:
        df = df.withColumn("hpo_objective", blank_to("hpo_objective", "-"))
    for c in ("horizon", "set_id", "category", "label"):
        df = df.withColumn(c, blank_to(c, "") if c in df.columns else F.lit(""))
    model = F.col("sentiment_model") if "sentiment_model" in df.columns else F.lit("")
    enabled = F.lower(F.col("hpo_enabled").cast("string")).isin("true", "1", "yes", "y") \
        if "hpo_enabled" in df.columns else F.lit(False)
    df = df.withColumns({"sentiment_model": canonical_sentiment_model(model),
                         "hpo_enabled": F.coalesce(enabled, F.lit(False))})
    df = with_group_defaults(df)
    if "forecast_origin" not in df.columns:
        df = df.withColumn("forecast_origin", forecast_origin())
    return df


def origin_violations(df: DataFrame) -> DataFrame:
    return origin_mismatches(df)


def attach_set_metadata(signals: DataFrame, feature_sets: DataFrame) -> DataFrame:
    """Category and label by set id; a set the registry lacks keeps nulls."""
    meta = feature_sets.select("set_id", "category", "label")
    return signals.drop("category", "label").join(meta, "set_id", "left")


def _known_headers(columns):
    """Which column stands for which known name: of several candidates the one whose header is listed first."""
    rank = {alias: (i, name) for name, aliases in PROVENANCE_NAMES.items() for i, alias in enumerate(aliases)}
    found = sorted((*rank[key], c) for c in columns if (key := "_".join(c.lower().split())) in rank)
    return {c: name for _, name, c in reversed({n: (i, n, c) for i, n, c in reversed(found)}.values())}


def normalise_provenance(df: DataFrame, source) -> DataFrame:
    """Recognised headers under one name each; bar widths in lower case, coins in upper case."""
    df = df.withColumnsRenamed(_known_headers(df.columns))
    tidy = {c: fn(F.trim(F.col(c).cast("string"))) for c, fn in (("horizon", F.lower), ("coin", F.upper)) if c in df.columns}
    return df.withColumns(tidy | {"source_file": F.lit(source)})


def union_provenance(frames) -> DataFrame:
    """Provenance tables in order of precedence; overlapping rows count once, from the earlier table.

    Of rows that overlap within a table the one with the fewest missing bars stays, then the one that starts first; unknown values come last.
    """
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_rank", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    key = [c for c in PROVENANCE_KEY if c in out.columns]
    best = [c for c in PROVENANCE_ORDER if c in out.columns]
    rest = [c for c in out.columns if c not in [*key, *best, "_rank"]]
    return keep_first(out, key, ["_rank", *[x for c in best for x in (F.col(c).isNull(), F.col(c))], *rest]).drop("_rank")


def read_provenance(spark: SparkSession, paths) -> DataFrame:
    return union_provenance([
        normalise_provenance(spark.read.option("header", True).option("inferSchema", True).csv(p), p.rsplit("/", 1)[-1])
        for p in paths])


def write_parquet(df: DataFrame, path, partition_by=(), overwrite=False):
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path, order_by=(), overwrite=False):
    """A result table as CSV, in its declared order."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def committed(spark: SparkSession, path, signature) -> set:
    """Chunks that ``write_chunks`` has finished under this signature."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return set()
    return {r["chunk"] for r in spark.read.parquet(f"{path}/_commits").where(F.col("signature") == signature).select("chunk").distinct().collect()}


def write_chunks(df: DataFrame, path, key, signature, gate=None) -> list:
    """Writes one folder per value of ``key`` and notes each with ``signature`` when it is complete; gives the values written now.

    Chunks noted under the same signature are not computed again, so a job that was killed goes on where it stood; a chunk without a note is
    written anew. ``gate`` is a condition that no row may meet: it is counted while the chunk is written, and a chunk that breaks it is deleted. The values of
    ``key`` come to the driver: a column of few values, such as months or instruments.
    """
    spark, written = df.sparkSession, []
    done = committed(spark, path, signature)
    for (value,) in sorted(df.select(F.col(key).cast("string")).distinct().collect()):
        if value in done:
            continue
        seen = Observation()
        part = df.where(F.col(key).cast("string") == value).drop(key)
        part = part.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.lit(False) if gate is None else gate).alias("broken"))
        part.write.mode("overwrite").parquet(f"{path}/{key}={value}")
        if seen.get["broken"]:
            drop(spark, f"{path}/{key}={value}")
            raise ValueError(f"{key}={value}: {seen.get['broken']} rows break the gate")
        spark.createDataFrame([(value, signature, seen.get["rows"])], "chunk string, signature string, rows long").coalesce(1).write.mode("append").parquet(f"{path}/_commits")
        written.append(value)
    return written
