"""Wide daily market data: reshaping and instrument column matching."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_ticker
from ..functions.numeric import clean
from ..functions.times import utc
from ..operators.sequence import keep_last

HEADER = r"^(\d+)_(.+)$"
ID_WIDTH = 12

# Ranks of the two matching rules; the lowest rank wins.
FEATURE_RANK = {"canonical_id": 0, "metadata_id": 1, "symbol": 2, "plain_name": 3}
VALIDATION_RANK = {"preferred_id": 0, "preferred_suffix": 5, "metadata_id": 10, "plain_name": 20, "symbol": 30}


def header_id(c) -> Column:
    head = F.regexp_extract(c, HEADER, 1)
    return F.when(head != "", head.cast("long"))


def header_symbol(c) -> Column:
    sym = F.upper(F.regexp_extract(c, HEADER, 2))
    plain = F.upper(F.trim(c))
    return F.when(sym != "", sym).when(plain.rlike(r"^\S+$"), plain)


def wide_to_cells(wide: DataFrame, date_col="date") -> DataFrame:
    """(date, column, ord, cmc_id, symbol, value): every cell of the wide table."""
    cols = [c for c in wide.columns if c != date_col]
    day = F.date_trunc("day", F.col(date_col).cast("timestamp")).cast("timestamp_ntz")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ord"), clean(F.col(f"`{c}`")).alias("value"))
                      for i, c in enumerate(cols)])
    return wide.select(utc(day).alias("date"), F.explode(cells).alias("c")).select(
        "date", "c.column", "c.ord", header_id(F.col("c.column")).alias("cmc_id"), header_symbol(F.col("c.column")).alias("symbol"), "c.value")


def wide_to_long(wide: DataFrame, date_col="date", name="market_cap") -> DataFrame:
    """Positive values per (ticker, date); of several columns of a ticker the last one counts."""
    cells = wide_to_cells(wide, date_col).where(
        F.col("symbol").isNotNull() & F.col("date").isNotNull() & (F.col("value") > 0))
    rows = cells.select("date", canonical_ticker("symbol").alias("ticker"), "ord", F.col("value").alias(name))
    return keep_last(rows, ["ticker", "date"], "ord").select("date", "ticker", name)


def _column_stats(cells):
    v = F.col("value")
    return cells.groupBy("column", "cmc_id", "symbol").agg(
        F.count_if(v > 0).alias("positive"), F.count(v).alias("coverage"),
        F.min(F.when(v.isNotNull(), F.col("date"))).alias("first_date"),
        F.max(F.when(v.isNotNull(), F.col("date"))).alias("last_date"))


def _best(cands, rank):
    return cands.groupBy("ticker").agg(F.min_by(F.struct("*"), rank).alias("b")).select(
        "ticker", F.col("b.column").alias("column"), F.col("b.cmc_id").alias("cmc_id"),
        F.col("b.priority").alias("priority"), F.col("b.coverage").alias("coverage"))


def choose_columns(cells: DataFrame, aliases: DataFrame, metadata: DataFrame) -> DataFrame:
    """Best column per ticker for features.

    ``aliases`` (ticker, symbol, canonical_id, preferred_symbol) has a row per accepted symbol;
    ``metadata`` (symbol, cmc_id) lists known ids. The order is: kind of match, preferred symbol, latest
    value, coverage, name. All tables here hold one row per listed instrument.
    """
    st = _column_stats(cells)
    a = aliases.select("ticker", F.upper("symbol").alias("want"), "canonical_id", "preferred_symbol")
    by_id = st.join(a.select("ticker", "canonical_id", "preferred_symbol").distinct(),
                    st.cmc_id == F.col("canonical_id")).withColumn("priority", F.lit(FEATURE_RANK["canonical_id"]))
    known = metadata.select(F.upper("symbol").alias("want"), F.col("cmc_id").alias("meta_id")).distinct()
    by_meta = st.join(a, st.symbol == F.col("want")).join(known, "want").where(F.col("meta_id") == F.col("cmc_id")) \
        .withColumn("priority", F.lit(FEATURE_RANK["metadata_id"]))
    by_symbol = st.join(a, st.symbol == F.col("want")).withColumn(
        "priority", F.when(F.col("cmc_id").isNull(), FEATURE_RANK["plain_name"]).otherwise(FEATURE_RANK["symbol"]))
    keep = ["ticker", "column", "cmc_id", "symbol", "coverage", "last_date", "preferred_symbol", "priority"]
    cands = by_id.select(keep).unionByName(by_meta.select(keep)).unionByName(by_symbol.select(keep))
    pref = F.when(F.col("symbol") == F.col("preferred_symbol"), 0).otherwise(1)
    last = F.coalesce(F.datediff("last_date", F.lit("1970-01-01").cast("date")), F.lit(-1_000_000))
    return _best(cands, F.struct("priority", pref.alias("p"), (-last).alias("l"), (-F.col("coverage")).alias("c"), "column"))


def score_columns(cells: DataFrame, symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """Best column per ticker for validation, among all plausible ones.

    ``symbols`` (ticker, symbol); ``ids`` (ticker, cmc_id, preferred). Identity comes first, then the number
    of positive values, of any values, the span of dates with values, and the name.
    """
    st = _column_stats(cells)
    s = symbols.select("ticker", F.upper("symbol").alias("want"))
    hit = st.join(s, st.symbol == F.col("want"))
    i = ids.select(F.col("ticker").alias("t2"), F.col("cmc_id").alias("id2"), "preferred")
    j = hit.join(i, (F.col("ticker") == F.col("t2")) & (F.col("cmc_id") == F.col("id2")), "left")
    prio = F.when(F.col("preferred"), VALIDATION_RANK["preferred_id"]) \
        .when(F.col("id2").isNotNull(), VALIDATION_RANK["metadata_id"]) \
        .when(F.col("cmc_id").isNull(), VALIDATION_RANK["plain_name"]).otherwise(VALIDATION_RANK["symbol"])
    by_id = st.join(i.where("preferred"), st.cmc_id == F.col("id2")).select(
        F.col("t2").alias("ticker"), *st.columns, F.lit(VALIDATION_RANK["preferred_suffix"]).alias("priority"))
    cands = j.select("ticker", *st.columns, prio.alias("priority")).unionByName(by_id)
    span = F.coalesce(F.datediff("last_date", "first_date"), F.lit(-1))
    return _best(cands, F.struct("priority", (-F.col("positive")).alias("p"), (-F.col("coverage")).alias("c"),
                                 (-span).alias("s"), "column"))


def matched_series(cells: DataFrame, matches: DataFrame, name="value") -> DataFrame:
    """(ticker, date, value) of each ticker's chosen column."""
    return cells.join(matches.select("ticker", "column"), "column").where(F.col("value").isNotNull()).select(
        "ticker", "date", F.col("value").alias(name))


def price_and_volume(price_cells, volume_cells, price_match, volume_match) -> DataFrame:
    p = matched_series(price_cells, price_match, "close")
    return p.join(matched_series(volume_cells, volume_match, "volume"), ["ticker", "date"], "full")


def read_metadata(spark: SparkSession, path) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.lower().strip() for c in df.columns]).select(
        F.expr("try_cast(id AS long)").alias("cmc_id"), F.upper(F.trim("symbol")).alias("symbol"), F.col("name"))


def id_list(metadata: DataFrame, preferred: DataFrame, seq) -> DataFrame:
    """Ids per symbol: preferred ones first, then the rest in file order, zero-padded."""
    p = preferred.select(F.col("symbol").alias("s2"), F.col("cmc_id").alias("i2"))
    j = metadata.join(p, (F.col("symbol") == F.col("s2")) & (F.col("cmc_id") == F.col("i2")), "left")
    rank = F.struct(F.col("i2").isNull().alias("later"), F.col(seq).alias("seq"),
                    F.lpad(F.col("cmc_id").cast("string"), ID_WIDTH, "0").alias("id"))
    return j.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_set(rank)), lambda x: x.id).alias("ids")) \
        .select("symbol", F.array_join("ids", ";").alias("ids"))
