"""Sources, reshaping, column matching and data-quality reports."""
from pyspark.sql import functions as F

from ..functions import identity, times
from ..functions.text import usable_text
from ..functions.times import bar_floor
from ..operators import audits as A
from ..operators import prices
from ..sources import bars as B
from ..sources import market as M
from ..sources import posts as P
from ..sources import standins as S
from .base import cte, query
from .features import final_6h, price_1d, slot_frame

# ---- bar scans -----------------------------------------------------------------------------------

cte("ticks", """SELECT 'T' || (user_id % 5) AS ticker, '15min' AS horizon, time_bucket(INTERVAL '15 minutes', ts) AS timestamp,
value AS open, value + 1 AS high, value - 1 AS low, value AS close, value * 2 AS volume, event_id AS seq FROM events""")


def ticks(t):
    """Unmerged 15-minute rows: several per (ticker, time)."""
    return t.events.select(
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("ticker"), F.lit("15min").alias("horizon"),
        bar_floor("ts", "15min").alias("open_time"), F.col("value").alias("Open"), (F.col("value") + 1).alias("High"),
        (F.col("value") - 1).alias("Low"), F.col("value").alias("Close"), (F.col("value") * 2).alias("Volume"),
        F.col("event_id").alias("seq"))


@query("bar_scan_dedup", """SELECT ticker, horizon, timestamp, arg_max(open, seq) AS open, arg_max(high, seq) AS high,
arg_max(low, seq) AS low, arg_max(close, seq) AS close, arg_max(volume, seq) AS volume FROM ticks GROUP BY ALL""", ["ticks"],
       doubles="open high low close volume")
def _(t):
    return B.normalise_bars(ticks(t), "seq").drop("seq")


@query("bar_scan_validation", "SELECT ticker, horizon, timestamp, open, high, low, close, volume, seq FROM ticks", ["ticks"],
       doubles="open high low close volume")
def _(t):
    df = ticks(t)
    return B.validation_bars(df.toDF(*[c.lower() for c in df.columns]), "seq")


@query("epoch_times", """SELECT event_id, date_trunc('millisecond', ts) AS timestamp FROM events""")
def _(t):
    ms = t.events.select("event_id", F.floor(times.micros("ts") / 1000).alias("t"))
    return times.normalise_times(ms, "t").drop("t")


@query("mixed_epoch_units", """SELECT event_id, date_trunc(CASE WHEN user_id % 5 < 2 THEN 'millisecond' ELSE 'second' END, ts) AS timestamp FROM events""")
def _(t):
    """Tickers whose times come in milliseconds beside tickers whose times come in seconds."""
    us = times.micros("ts")
    mixed = t.events.select("event_id", (F.col("user_id") % 5).alias("ticker"),
                            F.when(F.col("user_id") % 5 < 2, F.floor(us / 1000)).otherwise(F.floor(us / 1_000_000)).alias("t"))
    return times.normalise_times(mixed, "t", by=["ticker"]).drop("t", "ticker")


@query("iso_times", "SELECT o_orderkey, o_orderdate AS timestamp FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    return times.normalise_times(text, "t").drop("t")


@query("close_series_1d", """SELECT ticker, timestamp, close FROM bars_e1d""", ["bars_e1d"], doubles="close")
def _(t):
    e = t.events.select(
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("ticker"), F.lit("1d").alias("horizon"),
        F.col("ts").alias("timestamp"), F.col("value").alias("close"), F.col("event_id"))
    return B.close_series(e, "1d", seq="event_id")


@query("daily_ohlc_first", """SELECT ticker, date_trunc('day', timestamp) AS date, arg_min(open, timestamp) AS open,
arg_min(high, timestamp) AS high, arg_min(low, timestamp) AS low, arg_min(close, timestamp) AS close
FROM bars_6h GROUP BY 1, 2""", ["bars_6h"], doubles="open high low close")
def _(t):
    return B.daily_ohlc(S.bars(t, "6h"))


@query("ticker_discovery", "SELECT DISTINCT ticker FROM bars_1d", ["bars_1d"])
def _(t):
    return B.discover_tickers(S.bars(t, "1d"))


@query("row_ids", "SELECT ticker || '_6h_' || (epoch_us(timestamp) * 1000) AS row_id FROM bars_6h", ["bars_6h"])
def _(t):
    return S.bars(t, "6h").select(identity.row_id().alias("row_id"))


@query("common_row_ids", """SELECT ticker || '_6h_' || (epoch_us(timestamp) * 1000) AS row_id FROM bars_6h
WHERE volume > 10 AND close < 200""", ["bars_6h"])
def _(t):
    b = S.bars(t, "6h").withColumn("row_id", identity.row_id())
    return A.common_row_ids([b.where("volume > 10"), b.where("close < 200"), b])


@query("canonical_tickers", """SELECT DISTINCT CASE k WHEN 0 THEN 'NANO' WHEN 1 THEN 'IOTA' ELSE 'T' || k END AS ticker FROM
(SELECT user_id % 5 AS k FROM events)""")
def _(t):
    raw = F.when(F.col("k") == 0, " xno ").when(F.col("k") == 1, "miota").otherwise(F.concat(F.lit("t"), F.col("k")))
    return t.events.select((F.col("user_id") % 5).cast("string").alias("k")).select(
        identity.canonical_ticker(raw).alias("ticker")).distinct()


@query("universe_digest", """SELECT substr(sha256(string_agg(ticker, '|' ORDER BY ticker)), 1, 8) AS universe_hash,
count(*) AS n_tickers FROM (SELECT DISTINCT ticker FROM bars_1d)""", ["bars_1d"], longs="n_tickers")
def _(t):
    return S.bars(t, "1d").agg(identity.universe_digest(F.col("ticker")).alias("universe_hash"),
                               F.count_distinct("ticker").alias("n_tickers"))


# ---- market data ---------------------------------------------------------------------------------

@query("market_cap_unpivot", "SELECT date, ticker, market_cap FROM caps WHERE market_cap > 0", ["caps"], doubles="market_cap", dp=2)
def _(t):
    return M.wide_to_long(S.wide_market_caps(t))


def twin_columns(t):
    """Two columns per symbol: a full history under one id and only odd lines under another."""
    l = t.lineitem.select((F.col("l_suppkey") % 5).alias("k"), F.col("l_shipdate").alias("date"),
                          "l_linenumber", "l_extendedprice")
    v = F.col("l_extendedprice")
    aggs = []
    for i in range(5):
        here = F.col("k") == i
        aggs += [F.round(F.sum(F.when(here, v)), 2).alias(f"{i + 1:012d}_T{i}"),
                 F.round(F.sum(F.when(here & (F.col("l_linenumber") % 2 == 1), v)), 2).alias(f"{i + 101:012d}_T{i}")]
    return l.groupBy("date").agg(*aggs)


cte("twin", """
SELECT k, id, date, v FROM (
  SELECT l_suppkey % 5 AS k, l_suppkey % 5 + 1 AS id, l_shipdate AS date, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2, 3
  UNION ALL
  SELECT l_suppkey % 5, l_suppkey % 5 + 101, l_shipdate, round(sum(l_extendedprice), 2) FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2, 3)""")


def _aliases(t):
    """Canonical ids (the shorter history) are known for T0..T2; T3 and T4 match by symbol."""
    k = t.lineitem.select((F.col("l_suppkey") % 5).alias("k")).distinct()
    name = F.concat(F.lit("T"), F.col("k").cast("string"))
    return k.select(name.alias("ticker"), name.alias("symbol"),
                    F.when(F.col("k") <= 2, F.col("k") + 101).alias("canonical_id"),
                    F.lit(None).cast("string").alias("preferred_symbol"))


@query("instrument_match_features", """
SELECT 'T' || k AS ticker, lpad(CAST(id AS VARCHAR), 12, '0') || '_T' || k AS "column", id AS cmc_id, p AS priority, n AS coverage
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, last DESC, n DESC, id) AS rn FROM (
  SELECT k, id, count(v) AS n, max(date) AS last,
    CASE WHEN k <= 2 AND id = k + 101 THEN 0 WHEN k = 3 AND id = 104 THEN 1 ELSE 2 END AS p FROM twin GROUP BY 1, 2)) WHERE rn = 1""",
       ["twin"], longs="cmc_id priority coverage")
def _(t):
    cells = M.wide_to_cells(twin_columns(t))
    a = _aliases(t)
    meta = a.where("ticker = 'T3'").select("symbol", F.lit(104).cast("long").alias("cmc_id"))
    return M.choose_columns(cells, a, meta)


cte("twin_best", """
SELECT k, id, p, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, n DESC, last - first DESC, id) AS rn FROM (
  SELECT k, id, count(v) AS n, min(date) AS first, max(date) AS last,
    CASE WHEN k <= 1 AND id = k + 101 THEN 0 WHEN k = 2 AND id = 103 THEN 10 ELSE 30 END AS p FROM twin GROUP BY 1, 2)) WHERE rn = 1""", "twin")


def validation_match(t, cells):
    a = _aliases(t)
    ids = a.where("canonical_id is not null").select(
        "ticker", F.col("canonical_id").alias("cmc_id"), (F.col("canonical_id") <= 102).alias("preferred"))
    return M.score_columns(cells, a.select("ticker", "symbol"), ids)


@query("instrument_match_validation", """SELECT 'T' || k AS ticker, lpad(CAST(id AS VARCHAR), 12, '0') || '_T' || k AS "column",
id AS cmc_id, p AS priority, n AS coverage FROM twin_best""", ["twin_best"], longs="cmc_id priority coverage")
def _(t):
    return validation_match(t, M.wide_to_cells(twin_columns(t)))


@query("instrument_series", """SELECT 'T' || t.k AS ticker, t.date, t.v AS close, 3 * t.v + 1 AS volume FROM twin t JOIN twin_best b
ON t.k = b.k AND t.id = b.id""", ["twin_best"], doubles="close volume", dp=2)
def _(t):
    cells = M.wide_to_cells(twin_columns(t))
    m = validation_match(t, cells)
    return M.price_and_volume(cells, cells.withColumn("value", 3 * F.col("value") + 1), m, m)


@query("metadata_ids", """SELECT symbol, string_agg(lpad(CAST(id AS VARCHAR), 12, '0'), ';' ORDER BY later, id) AS ids FROM (
SELECT DISTINCT 'N' || s_nationkey AS symbol, s_suppkey AS id, CASE WHEN s_suppkey % 10 = s_nationkey % 10 THEN 0 ELSE 1 END AS later FROM supplier)
GROUP BY 1""")
def _(t):
    s = t.supplier.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("symbol"),
                          F.col("s_suppkey").alias("cmc_id"), "s_nationkey")
    pref = s.where(F.col("cmc_id") % 10 == F.col("s_nationkey") % 10).select("symbol", "cmc_id")
    return M.id_list(s.select("symbol", "cmc_id", F.col("cmc_id").alias("seq")), pref, "seq")


# ---- posts ---------------------------------------------------------------------------------------

@query("posts_mapped", """SELECT submission, subreddit, 'T' || CAST(substr(subreddit, 4) AS INT) % 5 AS ticker, date FROM (
SELECT submission, subreddit, date FROM raw_posts) WHERE subreddit <> 'sub6'""", ["raw_posts"])
def _(t):
    posts = S.raw_posts(t).drop("ticker").select("submission", "subreddit", "date")
    n = F.substring("subreddit", 4, 1).cast("int")
    mapping = posts.select("subreddit").distinct().select(
        "subreddit", F.concat(F.lit("T"), (n % 5).cast("string")).alias("ticker"),
        F.when(n == 6, "no").otherwise(" Yes").alias("included"))
    return P.attach_tickers(posts, mapping)


@query("posts_tidy", """SELECT submission, subreddit, score, date, CAST(date AS DATE) AS date_only, hour(date) AS hour,
dayname(date) AS weekday, strftime(date, '%Y-%m') AS month FROM raw_posts""", ["raw_posts"], longs="hour score")
def _(t):
    p = S.raw_posts(t).select("submission", "subreddit", "score", "date")
    twice = p.unionByName(p.withColumn("score", F.col("score") + 1).withColumn("date", F.col("date") + F.expr("INTERVAL 1 HOUR")))
    return P.tidy_posts(twice.withColumn("title", F.lit("")), None).drop("title")


@query("usable_text", "SELECT post_id, lower(trim(coalesce(selftext, ''))) NOT IN ('', '[removed]', '[deleted]', 'nan', 'none') AS usable FROM scored", ["scored"])
def _(t):
    return S.scored_posts(t).select("post_id", usable_text("selftext").alias("usable"))


# ---- bar quality ---------------------------------------------------------------------------------

def _ticks_tidy(t):
    df = ticks(t)
    return B.validation_bars(df.toDF(*[c.lower() for c in df.columns]), "seq")


@query("bar_quality", """
SELECT ticker, horizon, count(*) AS n_bars, min(timestamp) AS date_min, max(timestamp) AS date_max,
 count(*) FILTER (gap = 0) AS n_duplicates, count(*) FILTER (close IS NULL) AS n_missing_close,
 count(*) FILTER (volume IS NULL) AS n_missing_volume, count(*) FILTER (close <= 0) AS n_zero_or_negative_close,
 count(*) FILTER (volume <= 0) AS n_zero_or_negative_volume, count(*) FILTER (gap > 1350000000) AS n_gaps,
 round(coalesce(max(gap) FILTER (gap > 1350000000), 0) / 3600000000.0, 3) AS max_gap_hours, 'issues' AS status
FROM (SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY ticker ORDER BY timestamp, seq) AS gap FROM ticks)
GROUP BY 1, 2""", ["ticks"], doubles="max_gap_hours",
       longs="n_bars n_duplicates n_missing_close n_missing_volume n_zero_or_negative_close n_zero_or_negative_volume n_gaps")
def _(t):
    return A.bar_quality(_ticks_tidy(t), "seq")


cte("gap_1h", """SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY ticker ORDER BY timestamp) AS gap FROM bars_1h""", "bars_1h")


@query("bar_grid", """
SELECT ticker, horizon, n AS n_observed_bars, 3600.0 AS expected_frequency_secs, md / 1e6 AS median_timestamp_gap_secs,
 mx / 1e6 AS maximum_timestamp_gap_secs, lost AS n_missing_expected_bars, lost * 1.0 / (span // 3600000000 + 1) AS missing_bar_rate
FROM (SELECT ticker, horizon, count(*) n, median(gap) md, max(gap) mx,
  sum(CASE WHEN gap > 5400000000 THEN (gap - 3600000000) // 3600000000 ELSE 0 END) lost,
  epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS span FROM gap_1h GROUP BY 1, 2)""", ["gap_1h"],
       doubles="expected_frequency_secs median_timestamp_gap_secs maximum_timestamp_gap_secs missing_bar_rate",
       longs="n_observed_bars n_missing_expected_bars")
def _(t):
    return A.bar_grid(S.bars(t, "1h"))


@query("grid_summary", """
SELECT ticker, horizon, n AS n_bars, f AS first_bar, l AS last_bar, (epoch_us(l) - epoch_us(f)) // step + 1 AS expected_bars_if_regular,
 step / 1e6 AS inferred_step_secs, (epoch_us(l) - epoch_us(f)) // step + 1 - n AS missing_bars
FROM (SELECT ticker, horizon, count(*) n, min(timestamp) f, max(timestamp) l FROM bars_1h GROUP BY 1, 2)
JOIN (SELECT ticker, gap AS step, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, gap) rn FROM gap_1h WHERE gap > 0 GROUP BY 1, 2)
USING (ticker) WHERE rn = 1""", ["gap_1h", "bars_1h"], doubles="inferred_step_secs", longs="n_bars expected_bars_if_regular missing_bars")
def _(t):
    return A.grid_summary(S.bars(t, "1h"))


cte("rolled", """
SELECT c.ticker, c.timestamp, c.open, c.high, c.low, c.close, c.volume, f.o AS fine_open, f.h AS fine_high, f.l AS fine_low,
 f.c AS fine_close, f.v AS fine_volume, f.n AS n_fine FROM bars_6h c JOIN (
 SELECT ticker, time_bucket(INTERVAL '6 hours', timestamp) AS timestamp, arg_min(open, timestamp) o, max(high) h, min(low) l,
  arg_max(close, timestamp) c, sum(volume) v, count(*) n FROM bars_1h GROUP BY 1, 2) f USING (ticker, timestamp)""", "bars_6h", "bars_1h")


@query("ohlc_roll_up", "SELECT ticker, timestamp, fine_open, fine_high, fine_low, fine_close, fine_volume, n_fine FROM rolled",
       ["rolled"], doubles="fine_open fine_high fine_low fine_close fine_volume", longs="n_fine")
def _(t):
    return A.roll_up(S.bars(t, "1h"), "6h")


@query("cross_width_report", """
SELECT ticker, '6h' AS coarse_horizon, '1h' AS fine_horizon, count(*) AS n_bars,
 avg(CAST(abs(open - fine_open) <= 1e-8 + 1e-6 * abs(fine_open) AS INT)) AS open_match_rate,
 avg(CAST(abs(high - fine_high) <= 1e-8 + 1e-6 * abs(fine_high) AS INT)) AS high_match_rate,
 avg(CAST(abs(low - fine_low) <= 1e-8 + 1e-6 * abs(fine_low) AS INT)) AS low_match_rate,
 avg(CAST(abs(close - fine_close) <= 1e-8 + 1e-6 * abs(fine_close) AS INT)) AS close_match_rate,
 count(*) FILTER (abs(volume - fine_volume) > 1e-6) AS n_volume_deviations,
 max(abs((volume - fine_volume) / fine_volume)) AS max_abs_volume_rel_deviation, 'bar_start' AS label_convention
FROM rolled GROUP BY 1""", ["rolled"], longs="n_bars n_volume_deviations",
       doubles="open_match_rate high_match_rate low_match_rate close_match_rate max_abs_volume_rel_deviation")
def _(t):
    return A.cross_width_report(A.roll_up_check(S.bars(t, "6h"), S.bars(t, "1h"), "6h", "1h"))


cte("daily_6h", """SELECT ticker, CAST(timestamp AS DATE) AS date, arg_max(close, timestamp) AS close,
arg_max(volume, timestamp) AS volume, sum(volume) AS volume_total FROM bars_6h GROUP BY 1, 2""", "bars_6h")
cte("daily_1h", """SELECT ticker, CAST(timestamp AS DATE) AS date, arg_max(close, timestamp) AS close,
arg_max(volume, timestamp) AS volume, sum(volume) AS volume_total FROM bars_1h GROUP BY 1, 2""", "bars_1h")


@query("daily_last", "SELECT * FROM daily_6h", ["daily_6h"], doubles="close volume volume_total")
def _(t):
    return A.daily_last(S.bars(t, "6h"))


cte("odd_daily", "SELECT ticker, CAST(timestamp AS DATE) AS date, close * 1.01 AS close, volume + 3 AS volume FROM bars_e1d", "bars_e1d")


def _dev(a, b):
    return f"{a} - {b} AS signed_deviation, abs({a} - {b}) AS abs_deviation, abs({a} - {b}) / abs({b}) * 100 AS pct_deviation"


def _cross_sql(h):
    return f"""SELECT i.ticker, i.date, '{h}_vs_1d' AS comparison, 'close' AS metric, i.close AS intra_value, d.close AS daily_value,
 {_dev('i.close', 'd.close')} FROM daily_{h} i JOIN odd_daily d USING (ticker, date)
UNION ALL SELECT i.ticker, i.date, '{h}_vs_1d', 'volume', i.volume_total, d.volume, {_dev('i.volume_total', 'd.volume')}
FROM daily_{h} i JOIN odd_daily d USING (ticker, date)"""


cte("crossdev", _cross_sql("1h") + " UNION ALL " + _cross_sql("6h"), "daily_1h", "daily_6h", "odd_daily")


def odd_daily(t):
    """Daily bars that differ a little from the intraday ones."""
    return S.intraday_bars(t, "1d").select("ticker", "timestamp", (F.col("close") * 1.01).alias("close"),
                                           (F.col("volume") + 3).alias("volume"))


def cross(t):
    d = odd_daily(t)
    return A.cross_horizon(S.bars(t, "1h"), d, "1h").unionByName(A.cross_horizon(S.bars(t, "6h"), d, "6h"))


DEV = "signed_deviation abs_deviation pct_deviation"


@query("cross_horizon_deviation", "SELECT * FROM crossdev", ["crossdev"], doubles=f"intra_value daily_value {DEV}")
def _(t):
    return cross(t)


def _summary_sql(src, keys, a, b):
    return f"""SELECT {keys}, count(pct_deviation) AS n_days, avg(abs_deviation) AS mean_abs_deviation, median(abs_deviation) AS median_abs_deviation,
 max(abs_deviation) AS max_abs_deviation, avg(pct_deviation) AS mean_abs_pct_deviation, median(pct_deviation) AS median_abs_pct_deviation,
 max(pct_deviation) AS max_abs_pct_deviation, CASE WHEN count(pct_deviation) > 1 THEN stddev_samp(pct_deviation) END AS std_abs_pct_deviation,
 arg_max(date, pct_deviation) AS max_dev_date, CASE WHEN count(*) > 1 THEN corr({a}, {b}) END AS correlation FROM {src} GROUP BY ALL"""


SUMMARY = ("mean_abs_deviation median_abs_deviation max_abs_deviation mean_abs_pct_deviation median_abs_pct_deviation "
           "max_abs_pct_deviation std_abs_pct_deviation correlation")


@query("deviation_summary", _summary_sql("crossdev", "ticker, comparison, metric", "intra_value", "daily_value"), ["crossdev"],
       doubles=SUMMARY, longs="n_days")
def _(t):
    return A.deviation_summary(cross(t), ["ticker", "comparison", "metric"], "intra_value", "daily_value")


cte("refcmp", f"""
SELECT d.ticker, d.date, 'close' AS comparison, 'daily_close' AS method, d.close AS exchange_value, r.close AS reference_value,
 {_dev('d.close', 'r.close')} FROM daily_6h d JOIN odd_daily r USING (ticker, date)
UNION ALL SELECT d.ticker, d.date, 'base_volume', 'raw_ohlcv_volume_base_asset_units', d.volume, r.volume, {_dev('d.volume', 'r.volume')}
 FROM daily_6h d JOIN odd_daily r USING (ticker, date)
UNION ALL SELECT d.ticker, d.date, 'quote_volume', 'approx_base_volume_x_daily_close', d.volume * d.close, r.volume,
 {_dev('d.volume * d.close', 'r.volume')} FROM daily_6h d JOIN odd_daily r USING (ticker, date)""", "daily_6h", "odd_daily")


def refcmp(t):
    return A.reference_comparison(S.bars(t, "6h"), odd_daily(t).withColumnRenamed("timestamp", "date"))


@query("reference_comparison", "SELECT * FROM refcmp", ["refcmp"], doubles=f"exchange_value reference_value {DEV}")
def _(t):
    return refcmp(t)


@query("validation_summary", "SELECT * EXCLUDE (max_dev_date), 'cross_horizon' AS block FROM (" + _summary_sql("crossdev", "ticker, comparison", "intra_value", "daily_value")
       + ") UNION ALL SELECT * EXCLUDE (max_dev_date), 'reference' AS block FROM (" + _summary_sql("refcmp", "ticker, comparison", "exchange_value", "reference_value") + ")",
       ["crossdev", "refcmp"], doubles=SUMMARY, longs="n_days")
def _(t):
    a = A.deviation_summary(cross(t), ["ticker", "comparison"], "intra_value", "daily_value").drop("max_dev_date")
    b = A.deviation_summary(refcmp(t), ["ticker", "comparison"], "exchange_value", "reference_value").drop("max_dev_date")
    return A.validation_summary({"cross_horizon": a, "reference": b})


cte("g", """SELECT *, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w AS gap, epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp) AS ng,
lead(log_return_t) OVER w AS nr FROM win_6h WINDOW w AS (PARTITION BY ticker ORDER BY timestamp)""", "win_6h")


@query("interval_start_check", """
SELECT 'regular_grid_equals_h' AS "check", count(*) AS n_violations FROM (
  SELECT ticker, arg_min(gap, (-n, gap)) AS step FROM (SELECT ticker, gap, count(*) n FROM g WHERE gap > 0 GROUP BY 1, 2) GROUP BY 1) WHERE step <> 21600000000
UNION ALL SELECT 'target_is_next_bar', count(*) FILTER (ng = 21600000000 AND nr IS NOT NULL AND target IS NOT NULL AND target <> CAST(nr >= 0 AS INT)) FROM g
UNION ALL SELECT 'no_future_post_in_slot', count(*) FILTER (post_id % 9 = 0 AND time_bucket(INTERVAL '6 hours', date + INTERVAL 4 HOUR) <> time_bucket(INTERVAL '6 hours', date)) FROM scored""",
       ["g", "scored"], longs="n_violations")
def _(t):
    """Every ninth post is booked by a clock that runs four hours fast."""
    f = prices.return_windows(S.bars(t, "6h"), "6h")
    fast = F.when(F.col("post_id") % 9 == 0, F.expr("date + interval '4' hour")).otherwise(F.col("date"))
    posts = S.scored_posts(t).withColumn("fast", fast).withColumn("slot", times.bar_floor("fast", "6h"))
    return A.interval_start_check(f, "6h", posts)


@query("market_cap_lag_audit", """SELECT ticker, timestamp, (epoch_us(timestamp) - epoch_us(market_cap_source_date)) / 86400000000.0 AS lag_days,
market_cap_available_at < timestamp AS strictly_before FROM price_1d""", ["price_1d"], doubles="lag_days")
def _(t):
    return A.asof_lag_audit(price_1d(t)).select("ticker", "timestamp", "lag_days", "strictly_before")


@query("market_cap_lag_summary", """SELECT ticker, count(*) AS n, median(g) AS median_lag_days, min(g) AS min_lag_days, max(g) AS max_lag_days,
avg(CAST(g > 1 AS INT)) AS share_over_one_day, count(*) FILTER (NOT market_cap_available_at < timestamp) AS n_not_strictly_before
FROM (SELECT *, (epoch_us(timestamp) - epoch_us(market_cap_source_date)) / 86400000000.0 AS g FROM price_1d) GROUP BY 1""", ["price_1d"],
       doubles="median_lag_days min_lag_days max_lag_days share_over_one_day", longs="n n_not_strictly_before")
def _(t):
    return A.asof_lag_summary(A.asof_lag_audit(price_1d(t)), ["ticker"])


@query("asof_gate", """SELECT ticker, timestamp FROM price_1d
WHERE NOT market_cap_available_at + CASE ticker WHEN 'T2' THEN INTERVAL 36 HOUR ELSE INTERVAL 0 HOUR END < timestamp""", ["price_1d"])
def _(t):
    """One ticker's values are published a day and a half later than its rows were built for."""
    late = F.expr("market_cap_available_at + if(ticker = 'T2', interval '36' hour, interval '0' hour)")
    return A.asof_violations(price_1d(t).withColumn("market_cap_available_at", late)).select("ticker", "timestamp")


@query("post_cutoff_gate", "SELECT post_id FROM scored WHERE date > TIMESTAMP '2024-01-25 00:00:00'", ["scored"])
def _(t):
    return A.late_posts(S.scored_posts(t), "2024-01-25 00:00:00").select("post_id")


@query("target_interval_gate", """SELECT post_id FROM (SELECT *, time_bucket(INTERVAL '6 hours', date - INTERVAL '5 hours') AS slot FROM scored)
WHERE date >= slot + INTERVAL 6 HOUR AND date < slot + INTERVAL 12 HOUR""", ["scored"])
def _(t):
    p = S.scored_posts(t).withColumn("slot", bar_floor(F.col("date") - F.expr("INTERVAL 5 HOURS"), "6h"))
    return A.posts_in_target_interval(p, "6h").select("post_id")


@query("chronology_gate", """SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) p
FROM orders) WHERE o_orderdate < p""")
def _(t):
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("k"), F.col("o_orderdate").alias("timestamp"))
    return A.unordered_rows(o, ["k"], "o_orderkey").select("o_orderkey")


def provenance(t):
    """Suppliers as venues: three listings per coin, one of them on another venue."""
    s = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    h = F.when(F.col("s_suppkey") % 3 == 0, "1h").when(F.col("s_suppkey") % 3 == 1, " 6H").otherwise("1d")
    return s.select(
        F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("Ticker"), h.alias("Interval"),
        F.concat(F.lit("X"), (F.col("s_suppkey") % 2).cast("string")).alias("Venue"),
        F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("Pair"), F.lit("USDT").alias("quote_currency"),
        (F.col("s_suppkey") % 7).cast("long").alias("gaps"), F.col("s_acctbal").alias("coverage"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("start"),
        F.date_add(F.lit("2022-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("end"))


cte("prov", """
SELECT DISTINCT ON (coin, horizon, exchange) * FROM (
SELECT 'C' || s_nationkey AS coin, CASE s_suppkey % 3 WHEN 0 THEN '1h' WHEN 1 THEN '6h' ELSE '1d' END AS horizon, 'X' || (s_suppkey % 2) AS exchange,
 'P' || s_nationkey AS symbol, 'USDT' AS quote, s_suppkey % 7 AS missing_bars, DATE '2020-01-01' + CAST(s_suppkey AS INT) AS first_date,
 DATE '2022-01-01' + CAST(s_suppkey AS INT) AS last_date, s_acctbal AS coverage_pct FROM supplier)
ORDER BY coin, horizon, exchange, missing_bars, first_date""")


def prov(t):
    return P.union_provenance([P.normalise_provenance(provenance(t), "a.csv"),
                               P.normalise_provenance(provenance(t).withColumn("gaps", F.col("gaps") + 1), "b.csv")])


@query("provenance_union", "SELECT * , 'a.csv' AS source_file FROM prov", ["prov"], longs="missing_bars", doubles="coverage_pct")
def _(t):
    return prov(t)


def _first(c, h):
    return f"arg_min({c}, (exchange, symbol, quote)) FILTER (horizon = '{h}') AS {c}_{h}"


@query("source_consistency", f"""SELECT coin, {', '.join(_first(c, h) for h in ('1h', '6h', '1d') for c in ('exchange', 'symbol', 'quote'))},
{', '.join(f'count(DISTINCT {c}) <= 1 AS {c}_consistent' for c in ('exchange', 'symbol', 'quote'))},
min(coverage_pct) AS coverage_min, max(coverage_pct) AS coverage_max, min(first_date) AS first_date, max(last_date) AS last_date,
sum(missing_bars) AS missing_bars, count(DISTINCT horizon) AS n_horizons FROM prov GROUP BY 1""", ["prov"],
       doubles="coverage_min coverage_max", longs="missing_bars n_horizons")
def _(t):
    return A.source_consistency(prov(t))


MISS = ["timestamp", "ticker", "target", "log_return_t", "vader_selftext_score_mean", "post_count"]


@query("missingness", "SELECT \"column\", n_rows, n_missing, n_missing * 1.0 / n_rows AS share_missing FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM final_6h" for c in MISS) + ")", ["final_6h"],
       doubles="share_missing", longs="n_rows n_missing")
def _(t):
    return A.missingness(final_6h(t), MISS).drop("dtype")


@query("sample_report", "SELECT \"column\", n_rows, n_missing, n_missing * 1.0 / n_rows AS share_missing, dtype, k AS n_tickers, a AS first_timestamp, b AS last_timestamp FROM ("
       + " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", '{d}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT ticker) AS k, min(timestamp) AS a, max(timestamp) AS b FROM win_6h"
           for c, d in (("ticker", "string"), ("timestamp", "timestamp_ntz"), ("log_return_t", "double"), ("target", "int"))) + ")",
       ["win_6h"], doubles="share_missing", longs="n_rows n_missing n_tickers")
def _(t):
    return A.sample_report(prices.return_windows(S.bars(t, "6h"), "6h").select("ticker", "timestamp", "log_return_t", "target"))
