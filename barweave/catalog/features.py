"""Price features, slot aggregates and the final matrix."""
from pyspark.sql import functions as F

from ..operators import prices, slots
from ..sources import registry
from ..sources import standins as S
from .base import cte, query, with_ctes

PF = "log_return_t cum_log_return_7d cum_log_return_14d cum_log_return_21d realized_vol_14d volume_diff log_market_cap_lag1"


def window_sql(bars, bpd):
    f = lambda d: f"(PARTITION BY ticker ORDER BY timestamp ROWS BETWEEN {d * bpd - 1} PRECEDING AND CURRENT ROW)"
    cums = ",\n".join(
        f"CASE WHEN count(r) OVER {f(d)} = {d * bpd} THEN sum(r) OVER {f(d)} END AS cum_log_return_{d}d" for d in (7, 14, 21))
    return f"""
SELECT ticker, timestamp, horizon, close, volume, r AS log_return_t, volume_diff, {cums},
  CASE WHEN count(r) OVER {f(14)} = {14 * bpd} THEN stddev_samp(r) OVER {f(14)} END AS realized_vol_14d,
  CASE WHEN lead(r) OVER w < 0 THEN 0 WHEN lead(r) OVER w IS NOT NULL THEN 1 END AS target
FROM (SELECT ticker, timestamp, horizon, close, volume, ln(nullif(close / nullif(lag(close) OVER w, 0), 0)) AS r,
             volume - lag(volume) OVER w AS volume_diff
      FROM {bars} WINDOW w AS (PARTITION BY ticker ORDER BY timestamp))
WINDOW w AS (PARTITION BY ticker ORDER BY timestamp)"""


cte("win_1d", window_sql("bars_1d", 1), "bars_1d")
cte("win_6h", window_sql("bars_6h", 4), "bars_6h")
cte("caps_known", """SELECT ticker, date AS market_cap_source_date, date + INTERVAL 1 DAY AS market_cap_available_at,
ln(market_cap) AS log_market_cap_lag1 FROM caps WHERE market_cap > 0""", "caps")
cte("price_1d_all", """
SELECT w.*, c.market_cap_source_date, c.market_cap_available_at, c.log_market_cap_lag1
FROM win_1d w ASOF LEFT JOIN caps_known c ON w.ticker = c.ticker AND w.timestamp > c.market_cap_available_at""",
    "win_1d", "caps_known")
cte("price_1d", f"""SELECT timestamp, CAST(timestamp AS DATE) AS date, ticker, horizon, target, {PF.replace(' ', ', ')},
market_cap_source_date, market_cap_available_at FROM price_1d_all
WHERE target IS NOT NULL AND {' AND '.join(c + ' IS NOT NULL' for c in PF.split())}""", "price_1d_all")


def price_1d(t):
    return prices.price_features(S.bars(t, "1d"), S.market_caps(t), "1d")


@query("price_features_1d", "SELECT * FROM price_1d", ["price_1d"], doubles=PF, longs="target")
def _(t):
    return price_1d(t)


@query("return_windows_6h", "SELECT ticker, timestamp, log_return_t, volume_diff, cum_log_return_7d, "
       "cum_log_return_14d, cum_log_return_21d, realized_vol_14d, target FROM win_6h", ["win_6h"],
       doubles="log_return_t volume_diff cum_log_return_7d cum_log_return_14d cum_log_return_21d realized_vol_14d",
       longs="target")
def _(t):
    return prices.return_windows(S.bars(t, "6h"), "6h").select(
        "ticker", "timestamp", "log_return_t", "volume_diff", "cum_log_return_7d", "cum_log_return_14d",
        "cum_log_return_21d", "realized_vol_14d", "target")


@query("price_feature_report", """
SELECT a.ticker, '1d' AS horizon, CASE WHEN coalesce(b.n, 0) > 0 THEN 'ok' ELSE 'empty_after_feature_na_drop' END AS status,
  a.n AS n_input_rows, coalesce(b.n, 0) AS n_output_rows, a.n - coalesce(b.n, 0) AS n_dropped_rows,
  b.f AS first_timestamp, b.l AS last_timestamp, b.s AS share_positive_target
FROM (SELECT ticker, count(*) n FROM bars_1d GROUP BY 1) a LEFT JOIN
     (SELECT ticker, count(*) n, min(timestamp) f, max(timestamp) l, avg(target) s FROM price_1d GROUP BY 1) b
  ON a.ticker = b.ticker""", ["bars_1d", "price_1d"], doubles="share_positive_target",
       longs="n_input_rows n_output_rows n_dropped_rows")
def _(t):
    b = S.bars(t, "1d")
    return prices.feature_build_report(b, prices.price_features(b, S.market_caps(t), "1d"), "1d")


@query("forward_returns_1d", """SELECT ticker, timestamp, ln(nullif(lead(close) OVER (PARTITION BY ticker ORDER BY timestamp) / nullif(close, 0), 0))
AS forward_log_return FROM bars_1d""", ["bars_1d"], doubles="forward_log_return")
def _(t):
    return prices.forward_returns(S.bars(t, "1d").select("ticker", "timestamp", "close")).select(
        "ticker", "timestamp", "forward_log_return")


def _slot_cols():
    out, vs = [], ("title_score", "selftext_score", "combined_score")
    for m in slots.SCORERS:
        out.append(f"{m}_bullishness_ratio")
        out += [f"{m}_{v}_{k}" for v in vs for k in ("mean", "median", "std")]
    return out


SLOT_DOUBLES = " ".join(_slot_cols())
SLOT_LONGS = "post_count " + " ".join(f"{m}_directional_post_count" for m in slots.SCORERS)

cte("blended", """
SELECT *, CASE WHEN u AND vader_selftext_score IS NOT NULL THEN 0.7 * vader_title_score + 0.3 * vader_selftext_score ELSE vader_title_score END AS vader_combined_score,
  CASE WHEN u AND cryptobert_selftext_score IS NOT NULL THEN 0.7 * cryptobert_title_score + 0.3 * cryptobert_selftext_score ELSE cryptobert_title_score END AS cryptobert_combined_score
FROM (SELECT *, lower(trim(coalesce(selftext, ''))) NOT IN ('', '[removed]', '[deleted]', 'nan', 'none') AS u FROM scored)""",
    "scored")


def slot_sql(width):
    parts = ["count(*) AS post_count"]
    for m in slots.SCORERS:
        pos = f"count(*) FILTER ({m}_title_sentiment = 'positive')"
        neg = f"count(*) FILTER ({m}_title_sentiment = 'negative')"
        parts += [f"CASE WHEN {pos} + {neg} > 0 THEN {pos} / ({pos} + {neg}) END AS {m}_bullishness_ratio",
                  f"{pos} + {neg} AS {m}_directional_post_count"]
        for v in ("title_score", "selftext_score", "combined_score"):
            c = f"{m}_{v}"
            parts += [f"avg({c}) AS {m}_{v}_mean", f"median({c}) AS {m}_{v}_median",
                      f"CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END AS {m}_{v}_std"]
    return f"SELECT ticker, time_bucket(INTERVAL '{width}', date) AS timestamp, {', '.join(parts)} FROM blended GROUP BY 1, 2"


for _h, _w in (("1h", "1 hour"), ("6h", "6 hours"), ("1d", "1 day"), ("15min", "15 minutes")):
    cte(f"slots_{_h}", slot_sql(_w), "blended")


def slot_frame(t, h):
    return slots.aggregate_slots(slots.blend_posts(S.scored_posts(t)), h)


def _register_slots(h):
    @query(f"slot_sentiment_{h}", f"SELECT * FROM slots_{h}", [f"slots_{h}"], doubles=SLOT_DOUBLES, longs=SLOT_LONGS, dp=11)
    def _(t):
        return slot_frame(t, h)


for _h in ("15min", "1h", "6h", "1d"):
    _register_slots(_h)


@query("post_blend", """SELECT post_id, u AS has_usable_selftext, vader_combined_score, cryptobert_combined_score FROM blended""",
       ["blended"], doubles="vader_combined_score cryptobert_combined_score")
def _(t):
    return slots.blend_posts(S.scored_posts(t)).select(
        "post_id", "has_usable_selftext", "vader_combined_score", "cryptobert_combined_score")


cte("coverage", """
SELECT horizon, ticker, m AS max_slots, n AS actual_slots, round(n * 100.0 / m, 1) AS coverage_pct,
  round(100.0 - n * 100.0 / m, 1) AS missing_pct, round(md, 1) AS median_posts_per_slot,
  round(s * 100.0 / n, 1) AS single_post_pct, n * 100.0 / m >= 70.0 AS included
FROM (SELECT h.horizon, ticker, count(*) n, median(post_count) md, count(*) FILTER (post_count = 1) s, any_value(h.m) m
      FROM (SELECT '1h' AS horizon, ticker, timestamp, post_count FROM slots_1h
            UNION ALL SELECT '6h', ticker, timestamp, post_count FROM slots_6h) x
      JOIN (SELECT '1h' AS horizon, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 3600000000 + 1 AS m FROM slots_1h
            UNION ALL SELECT '6h', (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 21600000000 + 1 FROM slots_6h) h
        ON x.horizon = h.horizon GROUP BY 1, 2)""", "slots_1h", "slots_6h")


def coverage(t):
    a, b = (slots.coverage_stats(slot_frame(t, h).select("ticker", "timestamp", "post_count"), h) for h in ("1h", "6h"))
    return a.unionByName(b)


@query("slot_coverage", "SELECT * FROM coverage", ["coverage"], longs="max_slots actual_slots",
       doubles="coverage_pct missing_pct median_posts_per_slot single_post_pct")
def _(t):
    return coverage(t)


@query("coverage_ticker_filter", """SELECT ticker, timestamp FROM bars_6h WHERE ticker IN
(SELECT ticker FROM coverage WHERE horizon = '6h' AND coverage_pct >= 85)""", ["bars_6h", "coverage"])
def _(t):
    c = slots.coverage_stats(slot_frame(t, "6h").select("ticker", "timestamp", "post_count"), "6h")
    return slots.covered_tickers(S.bars(t, "6h").select("ticker", "timestamp"), c, "6h")


def _fill_sql():
    cols = []
    for c in SLOT_DOUBLES.split() + SLOT_LONGS.split():
        cols.append(f"coalesce(s.{c}, {registry.neutral_values(c)[0]}) AS {c}")
    return ", ".join(cols)


cte("final_6h", f"""SELECT p.ticker, p.timestamp, p.log_return_t, p.target, {_fill_sql()},
ln(1.0 + coalesce(s.post_count, 0)) AS log1p_post_count, CAST(coalesce(s.post_count, 0) > 0 AS INT) AS has_posts
FROM win_6h p LEFT JOIN slots_6h s ON p.ticker = s.ticker AND p.timestamp = s.timestamp""", "win_6h", "slots_6h")



def final_6h(t):
    price = prices.return_windows(S.bars(t, "6h"), "6h").select("ticker", "timestamp", "log_return_t", "target")
    return slots.merge_features(price, slot_frame(t, "6h"))


@query("final_matrix_6h", "SELECT * FROM final_6h", ["final_6h"],
       doubles=f"log_return_t {SLOT_DOUBLES} log1p_post_count", longs=f"target has_posts {SLOT_LONGS}", dp=11)
def _(t):
    return final_6h(t)


cte("final_1d", f"""SELECT p.*, {_fill_sql()}, ln(1.0 + coalesce(s.post_count, 0)) AS log1p_post_count,
CAST(coalesce(s.post_count, 0) > 0 AS INT) AS has_posts
FROM price_1d p LEFT JOIN (SELECT ticker, timestamp - INTERVAL 9000 DAY AS timestamp, * EXCLUDE (ticker, timestamp) FROM slots_1d) s
ON p.ticker = s.ticker AND p.timestamp = s.timestamp""", "price_1d", "slots_1d")


def final_1d(t):
    """Daily price rows meet daily slots moved back 9000 days into the range of the daily bars."""
    moved = slot_frame(t, "1d").withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 9000 DAY"))
    return slots.merge_features(price_1d(t), moved)


@query("final_matrix_1d", "SELECT * FROM final_1d", ["final_1d"],
       doubles=f"{PF} {SLOT_DOUBLES} log1p_post_count", longs=f"target has_posts {SLOT_LONGS}")
def _(t):
    return final_1d(t)


@query("merge_report_6h", """SELECT count(*) AS n_price_rows, count(DISTINCT p.ticker) AS n_tickers, count(s.ticker) AS n_matched,
count(*) - count(s.ticker) AS n_filled, round((count(*) - count(s.ticker)) * 100.0 / count(*), 2) AS fill_pct
FROM bars_6h p LEFT JOIN slots_6h s ON p.ticker = s.ticker AND p.timestamp = s.timestamp""", ["bars_6h", "slots_6h"],
       doubles="fill_pct", longs="n_price_rows n_tickers n_matched n_filled")
def _(t):
    return slots.merge_report(S.bars(t, "6h"), slot_frame(t, "6h").select("ticker", "timestamp"))


@query("completed_slots", """SELECT ticker, timestamp, post_count FROM slots_6h
WHERE timestamp + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-20 09:00:00'""", ["slots_6h"], longs="post_count")
def _(t):
    return slots.completed_slots(slot_frame(t, "6h"), "6h", "2024-01-20 09:00:00").select("ticker", "timestamp", "post_count")


@query("label_shares", """SELECT scorer, label, n, n * 100.0 / sum(n) OVER (PARTITION BY scorer) AS share_pct FROM (
SELECT 'vader' AS scorer, vader_title_sentiment AS label, count(*) n FROM scored GROUP BY 2
UNION ALL SELECT 'cryptobert', cryptobert_title_sentiment, count(*) FROM scored GROUP BY 2)""", ["scored"],
       doubles="share_pct", longs="n")
def _(t):
    return slots.label_shares(S.scored_posts(t))


@query("scorer_alignment", """SELECT count(*) AS joined,
 sum(CASE WHEN vader_title_sentiment = cryptobert_title_sentiment THEN 1 ELSE 0 END) AS same_label,
 (SELECT count(*) FROM scored WHERE post_id % 5 = 0) AS only_first, (SELECT count(*) FROM scored WHERE post_id % 7 = 0 AND post_id % 5 <> 0) * 0 AS only_second
FROM scored WHERE post_id % 5 <> 0""", ["scored"], longs="joined same_label only_first only_second")
def _(t):
    p = S.scored_posts(t)
    first = p.select("post_id", "vader_title_sentiment")
    second = p.where(F.col("post_id") % 5 != 0).select("post_id", "cryptobert_title_sentiment")
    joined, lone = slots.align_scorers(first, second)
    a = joined.agg(F.count(F.lit(1)).alias("joined"),
                   F.count_if(F.col("vader_title_sentiment") == F.col("cryptobert_title_sentiment")).alias("same_label"))
    return a.withColumns({
        "only_first": lone.where(F.col("side") == "first").agg(F.count(F.lit(1))).scalar(),
        "only_second": lone.where(F.col("side") == "second").agg(F.count(F.lit(1))).scalar()})
