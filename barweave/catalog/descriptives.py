"""Feature descriptives, post corpus statistics, series tests, registry tables."""
from pyspark.sql import functions as F

from ..operators import descriptives as D
from ..operators import prices, series
from ..session import reuse
from ..sources import registry
from ..sources import standins as S
from .base import cte, normal_sql, query
from .features import PF, final_1d, price_1d, slot_frame

FEATS = [*PF.split(), "vader_title_score_mean", "vader_bullishness_ratio", "log1p_post_count"]
PRICE = ["log_return_t", "volume_diff", "realized_vol_14d"]


def _empty(f):
    n = registry.neutral_values(f)[1] if registry.group_of(f) == "sentiment" else None
    return f"{f} IS NULL" + (f" OR ({f} = {n} AND post_count = 0)" if n is not None else "")


GROUPS = {"log_return_t": "price", "cum_log_return_7d": "price", "cum_log_return_14d": "price", "cum_log_return_21d": "price",
          "realized_vol_14d": "volatility", "volume_diff": "volume", "log_market_cap_lag1": "market_cap"}
cte("flong", " UNION ALL ".join(
    f"SELECT ticker, timestamp, '{f}' AS feature, '{GROUPS.get(f, 'sentiment')}' AS feature_group, CAST({f} AS DOUBLE) AS v, ({_empty(f)}) AS empty FROM final_1d" for f in FEATS), "final_1d")


def final(t):
    return t.once("final", lambda: final_1d(t).select("ticker", "timestamp", "target", "post_count", *FEATS))


Q = {0.5: "median", **dict(zip(D.PERCENTILES, D.LABELS))}
cte("fstats", f"""SELECT 'x' AS horizon, ticker, feature, any_value(feature_group) AS feature_group, count(*) AS n_rows, count(v) AS n_non_missing, count(*) - count(v) AS n_missing,
 (count(*) - count(v)) * 1.0 / count(*) AS share_missing, count(*) FILTER (v = 0) AS n_zero, count(*) FILTER (v = 0) * 1.0 / count(*) AS share_zero, count(DISTINCT v) AS n_unique,
 avg(v) AS mean, CASE WHEN count(v) > 1 THEN stddev_samp(v) END AS std, min(v) AS min, max(v) AS max, CASE WHEN isnan(skewness(v)) THEN 0 ELSE coalesce(skewness(v), 0) END AS skewness, CASE WHEN isnan(kurtosis(v)) THEN 0 ELSE coalesce(kurtosis(v), 0) END AS kurtosis,
 count(*) FILTER (empty) AS empty_row_count, count(*) FILTER (empty) * 1.0 / count(*) AS share_empty_rows, {', '.join(f'quantile_cont(v, {q}) AS {n}' for q, n in Q.items())},
 min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0 AS date_range_days,
 count(*) - count(DISTINCT timestamp) AS duplicate_timestamp_count FROM flong GROUP BY ticker, feature""", "flong")
TF_D = "share_missing share_zero mean std:5 min max share_empty_rows date_range_days " + " ".join(Q.values())
TF_L = "n_rows n_non_missing n_missing n_zero n_unique empty_row_count duplicate_timestamp_count"


def tf(t):
    return D.by_ticker_feature(final(t), FEATS, "x")


@query("feature_stats_by_ticker", "SELECT * EXCLUDE (skewness, kurtosis) FROM fstats", ["fstats"], doubles=TF_D, longs=TF_L, dp=4)
def _(t):
    return tf(t).drop("skewness", "kurtosis")


@query("feature_moments_by_ticker", "SELECT ticker, feature, skewness, kurtosis FROM fstats", ["fstats"], doubles="skewness kurtosis", dp=4)
def _(t):
    return tf(t).select("ticker", "feature", "skewness", "kurtosis")


@query("feature_stats_pooled", f"""SELECT 'x' AS horizon, feature, feature_group, n_obs_total, mean, std, min, max, {', '.join(Q.values())}, mean_missing_share_across_tickers, max_missing_share_across_tickers,
 mean_zero_share_across_tickers, avg_non_missing_per_ticker, n_tickers_any_valid, n_tickers_all_missing FROM (SELECT feature, any_value(feature_group) AS feature_group, count(v) AS n_obs_total,
 avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, {', '.join(f'quantile_cont(v, {q}) AS {n}' for q, n in Q.items())} FROM flong GROUP BY 1) JOIN (
 SELECT feature, avg(share_missing) AS mean_missing_share_across_tickers, max(share_missing) AS max_missing_share_across_tickers, avg(share_zero) AS mean_zero_share_across_tickers,
 avg(n_non_missing) AS avg_non_missing_per_ticker, count(*) FILTER (n_non_missing > 0) AS n_tickers_any_valid, count(*) FILTER (n_non_missing = 0) AS n_tickers_all_missing FROM fstats GROUP BY 1) USING (feature)""",
       ["fstats"], doubles="mean std min max mean_missing_share_across_tickers max_missing_share_across_tickers mean_zero_share_across_tickers avg_non_missing_per_ticker " + " ".join(Q.values()),
       longs="n_obs_total n_tickers_any_valid n_tickers_all_missing", dp=4)
def _(t):
    f = final(t)
    return D.by_feature(f, FEATS, "x", D.by_ticker_feature(f, FEATS, "x"))


WIN = ["log_return_t", "cum_log_return_21d", "realized_vol_14d", "vader_selftext_score_mean", "vader_bullishness_ratio"]
WINSQL = """(SELECT p.*, CASE WHEN s.post_count % 3 > 0 THEN s.vader_selftext_score_mean END AS vader_selftext_score_mean, CASE WHEN s.post_count % 5 > 0 THEN s.vader_bullishness_ratio END AS vader_bullishness_ratio,
 s.post_count FROM win_6h p LEFT JOIN slots_6h s USING (ticker, timestamp))"""
cte("gappy", f"SELECT ticker, timestamp, post_count, {', '.join(WIN)} FROM {WINSQL}", "win_6h", "slots_6h")


def gappy(t):
    """Price windows with posts, the scores of some slots nulled, so that both kinds of columns have nulls."""
    p = prices.return_windows(S.bars(t, "6h"), "6h")
    n = F.col("post_count")
    s = slot_frame(t, "6h").select("ticker", "timestamp", "post_count", F.when(n % 3 > 0, F.col("vader_selftext_score_mean")).alias("vader_selftext_score_mean"),
                                   F.when(n % 5 > 0, F.col("vader_bullishness_ratio")).alias("vader_bullishness_ratio"))
    return reuse(p.join(s, ["ticker", "timestamp"], "left").select("ticker", "timestamp", "post_count", *WIN))


def _share(f):
    return f"(count(*) - count({f})) * 1.0 / count(*)"


@query("ticker_missingness", f"""SELECT '6h' AS horizon, ticker, count(*) AS n_rows, {len(WIN)} AS n_features_total, {' + '.join(f'CAST({_share(f)} > 0 AS INT)' for f in WIN)} AS n_features_with_any_missing,
 ({' + '.join(_share(f) for f in WIN)}) / {len(WIN)} AS mean_missing_share_across_features, greatest({', '.join(_share(f) for f in WIN)}) AS max_missing_share,
 count(*) FILTER ({' AND '.join(f + ' IS NULL' for f in WIN)}) AS n_empty_rows_all_features, count(*) FILTER ({' AND '.join(f + ' IS NULL' for f in WIN)}) * 1.0 / count(*) AS share_empty_rows_all_features,
 avg(coalesce(post_count, 0)) AS average_posts_per_time_unit, median(coalesce(post_count, 0)) AS median_posts_per_time_unit, sum(coalesce(post_count, 0)) AS total_posts,
 count(*) FILTER (coalesce(post_count, 0) = 0) AS n_time_units_without_posts, count(*) FILTER (coalesce(post_count, 0) = 0) * 1.0 / count(*) AS share_time_units_without_posts,
 min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0 AS date_range_days FROM gappy GROUP BY 2""", ["gappy"],
       doubles="mean_missing_share_across_features max_missing_share share_empty_rows_all_features average_posts_per_time_unit median_posts_per_time_unit total_posts share_time_units_without_posts date_range_days",
       longs="n_rows n_features_total n_features_with_any_missing n_empty_rows_all_features n_time_units_without_posts")
def _(t):
    return D.by_ticker(gappy(t), WIN, "6h")


@query("feature_overview", f"""SELECT '6h' AS horizon, count(*) AS total_rows, count(DISTINCT ticker) AS n_tickers, {len(WIN)} AS n_modelling_features, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
 count(*) * 1.0 / count(DISTINCT ticker) AS avg_rows_per_ticker, (SELECT min(n) FROM (SELECT count(*) n FROM gappy GROUP BY ticker)) AS min_rows_per_ticker,
 (SELECT max(n) FROM (SELECT count(*) n FROM gappy GROUP BY ticker)) AS max_rows_per_ticker, sum({' + '.join(f'CAST({f} IS NULL AS INT)' for f in WIN)}) AS total_missing_values,
 sum({' + '.join(f'CAST({f} IS NULL AS INT)' for f in WIN)}) * 1.0 / (count(*) * {len(WIN)}) AS global_missing_share,
 sum({' + '.join(f'CAST(coalesce({_empty(f).replace("post_count", "coalesce(post_count, 0)")}, FALSE) AS INT)' for f in WIN if registry.group_of(f) == "sentiment")}) AS total_structural_empty_rows,
 avg(coalesce(post_count, 0)) AS average_posts_per_time_unit, count(*) FILTER (coalesce(post_count, 0) = 0) * 1.0 / count(*) AS share_rows_without_posts,
 count(*) - count(DISTINCT (ticker, timestamp)) AS duplicate_ticker_timestamp_rows FROM gappy""", ["gappy"],
       doubles="avg_rows_per_ticker global_missing_share average_posts_per_time_unit share_rows_without_posts",
       longs="total_rows n_tickers n_modelling_features min_rows_per_ticker max_rows_per_ticker total_missing_values total_structural_empty_rows duplicate_ticker_timestamp_rows")
def _(t):
    return D.overview(gappy(t), WIN, "6h")


def _corr_sql():
    parts = []
    for i, a in enumerate(WIN):
        for b in WIN[i + 1:]:
            parts.append(f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr(a, b) AS pearson_corr, corr(ra, rb) AS spearman_corr, count(*) AS n_pairwise FROM (
 SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
 FROM (SELECT {a} AS a, {b} AS b FROM gappy WHERE {a} IS NOT NULL AND {b} IS NOT NULL))""")
    return "SELECT '6h' AS horizon, *, abs(pearson_corr) AS abs_pearson_corr, abs(spearman_corr) AS abs_spearman_corr FROM (" + " UNION ALL ".join(parts) + ") WHERE n_pairwise >= 30"


@query("feature_correlations", _corr_sql(), ["gappy"], doubles="pearson_corr spearman_corr abs_pearson_corr abs_spearman_corr", longs="n_pairwise")
def _(t):
    return D.correlations(gappy(t), WIN, "6h")


@query("structural_empty", "SELECT feature, count(*) FILTER (empty) AS n_empty FROM flong GROUP BY 1", ["flong"], longs="n_empty")
def _(t):
    return D.long_features(final(t), FEATS).groupBy("feature").agg(F.count_if("empty").alias("n_empty"))


@query("feature_groups", "SELECT DISTINCT feature, feature_group FROM flong", ["flong"])
def _(t):
    return D.long_features(final(t), FEATS).select("feature", registry.feature_group(F.col("feature")).alias("feature_group")).distinct()


cte("regsets", "SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', [{', '.join(chr(39) + x + chr(39) for x in fs)}])" for i, _, _, _, fs in registry.set_rows()) + ") v(set_id, features)")


@query("feature_set_resolution", """SELECT set_id, feature, c.column_name AS "column", c.column_name IS NOT NULL AS resolved FROM (SELECT set_id, unnest(features) AS feature FROM regsets) r
 LEFT JOIN (SELECT DISTINCT feature AS column_name FROM flong) c ON c.column_name = r.feature""", ["regsets", "flong"])
def _(t):
    return registry.resolution_report(registry.feature_sets(t.spark), final(t).columns)


@query("feature_set_membership", """SELECT f.feature, string_agg(set_id, ';' ORDER BY set_id) AS feature_set_ids FROM (SELECT set_id, unnest(features) AS feature FROM regsets) r
 JOIN (SELECT DISTINCT feature FROM flong) f ON f.feature = r.feature GROUP BY 1""", ["regsets", "flong"])
def _(t):
    used = D.long_features(final(t), FEATS).select("feature").distinct()
    return registry.membership(registry.feature_sets(t.spark)).join(used, "feature", "left_semi")


# ---- post corpus ---------------------------------------------------------------------------------

DAYS = "(SELECT date_diff('day', min(CAST(date AS DATE)), max(CAST(date AS DATE))) + 1 FROM raw_posts)"


@query("corpus_overview", f"""SELECT count(*) AS total_posts, count(DISTINCT ticker) AS unique_tickers, count(DISTINCT subreddit) AS unique_subreddits, min(CAST(date AS DATE)) AS date_start, max(CAST(date AS DATE)) AS date_end,
 {DAYS} AS total_days, sum(removed) AS total_removed, round(count(*) * 1.0 / {DAYS}, 1) AS avg_posts_per_day, round(count(*) * 1.0 / ({DAYS} * 24), 2) AS avg_posts_per_hour, round(avg(removed) * 100, 2) AS removed_pct FROM raw_posts""", ["raw_posts"],
       doubles="avg_posts_per_day avg_posts_per_hour removed_pct", longs="total_posts unique_tickers unique_subreddits total_days total_removed")
def _(t):
    return D.corpus_overview(S.raw_posts(t))


@query("coin_stats", f"""SELECT ticker, count(*) AS total_posts, count(DISTINCT subreddit) AS subreddits, string_agg(DISTINCT subreddit, ', ' ORDER BY subreddit) AS subreddit_list, sum(removed) AS removed_count,
 round(avg(score), 2) AS avg_score, round(median(score), 2) AS median_score, round(avg(upvote_ratio), 2) AS avg_upvote_ratio, round(avg(num_comments), 2) AS avg_comments, round(avg(total_awards_received), 2) AS avg_awards,
 round(count(*) * 1.0 / {DAYS}, 1) AS avg_posts_per_day, round(count(*) * 1.0 / ({DAYS} * 24), 2) AS avg_posts_per_hour, round(avg(removed) * 100, 2) AS removed_pct FROM raw_posts GROUP BY 1""", ["raw_posts"],
       doubles="avg_score median_score avg_upvote_ratio avg_comments avg_awards avg_posts_per_day avg_posts_per_hour removed_pct", longs="total_posts subreddits removed_count")
def _(t):
    return D.coin_stats(S.raw_posts(t))


@query("engagement_stats", """SELECT ticker, round(avg(score), 2) AS avg_score, round(stddev_samp(score), 2) AS std_score, max(score) AS max_score, round(avg(upvote_ratio), 2) AS avg_upvote_ratio, round(avg(num_comments), 2) AS avg_comments,
 max(num_comments) AS max_comments, round(avg(num_crossposts), 2) AS avg_crossposts, round(avg(total_awards_received), 2) AS avg_awards,
 round(count(selftext) * 100.0 / count(*) - count(*) FILTER (selftext IN ('[removed]', '[deleted]', '')) * 100.0 / count(*), 2) AS pct_with_selftext FROM raw_posts GROUP BY 1""", ["raw_posts"],
       doubles="avg_score std_score avg_upvote_ratio avg_comments avg_crossposts avg_awards pct_with_selftext", longs="max_score max_comments")
def _(t):
    return D.engagement(S.raw_posts(t))


@query("hourly_posts", f"SELECT hour(date) AS hour, count(*) AS total_posts, round(count(*) * 1.0 / {DAYS}, 2) AS avg_per_day FROM raw_posts GROUP BY 1", ["raw_posts"], doubles="avg_per_day", longs="hour total_posts")
def _(t):
    return D.hourly(S.raw_posts(t))


@query("weekday_posts", f"""SELECT dayname(date) AS weekday, count(*) AS total_posts, round(avg(score), 2) AS avg_score, round(avg(num_comments), 2) AS avg_comments, round(count(*) / ({DAYS} / 7.0), 1) AS avg_per_day
 FROM raw_posts GROUP BY 1""", ["raw_posts"], doubles="avg_score avg_comments avg_per_day", longs="total_posts")
def _(t):
    return D.weekdays(S.raw_posts(t))


@query("monthly_volume", "SELECT strftime(date, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (ticker = 'T{i}') AS T{i}" for i in range(5)) + ", count(*) AS total FROM raw_posts GROUP BY 1", ["raw_posts"],
       longs="T0 T1 T2 T3 T4 total")
def _(t):
    return D.monthly_volume(S.raw_posts(t))


@query("daily_posts_centred", """SELECT day, n, CASE WHEN count(*) OVER w = 7 THEN avg(n) OVER w END AS centred_mean FROM (SELECT CAST(date AS DATE) AS day, count(*) AS n FROM raw_posts GROUP BY 1)
 WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", ["raw_posts"], doubles="centred_mean", longs="n")
def _(t):
    return D.daily_posts(S.raw_posts(t))


@query("rolling_sentiment", """SELECT ticker, timestamp, CASE WHEN count(m) OVER w >= 20 THEN avg(m) OVER w END AS rolling_mean, CASE WHEN count(m) OVER w >= 20 THEN stddev_samp(m) OVER w END AS rolling_std FROM
 (SELECT ticker, timestamp, vader_title_score_mean AS m FROM slots_6h) WINDOW w AS (PARTITION BY ticker ORDER BY timestamp ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)""", ["slots_6h"], doubles="rolling_mean rolling_std")
def _(t):
    s = slot_frame(t, "6h").select("ticker", "timestamp", F.col("vader_title_score_mean").alias("m"))
    return prices.rolling_stats(s, ["ticker"], "timestamp", "m", 90, 20).drop("m")


@query("volume_quintiles", """SELECT horizon, ticker, v AS post_count_total, 1 + (SELECT count(*) FROM (SELECT DISTINCT unnest(quantile_cont(v2, [0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM (SELECT sum(post_count) AS v2 FROM slots_6h GROUP BY ticker)) WHERE e < v) AS volume_quintile
FROM (SELECT '6h' AS horizon, ticker, sum(post_count) AS v FROM slots_6h GROUP BY 2)""", ["slots_6h"], longs="post_count_total volume_quintile")
def _(t):
    return D.volume_quintiles(slot_frame(t, "6h").withColumn("horizon", F.lit("6h")))


# ---- series tests --------------------------------------------------------------------------------

def long_price(t):
    return t.once("long", lambda: D.long_features(price_1d(t).select("ticker", "timestamp", *PRICE), PRICE))


cte("slong", " UNION ALL ".join(f"SELECT ticker, timestamp, '{f}' AS feature, {f} AS v FROM price_1d" for f in PRICE), "price_1d")


@query("ar1_persistence", """SELECT *, CASE WHEN ar1_rho > 0 AND ar1_rho < 1 THEN -ln(2) / ln(ar1_rho) END AS ar1_halflife FROM (SELECT ticker, feature, count(*) AS ar1_n, regr_slope(v, l) AS ar1_rho FROM (
 SELECT *, lag(v) OVER (PARTITION BY ticker, feature ORDER BY timestamp) AS l FROM slong) GROUP BY 1, 2)""", ["slong"], doubles="ar1_rho ar1_halflife", longs="ar1_n")
def _(t):
    return series.persistence(long_price(t))


cte("folds", """SELECT ticker, feature, fold, nx AS n_train, ny AS n_val, ks AS ks_stat, u / (nx * 1.0 * ny * (nx + ny)) - (4.0 * nx * ny - 1) / (6.0 * (nx + ny)) AS cvm_stat FROM (
 SELECT ticker, feature, fold, any_value(nx) nx, any_value(ny) ny, max(abs(cx * 1.0 / nx - cy * 1.0 / ny)) ks, any_value(nx) * sum(CASE WHEN role = 'train' THEN (r - j) * (r - j) ELSE 0 END) + any_value(ny) * sum(CASE WHEN role = 'valid' THEN (r - j) * (r - j) ELSE 0 END) u FROM (
 SELECT *, count(*) FILTER (role = 'train') OVER w AS nx, count(*) FILTER (role = 'valid') OVER w AS ny, count(*) FILTER (role = 'train') OVER o AS cx, count(*) FILTER (role = 'valid') OVER o AS cy,
  count(*) OVER o - (count(*) OVER (PARTITION BY ticker, feature, fold, v) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY ticker, feature, fold, role ORDER BY v, timestamp) AS j FROM (
  SELECT *, CASE WHEN b = fold THEN 'valid' ELSE 'train' END AS role FROM (SELECT *, i // (n // 6) AS b FROM (SELECT *, row_number() OVER (PARTITION BY ticker, feature ORDER BY timestamp) - 1 AS i,
   count(*) OVER (PARTITION BY ticker, feature) AS n FROM slong)), (SELECT unnest([1, 2, 3, 4, 5]) AS fold) WHERE b <= fold)
 WINDOW w AS (PARTITION BY ticker, feature, fold), o AS (PARTITION BY ticker, feature, fold ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1, 2, 3) WHERE ny >= 30""", "slong")


@query("fold_stability", "SELECT * FROM folds", ["folds"],
       doubles="ks_stat cvm_stat", longs="fold n_train n_val")
def _(t):
    return series.fold_stability(long_price(t)).drop("ks_pval", "cvm_pval")


cte("cvm_cdf", """SELECT ticker, feature, fold, sum(CASE WHEN q < 350 THEN exp(lgamma(j + 0.5) - lgamma(j + 1)) / (pi() ** 1.5 * sqrt(x)) * sqrt(4 * j + 1) * exp(-2 * q)
  * list_sum(list_transform(range(0, 4001), lambda m: CASE WHEN m = 0 OR m = 4000 THEN 0.5 ELSE 1.0 END * 0.003 * exp(-q * (cosh(m * 0.003) - 1)) * cosh(m * 0.00075))) ELSE 0.0 END) AS cdf, any_value(x) AS x FROM (
 SELECT *, (4 * j + 1) * (4 * j + 1) / (16 * x) AS q FROM (SELECT *, 1.0 / 6 + (cvm_stat - (1 + 1.0 / n) / 6) / sqrt(45 * (n + 1) * (4 * k * n - 3 * (n_train * n_train + n_val * n_val) - 2 * k) / (45.0 * n * n * 4 * k)) AS x
  FROM (SELECT *, (n_train + n_val)::DOUBLE AS n, (n_train * n_val)::DOUBLE AS k FROM folds)), unnest(range(0, 20)) u(j)) GROUP BY 1, 2, 3""", "folds")


@query("fold_stability_pvalues", """SELECT f.*, CASE WHEN z < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * z * z))), 0.0), 1.0) END AS ks_pval,
 CASE WHEN x < 0.003 THEN 1.0 ELSE least(greatest(1 - cdf, 0.0), 1.0) END AS cvm_pval FROM (SELECT *, sqrt(n_train * 1.0 * n_val / (n_train + n_val)) * ks_stat AS z FROM folds) f JOIN cvm_cdf USING (ticker, feature, fold)""",
       ["folds", "cvm_cdf"], doubles="ks_stat cvm_stat z ks_pval cvm_pval", longs="fold n_train n_val")
def _(t):
    f = series.fold_stability(long_price(t))
    return f.withColumn("z", F.sqrt(F.col("n_train") * 1.0 * F.col("n_val") / (F.col("n_train") + F.col("n_val"))) * F.col("ks_stat"))


@query("series_tests")
def _(t):
    """Lag choice and refits have no short SQL; the tests compare with whole-series regressions."""
    return series.series_tests(long_price(t))


cte("centred", """SELECT ticker, feature, timestamp, v - avg(v) OVER (PARTITION BY ticker, feature) AS y, row_number() OVER (PARTITION BY ticker, feature ORDER BY timestamp) - 1 AS i,
 count(*) OVER (PARTITION BY ticker, feature) AS n FROM slong WHERE v IS NOT NULL""", "slong")


cte("gph", f"""SELECT a.*, b.gph_d, b.gph_se, {normal_sql('(gph_d / gph_se)')} AS gph_pval_d0, b.gph_m FROM (SELECT ticker, feature, count(*) AS gph_n FROM centred GROUP BY 1, 2) a LEFT JOIN (
 SELECT ticker, feature, regr_slope(ln((re * re + im * im) / (2 * pi() * n)), -ln(4 * sin(pi() * k / n) * sin(pi() * k / n))) AS gph_d, pi() / sqrt(24.0 * count(*)) AS gph_se, count(*) AS gph_m FROM (
  SELECT ticker, feature, n, k, sum(y * cos(2 * pi() * k * i / n)) AS re, sum(y * sin(2 * pi() * k * i / n)) AS im FROM centred, unnest(range(1, 1 + CAST(floor(sqrt(n)) AS BIGINT))) u(k) WHERE n >= 200 GROUP BY ALL) GROUP BY 1, 2) b
 USING (ticker, feature)""", "centred")


@query("long_memory", "SELECT * FROM gph", ["gph"], doubles="gph_d gph_se gph_pval_d0", longs="gph_n gph_m")
def _(t):
    return series.long_memory(long_price(t))


@query("series_pvalues_bh", """SELECT horizon, ticker, feature, gph_pval_d0, q AS gph_pval_d0_bh, q <= 0.05 AS gph_reject_d0_bh FROM (
 SELECT *, CASE WHEN gph_pval_d0 IS NOT NULL AND n >= 2 THEN least(1.0, min(gph_pval_d0 * n / r) OVER (PARTITION BY horizon ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM (
  SELECT '1d' AS horizon, *, count(gph_pval_d0) OVER () AS n, row_number() OVER (ORDER BY gph_pval_d0 NULLS LAST, ticker, feature) AS r FROM gph))""", ["gph"], doubles="gph_pval_d0 gph_pval_d0_bh")
def _(t):
    """Long-memory tests of all series of a bar width, corrected for their number."""
    r = series.corrected(series.long_memory(long_price(t)).withColumn("horizon", F.lit("1d")), ["gph_pval_d0"])
    return r.select("horizon", "ticker", "feature", "gph_pval_d0", "gph_pval_d0_bh", "gph_reject_d0_bh")


@query("panel_unit_root")
def _(t):
    l = long_price(t)
    return series.cips(l, "c").unionByName(series.cips(l, "ct"))


@query("single_break", """SELECT ticker, feature, n AS n_obs, arg_max(i, gain) AS first_segment, n * ln((any_value(t2) - max(gain)) / n) + 2 * ln(n) AS best_bic FROM (
 SELECT *, CASE WHEN i >= least AND n - i >= least THEN s1 * s1 / i + (t1 - s1) * (t1 - s1) / (n - i) - t1 * t1 / n END AS gain FROM (
  SELECT ticker, feature, i, n, greatest(10, round_even(n * 0.15, 0)) AS least, sum(y) OVER w - y AS s1, sum(y) OVER p AS t1, sum(y * y) OVER p AS t2 FROM centred
  WINDOW w AS (PARTITION BY ticker, feature ORDER BY i), p AS (PARTITION BY ticker, feature))) WHERE gain IS NOT NULL GROUP BY ticker, feature, n""", ["centred"], doubles="best_bic", longs="n_obs first_segment", dp=4)
def _(t):
    """The one best split of each series."""
    b = series.structural_breaks(long_price(t), fixed=1).where("n_breaks = 1")
    return b.select("ticker", "feature", "n_obs", F.element_at("segment_lengths", 1).alias("first_segment"), "best_bic")


@query("structural_breaks")
def _(t):
    return series.structural_breaks(long_price(t))


cte("verdicts", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '1d' ELSE '6h' END AS horizon, ['price', 'volatility', 'volume', 'sentiment'][1 + o_custkey % 4] AS feature_group,
 CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 3 = 0 END AS a_c, o_orderkey % 5 < 2 AS a_ct, o_custkey % 2 = 0 AS k_c, o_custkey % 7 < 3 AS k_ct FROM orders""")
cte("classes", """SELECT *, CASE WHEN a_c IS NULL OR a_ct IS NULL OR k_c IS NULL OR k_ct IS NULL THEN 'n/a' WHEN a_c AND NOT k_c THEN 'I(0)' WHEN a_ct AND NOT k_ct THEN 'trend-stationary'
 WHEN NOT a_c AND k_c THEN 'I(1)' WHEN a_c AND k_c THEN 'conflicting' ELSE 'inconclusive' END AS joint_class FROM verdicts""", "verdicts")


def verdicts(t):
    """Rejections of both tests under both trends, one record per order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    groups = F.array(*map(F.lit, ("price", "volatility", "volume", "sentiment")))
    v = t.orders.select("o_orderkey", F.when(o % 2 == 0, "1d").otherwise("6h").alias("horizon"), F.element_at(groups, (c % 4 + 1).cast("int")).alias("feature_group"),
                        F.when(o % 11 > 0, o % 3 == 0).alias("a_c"), (o % 5 < 2).alias("a_ct"), (c % 2 == 0).alias("k_c"), (c % 7 < 3).alias("k_ct"))
    return v.withColumn("joint_class", series.joint_class(*map(F.col, ("a_c", "a_ct", "k_c", "k_ct"))))


@query("joint_class", "SELECT o_orderkey, joint_class FROM classes", ["classes"])
def _(t):
    return verdicts(t).select("o_orderkey", "joint_class")


@query("joint_class_summary", """SELECT horizon, feature_group, joint_class, n AS count, round(n * 100.0 / sum(n) OVER (PARTITION BY horizon), 4) AS pct_within_horizon,
 round(n * 100.0 / sum(n) OVER (PARTITION BY horizon, feature_group), 4) AS pct_within_feature_group FROM (SELECT horizon, feature_group, joint_class, count(*) AS n FROM classes GROUP BY ALL)""",
       ["classes"], doubles="pct_within_horizon pct_within_feature_group", longs="count")
def _(t):
    return D.joint_class_summary(verdicts(t))


@query("median_persistence", """SELECT '1d' AS horizon, median(ar1_rho) AS median_ar1_rho, median(CASE WHEN ar1_rho > 0 AND ar1_rho < 1 THEN -ln(2) / ln(ar1_rho) END) AS median_halflife FROM (
 SELECT ticker, feature, regr_slope(v, l) AS ar1_rho FROM (SELECT *, lag(v) OVER (PARTITION BY ticker, feature ORDER BY timestamp) AS l FROM slong) GROUP BY 1, 2)""", ["slong"],
       doubles="median_ar1_rho median_halflife")
def _(t):
    return D.median_persistence(series.persistence(long_price(t)).withColumn("horizon", F.lit("1d")))


@query("break_summary", """SELECT horizon, feature_group, feature, count(n_breaks) AS n_series, avg(n_breaks) AS mean_n_breaks, median(n_breaks) AS median_n_breaks, avg(CAST(n_breaks > 0 AS INT)) AS share_with_at_least_one_break,
 median(half) AS median_segment_length_timestamps, avg(whole) AS mean_segment_length_timestamps FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN '1d' ELSE '6h' END AS horizon, 'price' AS feature_group,
 'f' || (o_custkey % 6) AS feature, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 4 END AS n_breaks, o_totalprice / 2 AS half, o_totalprice AS whole FROM orders) GROUP BY ALL""",
       doubles="mean_n_breaks median_n_breaks share_with_at_least_one_break median_segment_length_timestamps mean_segment_length_timestamps", longs="n_series", dp=5)
def _(t):
    o = F.col("o_orderkey")
    b = t.orders.select(F.when(o % 2 == 0, "1d").otherwise("6h").alias("horizon"), F.lit("price").alias("feature_group"), F.concat(F.lit("f"), (F.col("o_custkey") % 6).cast("string")).alias("feature"),
                        F.when(o % 13 > 0, o % 4).alias("n_breaks"), (F.col("o_totalprice") / 2).alias("median_segment_length"), F.col("o_totalprice").alias("mean_segment_length"))
    return D.break_summary(b)
