"""Data-quality reports over bar series, cross-width checks and leakage gates."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import canonical_ticker
from ..functions.numeric import correlation, pct_deviation, ratio
from ..functions.times import BAR_SECONDS, DAY_MICROS, bar_floor, bar_micros, micros
from .sequence import sliding

GAP_TOLERANCE = 1.5
HOUR_MICROS = 3_600_000_000


def _day(c="timestamp"):
    return F.to_date(c)


def _gaps(df, keys, extra=()):
    """Time to the previous distinct or equal bar of the series, in microseconds."""
    rows = df.withColumn("_m", micros("timestamp"))
    return sliding(rows, keys, ["timestamp", *extra], {"_gap": lambda w: F.col("_m") - F.lag("_m").over(w)}, before=1)


def bar_quality(bars: DataFrame, seq) -> DataFrame:
    """Duplicates, non-positive and missing values, gaps over 1.5 bars; per (ticker, horizon)."""
    keys = ["ticker", "horizon"]
    width = bar_micros("horizon")
    g = _gaps(bars, keys, [seq])
    gap = F.col("_gap") > width * GAP_TOLERANCE
    out = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("timestamp").alias("date_min"), F.max("timestamp").alias("date_max"),
        F.count_if(F.col("_gap") == 0).alias("n_duplicates"),
        F.count_if(F.col("close").isNull()).alias("n_missing_close"),
        F.count_if(F.col("volume").isNull()).alias("n_missing_volume"),
        F.count_if(F.col("close") <= 0).alias("n_zero_or_negative_close"),
        F.count_if(F.col("volume") <= 0).alias("n_zero_or_negative_volume"),
        F.count_if(gap).alias("n_gaps"),
        F.round(F.coalesce(F.max(F.when(gap, F.col("_gap"))) / HOUR_MICROS, F.lit(0.0)), 3).alias("max_gap_hours"))
    ok = (F.col("n_duplicates") == 0) & (F.col("n_zero_or_negative_close") == 0) \
        & (F.col("n_missing_close") == 0) & (F.col("n_gaps") == 0)
    return out.withColumn("status", F.when(ok, "ok").otherwise("issues"))


def bar_grid(features: DataFrame) -> DataFrame:
    """Median and largest gap, missing bars and their rate; per (ticker, horizon)."""
    keys = ["ticker", "horizon"]
    width = F.max(bar_micros("horizon"))
    g = _gaps(features.select("ticker", "horizon", "timestamp"), keys)
    h = bar_micros("horizon")
    lost = F.sum(F.when(F.col("_gap") > h * GAP_TOLERANCE, F.floor((F.col("_gap") - h) / h)).otherwise(0))
    # the number of distinct gaps is bounded by the calendar grid, so the exact median's state is too
    out = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observed_bars"), (width / 1e6).alias("expected_frequency_secs"),
        (F.median("_gap") / 1e6).alias("median_timestamp_gap_secs"),
        (F.max("_gap") / 1e6).alias("maximum_timestamp_gap_secs"),
        lost.alias("n_missing_expected_bars"),
        (F.floor((F.max("_m") - F.min("_m")) / width) + 1).alias("_expected"))
    return out.withColumn("missing_bar_rate", F.when(
        F.col("n_observed_bars") >= 2, ratio("n_missing_expected_bars", "_expected"))).drop("_expected")


def grid_summary(bars: DataFrame, keys=("ticker", "horizon")) -> DataFrame:
    """Modal positive spacing (the smaller of equally common ones), expected and missing bars."""
    keys = list(keys)
    g = _gaps(bars.select(*keys, "timestamp"), keys)
    ends = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"), F.min("timestamp").alias("first_bar"),
                                F.max("timestamp").alias("last_bar"))
    mode = g.where(F.col("_gap") > 0).groupBy(*keys, "_gap").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(
        F.max_by("_gap", F.struct("_c", -F.col("_gap"))).alias("_step"))
    out = ends.join(mode, keys, "left")
    span = micros("last_bar") - micros("first_bar")
    out = out.withColumn("expected_bars_if_regular", F.floor(span / F.col("_step")) + 1)
    return out.withColumns({"inferred_step_secs": F.col("_step") / 1e6,
                            "missing_bars": F.col("expected_bars_if_regular") - F.col("n_bars")}).drop("_step")


def roll_up(fine: DataFrame, coarse_horizon, keys=("ticker",)) -> DataFrame:
    """Fine bars gathered into the coarse bar that starts at or before them."""
    first = F.min_by("open", F.when(F.col("open").isNotNull(), F.col("timestamp")))
    last = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("timestamp")))
    return fine.groupBy(*keys, bar_floor("timestamp", coarse_horizon).alias("_start")).agg(
        first.alias("fine_open"), F.max("high").alias("fine_high"), F.min("low").alias("fine_low"),
        last.alias("fine_close"), F.sum("volume").alias("fine_volume"), F.count("open").alias("n_fine")) \
        .withColumnRenamed("_start", "timestamp")


def _close_to(a, b):
    return F.abs(F.col(a) - F.col(b)) <= 1e-8 + 1e-6 * F.abs(F.col(b))


def roll_up_check(coarse: DataFrame, fine: DataFrame, coarse_horizon, fine_horizon) -> DataFrame:
    """Coarse bars against the roll-up of the fine ones, bar by bar."""
    c = coarse.select("ticker", "timestamp", "open", "high", "low", "close", "volume")
    m = c.join(roll_up(fine, coarse_horizon), ["ticker", "timestamp"])
    dev = F.col("volume") - F.col("fine_volume")
    return m.withColumns({
        **{f"{x}_match": _close_to(x, f"fine_{x}") for x in ("open", "high", "low", "close")},
        "volume_deviation": dev, "volume_rel_deviation": ratio(dev, "fine_volume"),
        "coarse_horizon": F.lit(coarse_horizon), "fine_horizon": F.lit(fine_horizon)})


def cross_width_report(checked: DataFrame, keys=("ticker", "coarse_horizon", "fine_horizon")) -> DataFrame:
    """Match rates per series and whether labels look like bar starts."""
    rate = {x: F.avg(F.col(f"{x}_match").cast("int")) for x in ("open", "high", "low", "close")}
    out = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), *[r.alias(f"{x}_match_rate") for x, r in rate.items()],
        F.count_if(F.abs("volume_deviation") > 1e-6).alias("n_volume_deviations"),
        F.max(F.abs("volume_rel_deviation")).alias("max_abs_volume_rel_deviation"))
    worst = F.least(*[F.col(f"{x}_match_rate") for x in rate])
    return out.withColumn("label_convention", F.when(worst >= 0.99, "bar_start").otherwise("inconclusive_or_bar_end"))


def daily_last(bars: DataFrame) -> DataFrame:
    """Last known close and volume, and the volume total, per day."""
    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("timestamp")))
    return bars.groupBy("ticker", _day().alias("date")).agg(
        last("close").alias("close"), last("volume").alias("volume"), F.sum("volume").alias("volume_total"))


def _deviation(df, a, b, **labels):
    d = F.col(a) - F.col(b)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({
        **{k: F.lit(v) for k, v in labels.items()}, "signed_deviation": d, "abs_deviation": F.abs(d),
        "pct_deviation": pct_deviation(F.abs(d), b)})


def cross_horizon(intraday: DataFrame, daily: DataFrame, horizon) -> DataFrame:
    """Intraday last close and total volume against the daily bar, per day."""
    i = daily_last(intraday).select("ticker", "date", F.col("close").alias("ic"), F.col("volume_total").alias("iv"))
    d = daily_last(daily).select("ticker", "date", F.col("close").alias("dc"), F.col("volume").alias("dv"))
    j = i.join(d, ["ticker", "date"])
    name = f"{horizon}_vs_1d"
    keep = ["ticker", "date", "comparison", "metric", "intra_value", "daily_value", "signed_deviation",
            "abs_deviation", "pct_deviation"]
    close = _deviation(j.select("ticker", "date", F.col("ic").alias("intra_value"), F.col("dc").alias("daily_value")),
                       "intra_value", "daily_value", comparison=name, metric="close")
    vol = _deviation(j.select("ticker", "date", F.col("iv").alias("intra_value"), F.col("dv").alias("daily_value")),
                     "intra_value", "daily_value", comparison=name, metric="volume")
    return close.select(keep).unionByName(vol.select(keep))


def reference_comparison(bars: DataFrame, reference: DataFrame, quote_volume=None) -> DataFrame:
    """Daily bars against reference closes and volumes.

    Base volume is compared as a diagnostic; the meaningful one is quote volume, taken from its own column
    or approximated by base volume times close.
    """
    d = daily_last(bars)
    if quote_volume:
        q = bars.groupBy("ticker", _day().alias("date")).agg(
            F.max_by(quote_volume, F.when(F.col(quote_volume).isNotNull(), F.col("timestamp"))).alias("quote"))
        d, how = d.join(q, ["ticker", "date"]), f"direct_column:{quote_volume}"
    else:
        d, how = d.withColumn("quote", F.col("volume") * F.col("close")), "approx_base_volume_x_daily_close"
    r = reference.select("ticker", F.to_date("date").alias("date"), F.col("close").alias("ref_close"),
                         F.col("volume").alias("ref_volume"))
    j = d.join(r, ["ticker", "date"])
    keep = ["ticker", "date", "comparison", "method", "exchange_value", "reference_value", "signed_deviation",
            "abs_deviation", "pct_deviation"]

    def block(a, b, name, method):
        x = j.select("ticker", "date", F.col(a).alias("exchange_value"), F.col(b).alias("reference_value"))
        return _deviation(x, "exchange_value", "reference_value", comparison=name, method=method).select(keep)

    return reduce(DataFrame.unionByName, [
        block("close", "ref_close", "close", "daily_close"),
        block("volume", "ref_volume", "base_volume", "raw_ohlcv_volume_base_asset_units"),
        block("quote", "ref_volume", "quote_volume", how)])


def deviation_summary(dev: DataFrame, keys, a, b) -> DataFrame:
    """Deviation statistics per group of at most one row a day, so exact medians stay bounded."""
    n, pct, ab = F.count("pct_deviation"), F.col("pct_deviation"), F.col("abs_deviation")
    pairs = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    return dev.groupBy(*keys).agg(
        n.alias("n_days"), F.avg(ab).alias("mean_abs_deviation"), F.median(ab).alias("median_abs_deviation"),
        F.max(ab).alias("max_abs_deviation"), F.avg(pct).alias("mean_abs_pct_deviation"),
        F.median(pct).alias("median_abs_pct_deviation"), F.max(pct).alias("max_abs_pct_deviation"),
        F.when(n > 1, F.stddev_samp(pct)).alias("std_abs_pct_deviation"),
        F.max_by("date", F.when(pct.isNotNull(), F.struct(pct, -F.unix_date("date")))).alias("max_dev_date"),
        F.when(pairs > 1, correlation(a, b)).alias("correlation"))


def validation_summary(blocks) -> DataFrame:
    """Stack the summaries of several comparisons, named by block."""
    frames = [df.withColumn("block", F.lit(name)) for name, df in blocks.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def interval_start_check(features: DataFrame, horizon, posts: DataFrame = None) -> DataFrame:
    """Violation counts of the interval-start contract.

    The grid steps by one bar; on contiguous rows the target is the sign of the next return; posts (date, slot) lie
    in the interval of the slot they were booked in.
    """
    h = BAR_SECONDS[horizon] * 1_000_000
    step = grid_summary(features.select("ticker", F.lit(horizon).alias("horizon"), "timestamp"))
    grid = step.agg(F.count_if(~F.coalesce(F.col("inferred_step_secs") * 1e6 == h, F.lit(False))).alias("n")) \
        .select(F.lit("regular_grid_equals_h").alias("check"), F.col("n").alias("n_violations"))
    rows = features.select("ticker", "timestamp", "log_return_t", "target").withColumn("_m", micros("timestamp"))
    nxt = sliding(rows, ["ticker"], "timestamp", {
        "_nm": lambda w: F.lead("_m").over(w), "_nr": lambda w: F.lead("log_return_t").over(w)}, before=0, after=1)
    bad = (F.col("_nm") - F.col("_m") == h) & F.col("_nr").isNotNull() & F.col("target").isNotNull() \
        & (F.col("target").cast("int") != (F.col("_nr") >= 0).cast("int"))
    out = grid.unionByName(nxt.agg(F.count_if(bad).alias("n_violations")).select(
        F.lit("target_is_next_bar").alias("check"), "n_violations"))
    if posts is not None:
        s, p = micros("slot"), micros("date")
        out = out.unionByName(posts.agg(F.count_if(~((p >= s) & (p < s + h))).alias("n_violations")).select(
            F.lit("no_future_post_in_slot").alias("check"), "n_violations"))
    return out


def asof_lag_audit(features: DataFrame, ts="timestamp", source="market_cap_source_date",
                   available="market_cap_available_at") -> DataFrame:
    """Age of the as-of value in days and whether it was available strictly before the row."""
    return features.withColumns({
        "lag_days": (micros(ts) - micros(source)) / float(DAY_MICROS),
        "strictly_before": F.col(available) < F.col(ts)})


def asof_lag_summary(audit: DataFrame, keys) -> DataFrame:
    """Lags are differences of grid times, so the number of distinct ones is bounded by the calendar."""
    lag = F.col("lag_days")
    return audit.where(lag.isNotNull()).groupBy(*keys).agg(
        F.count(lag).alias("n"), F.median(lag).alias("median_lag_days"), F.min(lag).alias("min_lag_days"),
        F.max(lag).alias("max_lag_days"), F.avg((lag > 1).cast("int")).alias("share_over_one_day"),
        F.count_if(~F.col("strictly_before")).alias("n_not_strictly_before"))


def asof_violations(df: DataFrame, ts="timestamp", available="market_cap_available_at") -> DataFrame:
    """Matched rows whose value was not yet available."""
    return df.where(F.col(available).isNotNull() & ~(F.col(available) < F.col(ts)))


def late_posts(posts: DataFrame, cutoff, created="date") -> DataFrame:
    return posts.where(F.col(created) > F.lit(cutoff).cast("timestamp_ntz"))


def posts_in_target_interval(posts: DataFrame, horizon, slot="slot", created="date") -> DataFrame:
    """Posts that fall into the interval the row of their slot predicts."""
    h = bar_micros(horizon)
    s, p = micros(slot), micros(created)
    return posts.where((p >= s + h) & (p < s + 2 * h))


def unordered_rows(df: DataFrame, keys, seq, ts="timestamp") -> DataFrame:
    """Rows that step back in time along their ingest order."""
    rows = df.withColumn("_m", micros(ts))
    out = sliding(rows, keys, [seq], {"_pm": lambda w: F.lag("_m").over(w)}, before=1,
                  block=F.floor(F.col(seq) / 65536))
    return out.where(F.col("_m") < F.col("_pm")).drop("_m", "_pm")


def require_empty(df: DataFrame, what):
    """Gate: stop when a violation exists; looks at one row."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def source_consistency(provenance: DataFrame) -> DataFrame:
    """One row per coin: first known exchange/symbol/quote per bar width and whether they agree; unknown values come last."""
    p = provenance.withColumn("coin", canonical_ticker("coin"))
    width = ("1h", "6h", "1d")
    order = F.struct(*[x for c in ("exchange", "symbol", "quote") for x in (F.col(c).isNull(), F.col(c))])
    aggs = []
    for h in width:
        here = F.col("horizon") == h
        for c in ("exchange", "symbol", "quote"):
            aggs.append(F.min_by(c, F.when(here & F.col(c).isNotNull(), order)).alias(f"{c}_{h}"))
    aggs += [(F.count_distinct(c) <= 1).alias(f"{c}_consistent") for c in ("exchange", "symbol", "quote")]
    aggs += [F.min("coverage_pct").alias("coverage_min"), F.max("coverage_pct").alias("coverage_max"),
             F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
             F.sum("missing_bars").alias("missing_bars"), F.count_distinct("horizon").alias("n_horizons")]
    return p.groupBy("coin").agg(*aggs)


def common_row_ids(frames, column="row_id") -> DataFrame:
    """Row ids present in every frame."""
    ids = reduce(DataFrame.unionByName, [
        f.select(column).distinct().withColumn("_f", F.lit(i)) for i, f in enumerate(frames)])
    return ids.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(frames)).select(column)


def missingness(df: DataFrame, columns=None) -> DataFrame:
    """Null count and share per column, in one pass."""
    columns = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    kinds = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(c).alias("n_missing"))
                     for c in columns])
    return one.select("n", F.explode(rows).alias("x")).select(
        "x.column", "x.dtype", F.col("n").alias("n_rows"), "x.n_missing",
        ratio("x.n_missing", "n").alias("share_missing"))


def sample_report(df: DataFrame) -> DataFrame:
    """Missingness per column beside the table's size and date range."""
    span = df.agg(F.count_distinct("ticker").alias("k"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return missingness(df).withColumns({
        "n_tickers": span.select("k").scalar(), "first_timestamp": span.select("a").scalar(),
        "last_timestamp": span.select("b").scalar()})
