"""End-to-end jobs: final matrix, forecasts, price validation.

Tables that several steps read (bars, the final matrix, forecasts) are written to the shared folder while the plan is built; what is returned
reads them.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import NAIVE, canonical_ticker
from ..functions.times import BARS_PER_DAY, forecast_origin, in_forecast_sample
from ..operators import audits, forecasts, prices, slots, windows
from ..session import reuse
from ..sources.bars import normalise_bars
from ..sources.registry import set_rows

# The forecast sample, half open.
SAMPLE = ("2022-01-01", "2023-01-01")


def final_matrix(bars: DataFrame, caps: DataFrame, posts: DataFrame, horizon, seq=None, coverage_bar=None,
                 fill=True, gate=True) -> DataFrame:
    """Bars, daily market values and scored posts of one bar width to the modelling table."""
    b = reuse(normalise_bars(bars.where(F.col("horizon") == horizon), seq))
    price = prices.price_features(b, caps.withColumn("ticker", canonical_ticker("ticker")), horizon)
    agg = slots.aggregate_slots(slots.blend_posts(posts), horizon)
    if coverage_bar is not None:
        agg = reuse(agg)
        price = slots.covered_tickers(price, slots.coverage_stats(agg, horizon), horizon, coverage_bar)
    out = slots.merge_features(price, agg, fill)
    if gate:
        out = reuse(out)
        audits.require_empty(audits.asof_violations(out), "market value used before it was available")
    return out


def run_models(final: DataFrame, horizon, set_ids=None, days=180, grid=forecasts.C_GRID, objective="log_loss",
               panel_mode="pooled", sample=SAMPLE, chunk_days=30, fraction=0.5, least=30) -> DataFrame:
    """Panel forecasts of the registered sets and the naive reference, with full run identity."""
    rows = [r for r in set_rows() if set_ids is None or r[0] in set_ids]
    sets = {r[0]: r[4] for r in rows}
    final = reuse(final)
    # The sample holds for test times; training windows still reach back before it.
    tests = in_forecast_sample(*sample, forecast_origin("timestamp", F.lit(horizon))) if sample else None
    fit = forecasts.panel_walk_forward(
        final, sets, days, chunk_days, grid=grid, objective=objective, fixed_effects=panel_mode == "ticker_fixed_effects",
        fraction=fraction, least=least, tests=tests)
    naive = windows.panel_rolling_probability(final, days, fraction, least).withColumn("set_id", F.lit(NAIVE))
    out = fit.unionByName(naive, allowMissingColumns=True)
    meta = final.sparkSession.createDataFrame(
        [(i, c, m, l) for i, c, m, l, _ in rows] + [(NAIVE, "reference", "-", "rolling probability")],
        "set_id string, category string, sentiment_model string, label string")
    tuned = f"hpo_{objective.replace('_', '')}" if grid else "fixed"
    out = out.join(meta, "set_id").withColumns({
        "horizon": F.lit(horizon), "model_type": F.lit("panel_logit"), "panel_mode": F.lit(panel_mode),
        "hpo_variant": F.lit(tuned), "hpo_objective": F.lit(objective if grid else None).cast("string")})
    out = windows.stamp_window(out, days, BARS_PER_DAY[horizon]).withColumn("forecast_origin", forecast_origin())
    out = out.where(tests) if sample else out
    universe = final.select("ticker")
    return forecasts.stamp_universe(reuse(out), universe, universe)


def validate_prices(bars: DataFrame, reference: DataFrame = None, seq="seq") -> dict:
    """Quality of every series, cross-width deviations and, with a reference, exchange deviations."""
    one = {h: reuse(bars.where(F.col("horizon") == h)) for h in ("1h", "6h", "1d")}
    dev = audits.cross_horizon(one["1h"], one["1d"], "1h").unionByName(audits.cross_horizon(one["6h"], one["1d"], "6h"))
    out = {"quality": audits.bar_quality(bars, seq), "grid": audits.bar_grid(bars), "deviations": dev}
    blocks = {"cross_horizon": audits.deviation_summary(dev, ["ticker", "comparison", "metric"], "intra_value", "daily_value")}
    if reference is not None:
        ref = audits.reference_comparison(one["1d"], reference)
        out["reference"] = ref
        blocks["reference"] = audits.deviation_summary(ref, ["ticker", "comparison"], "exchange_value", "reference_value")
    out["summary"] = audits.validation_summary(blocks)
    return out
