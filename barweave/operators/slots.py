"""Post-level blending, slot aggregates and the merge with price rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import usable_text
from ..functions.times import bar_floor, bar_micros, micros
from ..sources.registry import neutral_values
from .quantiles import percentiles

# Scorers, blend weights and the coverage bar (percent).
SCORERS = ("vader", "cryptobert")
TITLE_WEIGHT, BODY_WEIGHT = 0.7, 0.3
COVERAGE_BAR = 70.0
CROWD = 100_000  # posts of a slot up to which a median may be kept in one task


def blend_posts(posts: DataFrame, scorers=SCORERS) -> DataFrame:
    """combined = 0.7 title + 0.3 body where the body is usable and scored, else the title alone."""
    use = usable_text("selftext")
    cols = {"has_usable_selftext": use}
    for m in scorers:
        t, b = F.col(f"{m}_title_score"), F.col(f"{m}_selftext_score")
        cols[f"{m}_combined_score"] = F.when(use & b.isNotNull(), TITLE_WEIGHT * t + BODY_WEIGHT * b).otherwise(t)
    return posts.withColumns(cols)


def aggregate_slots(posts: DataFrame, horizon, scorers=SCORERS, crowd=CROWD) -> DataFrame:
    """One row per (ticker, slot): counts, bullishness and mean/median/std of each score.

    Medians are exact. Slots of more than ``crowd`` posts, which one count looks for when the plan is built, take theirs from
    the distributed percentile; the state of all others is bounded by that number.
    """
    scores = [f"{m}_{v}" for m in scorers for v in ("title_score", "selftext_score", "combined_score")]
    keys = ["ticker", "timestamp"]
    rows = posts.withColumn("timestamp", bar_floor("date", horizon))
    crowded = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select(*keys)
    if crowded.isEmpty():
        return rows.groupBy(*keys).agg(*_moments(scorers), *[F.median(c).alias(f"{c}_median") for c in scores])
    calm = rows.join(crowded, keys, "left_anti").groupBy(*keys).agg(*[F.median(c).alias(f"{c}_median") for c in scores])
    long = rows.join(crowded, keys, "left_semi").select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("score"), F.col(c).alias("v")) for c in scores])).alias("x")).select(*keys, "x.*")
    busy = percentiles(long, [*keys, "score"], "v", [0.5], ["m"]).groupBy(*keys).agg(*[
        F.max(F.when(F.col("score") == c, F.col("m"))).alias(f"{c}_median") for c in scores])
    return rows.groupBy(*keys).agg(*_moments(scorers)).join(calm.unionByName(busy), keys, "left")


def _moments(scorers):
    aggs = [F.count(F.lit(1)).alias("post_count")]
    for m in scorers:
        s = F.col(f"{m}_title_sentiment")
        pos, neg = F.count_if(s == "positive"), F.count_if(s == "negative")
        aggs += [F.try_divide(pos, pos + neg).alias(f"{m}_bullishness_ratio"),
                 (pos + neg).alias(f"{m}_directional_post_count")]
        for v in ("title_score", "selftext_score", "combined_score"):
            c = F.col(f"{m}_{v}")
            aggs += [F.avg(c).alias(f"{m}_{v}_mean"),
                     F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c)).alias(f"{m}_{v}_std")]
    return aggs


def completed_slots(slots: DataFrame, horizon, observation_cutoff, ts="timestamp") -> DataFrame:
    """Slots whose whole interval lies at or before the cutoff."""
    end = micros(ts) + bar_micros(horizon)
    return slots.where(end <= micros(F.lit(observation_cutoff).cast("timestamp_ntz")))


def coverage_stats(slots: DataFrame, horizon) -> DataFrame:
    """Slots with posts against the slots of the horizon's whole range, per ticker."""
    step = bar_micros(horizon)
    span = slots.agg(((F.max(micros("timestamp")) - F.min(micros("timestamp"))) / step + 1).cast("long").alias("n")).scalar()
    per = slots.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("actual_slots"), F.median("post_count").alias("_median"),
        (F.count_if(F.col("post_count") == 1) * 100.0 / F.count(F.lit(1))).alias("_single"))
    cov = F.col("actual_slots") * 100.0 / F.col("max_slots")
    return per.withColumn("max_slots", span).select(
        F.lit(horizon).alias("horizon"), "ticker", "max_slots", "actual_slots",
        F.round(cov, 1).alias("coverage_pct"), F.round(100.0 - cov, 1).alias("missing_pct"),
        F.round("_median", 1).alias("median_posts_per_slot"), F.round("_single", 1).alias("single_post_pct"),
        (cov >= COVERAGE_BAR).alias("included"))


def covered_tickers(price: DataFrame, coverage: DataFrame, horizon, threshold=85.0) -> DataFrame:
    """Price rows of tickers whose post coverage reaches the threshold (percent)."""
    keep = coverage.where((F.col("horizon") == horizon) & (F.col("coverage_pct") >= threshold)).select("ticker")
    return price.join(keep, "ticker", "left_semi")


def neutral_fill(df: DataFrame, columns) -> DataFrame:
    fills = {c: neutral_values(c)[0] for c in columns if neutral_values(c)[0] is not None}
    return df.fillna(fills) if fills else df


def attention_features(df: DataFrame) -> DataFrame:
    """Built after the fill, so that an empty slot has log1p 0 and has_posts 0."""
    return df.withColumns({
        "log1p_post_count": F.log1p(F.col("post_count").cast("double")),
        "has_posts": (F.col("post_count") > 0).cast("byte")})


def merge_features(price: DataFrame, slots: DataFrame, fill=True) -> DataFrame:
    """Price rows decide the universe; posts are attached where the slot has any."""
    keys = ["ticker", "timestamp"]
    overlap = [c for c in slots.columns if c in price.columns and c not in keys]
    right = slots.drop(*overlap)
    out = price.join(right, keys, "left")
    added = [c for c in right.columns if c not in keys]
    return attention_features(neutral_fill(out, added)) if fill else out


def merge_report(price: DataFrame, slots: DataFrame) -> DataFrame:
    """How much of the price universe the posts reach."""
    hit = slots.select("ticker", "timestamp", F.lit(True).alias("_hit"))
    j = price.select("ticker", "timestamp").join(hit, ["ticker", "timestamp"], "left")
    n, m = F.count(F.lit(1)), F.count("_hit")
    return j.agg(n.alias("n_price_rows"), F.count_distinct("ticker").alias("n_tickers"), m.alias("n_matched"),
                 (n - m).alias("n_filled"), F.round(F.try_divide((n - m) * 100.0, n), 2).alias("fill_pct"))


def align_scorers(first: DataFrame, second: DataFrame, key="post_id"):
    """Join two scored post tables on the post id; also the posts only one of them has."""
    extra = [c for c in second.columns if c not in first.columns]
    joined = first.join(second.select(key, *extra), key)
    lone = first.select(key).join(second.select(key), key, "left_anti").withColumn("side", F.lit("first")).unionByName(
        second.select(key).join(first.select(key), key, "left_anti").withColumn("side", F.lit("second")))
    return joined, lone


def label_shares(posts: DataFrame, scorers=SCORERS) -> DataFrame:
    """Share of each label per scorer, in percent of the labelled posts."""
    pairs = F.array(*[F.struct(F.lit(m).alias("scorer"), F.col(f"{m}_title_sentiment").alias("label")) for m in scorers])
    counts = posts.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("label").isNotNull()) \
        .groupBy("scorer", "label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("scorer").agg(F.sum("n").alias("_total"))
    return counts.join(total, "scorer").select(
        "scorer", "label", "n", (F.col("n") * 100.0 / F.col("_total")).alias("share_pct"))
