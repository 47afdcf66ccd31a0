"""Matching forecasts with benchmarks, and the tables built on matched pairs."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import ECON, FAMILY_KEYS, GROUP_KEYS, NAIVE, universe_digest
from ..functions.numeric import ratio
from ..functions.tails import chi2_1_tail
from ..session import reuse
from .metrics import THRESHOLDS, metric_columns, outcome_counts, prediction_at, trade_mask
from .sequence import keep_first

# Categories that are tested against a benchmark, and the test's limits.
ELIGIBLE = ["sentiment", "sentiment_cryptobert", "sentiment_vader", "combined", "combined_cryptobert",
            "combined_vader", "multi"]
ALPHA = 0.05
MIN_MATCHED, MIN_DISCORDANT, MIN_EFFECT_RATE = 50, 20, 0.01

OBS = ["timestamp", "ticker"]
VALUES = ["target", "prediction", "probability"]


def correct(pred="prediction", y="target") -> Column:
    return (F.col(pred).cast("int") == F.col(y).cast("int")).cast("int")


def first_per_key(signals: DataFrame, keys, order=None, extra=()) -> DataFrame:
    """One forecast per key; ``order`` is the ingest order, else the values decide."""
    cols = [*keys, *VALUES, *[c for c in extra if c not in keys], *([order] if order else [])]
    return keep_first(signals.select(*cols), list(keys), [order] if order else VALUES)


def benchmark_pairs(signals: DataFrame, benchmarks=(ECON,), family=FAMILY_KEYS, eligible=ELIGIBLE,
                    cross_family=False, order=None, extra=()) -> DataFrame:
    """Every tested forecast beside its benchmark's forecast of the same family, time and ticker.

    One equi-join serves all groups. ``cross_family`` lets a group whose family lacks the benchmark
    use the per-asset one of the same bar width and tuning variant.
    """
    family = list(family)
    model = signals.where(~F.col("set_id").isin(list(benchmarks)) & F.lower("category").isin(list(eligible)))
    m = first_per_key(model, [*GROUP_KEYS, *OBS], order, ["category", *extra])
    b = signals.where(F.col("set_id").isin(list(benchmarks)))
    b = first_per_key(b, [*family, "set_id", *OBS], order)
    b = b.select(*family, *OBS, F.col("set_id").alias("benchmark"), F.col("target").alias("target_b"),
                 F.col("prediction").alias("prediction_b"), F.col("probability").alias("probability_b"))
    pairs = m.join(b, [*family, *OBS])
    if cross_family:
        have = b.select(*family, "benchmark").distinct()
        names = F.array(*[F.lit(x) for x in benchmarks])
        wanting = m.select(*GROUP_KEYS).distinct().withColumn("benchmark", F.explode(names)) \
            .join(have, [*family, "benchmark"], "left_anti")
        fallback = b.where(F.col("model_type") == "per_asset").select(
            "horizon", "hpo_variant", "benchmark", *OBS, "target_b", "prediction_b", "probability_b")
        other = m.join(wanting, GROUP_KEYS).join(fallback, ["horizon", "hpo_variant", "benchmark", *OBS])
        pairs = pairs.unionByName(other.select(*pairs.columns))
    return pairs.withColumns({"correct_m": correct(), "correct_b": correct("prediction_b")})


def coverage_counts(candidate: DataFrame, reference: DataFrame, keys) -> DataFrame:
    """Sizes, matched and unmatched keys and duplicates of two forecast sets, in one join of key counts."""
    def side(df, name):
        return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    j = side(candidate, "_c").join(side(reference, "_r"), list(keys), "full")
    c, r = F.col("_c").isNotNull(), F.col("_r").isNotNull()
    return j.agg(
        F.count_if(c).alias("n_candidate"), F.count_if(r).alias("n_reference"), F.count_if(c & r).alias("n_matched"),
        F.count_if(c & ~r).alias("n_unmatched_candidate"), F.count_if(r & ~c).alias("n_unmatched_reference"),
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicate_candidate"),
        F.coalesce(F.sum(F.col("_r") - 1), F.lit(0)).alias("n_duplicate_reference"))


def mcnemar_columns(b="b", c="c"):
    """Continuity-corrected statistic and its p-value; no discordant pair gives (0, 1)."""
    x, y = F.col(b), F.col(c)
    d = F.abs(x - y) - 1
    stat = F.when(x + y == 0, F.lit(0.0)).otherwise(ratio(d * d, x + y))
    return stat, F.when(x + y == 0, F.lit(1.0)).otherwise(chi2_1_tail(stat))


def _discordant():
    return [F.count_if((F.col("correct_b") == 1) & (F.col("correct_m") == 0)).alias("b"),
            F.count_if((F.col("correct_b") == 0) & (F.col("correct_m") == 1)).alias("c"),
            F.count(F.lit(1)).alias("n_matched")]


def mcnemar_table(pairs: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    g = pairs.groupBy(*keys, "category", "benchmark").agg(*_discordant())
    stat, p = mcnemar_columns()
    return g.withColumns({"mcnemar_stat": stat, "mcnemar_pval": p}).withColumn(
        "significant_vs_benchmark", F.col("mcnemar_pval") < ALPHA)


def mcnemar_wide(table: DataFrame, benchmarks, keys=GROUP_KEYS) -> DataFrame:
    """One row per model, the results against each benchmark side by side."""
    vals = ["mcnemar_stat", "mcnemar_pval", "significant_vs_benchmark", "n_matched"]
    return table.groupBy(*keys).agg(*[
        F.max(F.when(F.col("benchmark") == b, F.col(v))).alias(f"{v}_vs_{b.lower()}") for b in benchmarks for v in vals])


def mcnemar_by_regime(pairs: DataFrame, regimes, keys=GROUP_KEYS) -> DataFrame:
    """McNemar inside each regime, with validity limits, direction and effect size."""
    g = pairs.dropna(subset=list(regimes)).groupBy(*keys, "category", "benchmark", *regimes).agg(*_discordant())
    b, c, n = F.col("b"), F.col("c"), F.col("n_matched")
    valid = (n >= MIN_MATCHED) & (b + c >= MIN_DISCORDANT)
    stat, p = mcnemar_columns()
    out = g.withColumns({
        "discordant_n": b + c, "test_valid": valid, "mcnemar_stat": F.when(valid, stat), "mcnemar_pval": F.when(valid, p),
        "net_improvement": c - b, "abs_net_improvement": F.abs(c - b), "improvement_rate": ratio(c - b, n),
        "discordant_advantage": ratio(c, b + c),
        "direction": F.when(c > b, "model_better").when(b > c, "benchmark_better").otherwise("tie")})
    sig5 = F.coalesce(F.col("mcnemar_pval") < 0.05, F.lit(False))
    return out.withColumns({
        "significant_5pct": sig5, "significant_10pct": F.coalesce(F.col("mcnemar_pval") < 0.10, F.lit(False)),
        "model_better_raw_5pct": sig5 & (F.col("direction") == "model_better"),
        "benchmark_better_raw_5pct": sig5 & (F.col("direction") == "benchmark_better"),
        "practical_effect_flag": F.col("test_valid") & (F.abs("improvement_rate") >= MIN_EFFECT_RATE)})


def threshold_lift(signals: DataFrame, thresholds=THRESHOLDS, keys=GROUP_KEYS, dp=6) -> DataFrame:
    """Accuracy lift over the benchmark on the rows each threshold trades, in one pass per side."""
    eligible = signals.where((F.col("set_id") != ECON) & F.lower("category").isin(ELIGIBLE))
    n = eligible.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), *[
        F.count_if(trade_mask(F.lit(t))).alias(f"_traded{i}") for i, t in enumerate(thresholds)])
    pairs = benchmark_pairs(signals)
    aggs = []
    for i, th in enumerate(thresholds):
        on = trade_mask(F.lit(th))
        cm = (prediction_at(F.lit(th)) == F.col("target")).cast("int")
        cb = F.col("correct_b")
        aggs += [F.count_if(on).alias(f"_n{i}"), F.sum(F.when(on, cm)).alias(f"_m{i}"), F.sum(F.when(on, cb)).alias(f"_k{i}"),
                 F.count_if(on & (cb == 1) & (cm == 0)).alias(f"_b{i}"), F.count_if(on & (cb == 0) & (cm == 1)).alias(f"_c{i}")]
    g = pairs.groupBy(*keys, "category", "benchmark").agg(*aggs).join(n, list(keys))
    blocks = F.array(*[F.struct(
        F.lit(float(th)).alias("threshold"), F.col(f"_traded{i}").alias("n_traded"), F.col(f"_n{i}").alias("n_matched"),
        F.col(f"_m{i}").alias("m"), F.col(f"_k{i}").alias("k"), F.col(f"_b{i}").alias("b"), F.col(f"_c{i}").alias("c"))
        for i, th in enumerate(thresholds)])
    x = g.select(*keys, "category", "benchmark", "n_obs", F.explode(blocks).alias("z")).select(
        *keys, "category", "benchmark", "n_obs", "z.*")
    stat, p = mcnemar_columns()
    some = F.col("n_matched") > 0
    am, ab = ratio("m", "n_matched"), ratio("k", "n_matched")
    out = x.withColumns({
        "coverage_model": F.round(ratio("n_traded", "n_obs"), dp), "accuracy_model": F.round(am, dp),
        "accuracy_benchmark": F.round(ab, dp), "lift_accuracy": F.round(am - ab, dp),
        "mcnemar_stat": F.when(some, stat), "mcnemar_pval": F.when(some, p)})
    return out.withColumn("significant_vs_benchmark", F.coalesce(F.col("mcnemar_pval") < ALPHA, F.lit(False))) \
        .drop("m", "k", "b", "c", "n_obs")


def lift_class(lift, p) -> Column:
    """Interpretation of a lift and its test."""
    x, sig = F.col(lift), F.coalesce(F.col(p) < ALPHA, F.lit(False))
    return F.when(x.isNull(), "n/a").when((x > 0) & sig, "improved_significant").when(x > 0, "improved") \
        .when((x < 0) & sig, "degraded_significant").when(x < 0, "degraded").otherwise("no_change")


def window_identity(signals: DataFrame, keys) -> DataFrame:
    """The training window a group was run with: (mode, size, days); expanding runs are all alike."""
    mode = signals.groupBy(*keys, "train_window_mode").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.max_by("train_window_mode", F.struct("_n", "train_window_mode")).alias("window_mode"))
    size = signals.groupBy(*keys).agg(F.max("train_window_timestamps").alias("_ts"), F.max("rolling_window_days").alias("_d"))
    ex = F.col("window_mode") == "expanding"
    return mode.join(size, list(keys)).select(
        *keys, "window_mode", F.when(ex, 0.0).otherwise(F.coalesce("_ts", F.lit(0.0))).alias("window_size"),
        F.when(ex, -1.0).otherwise(F.coalesce("_d", F.lit(-1.0))).alias("window_days"))


def pick_benchmarks(signals: DataFrame, mapping: DataFrame) -> DataFrame:
    """For each combined group the benchmark group to use: same run family and training window, tuning
    variant equal, else fixed, else the first. One row per model group, so the ranking window is small.
    """
    ident = window_identity(signals, GROUP_KEYS)
    models = ident.join(mapping, "set_id")
    win = ["window_mode", "window_size", "window_days"]
    cand = ident.where(F.col("sentiment_model") == "-").select(
        "horizon", "model_type", "panel_mode", *win, F.col("set_id").alias("benchmark_set_id"),
        F.col("hpo_variant").alias("benchmark_hpo_variant"))
    j = models.join(cand, ["horizon", "model_type", "panel_mode", *win, "benchmark_set_id"], "left")
    same, fixed = F.col("benchmark_hpo_variant") == F.col("hpo_variant"), F.col("benchmark_hpo_variant") == "fixed"
    rank = F.when(same, 0).when(fixed, 1).otherwise(2)
    w = W.partitionBy(*GROUP_KEYS).orderBy(rank, "benchmark_hpo_variant")
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def incremental_pairs(signals: DataFrame, mapping: DataFrame, order=None, picks=None) -> DataFrame:
    """Matched forecasts of every combined group and its chosen benchmark; ``picks`` spares the choice where it is made already."""
    picks = pick_benchmarks(signals, mapping) if picks is None else picks
    chosen = picks.where(F.col("benchmark_hpo_variant").isNotNull())
    m = first_per_key(signals.join(mapping.select("set_id"), "set_id", "left_semi"), [*GROUP_KEYS, *OBS], order)
    m = m.join(chosen.select(*GROUP_KEYS, "benchmark_set_id", "benchmark_hpo_variant"), GROUP_KEYS)
    b = first_per_key(signals.where(F.col("sentiment_model") == "-"), [*GROUP_KEYS, *OBS], order)
    b = b.select("horizon", "model_type", "panel_mode", F.col("set_id").alias("benchmark_set_id"),
                 F.col("hpo_variant").alias("benchmark_hpo_variant"), *OBS, F.col("target").alias("target_b"),
                 F.col("prediction").alias("prediction_b"), F.col("probability").alias("probability_b"))
    return m.join(b, ["horizon", "model_type", "panel_mode", "benchmark_set_id", "benchmark_hpo_variant", *OBS]) \
        .withColumns({"correct_m": correct(), "correct_b": correct("prediction_b")})


def _both_sides(pairs, keys, a, b):
    """Metrics of both sides of matched pairs, their lifts and McNemar."""
    g = pairs.groupBy(*keys).agg(
        *outcome_counts(prefix="m_"), *outcome_counts(pred="prediction_b", prob="probability_b", prefix="b_"),
        *_discordant(), F.sum("correct_m").alias("model_correct"), F.sum("correct_b").alias("benchmark_correct"),
        F.count_if(~F.col("target").eqNullSafe(F.col("target_b"))).alias("n_target_mismatch"))
    cols = {}
    for side, name in (("m_", a), ("b_", b)):
        m = metric_columns(prefix=side, balanced_single=False, brier_single=True)
        for k, short in (("accuracy", "accuracy"), ("balanced_accuracy", "balanced_accuracy"), ("brier_score", "brier"),
                         ("log_loss", "log_loss"), ("f1", "f1")):
            cols[f"{name}_{short}"] = m[k]
    g = g.withColumns(cols)
    stat, p = mcnemar_columns()
    g = g.withColumns({
        "accuracy_lift": F.col(f"{a}_accuracy") - F.col(f"{b}_accuracy"),
        "balanced_accuracy_lift": F.col(f"{a}_balanced_accuracy") - F.col(f"{b}_balanced_accuracy"),
        "brier_improvement": F.col(f"{b}_brier") - F.col(f"{a}_brier"),
        "log_loss_improvement": F.col(f"{b}_log_loss") - F.col(f"{a}_log_loss"),
        "f1_lift": F.col(f"{a}_f1") - F.col(f"{b}_f1"),
        "mcnemar_b": F.col("b"), "mcnemar_c": F.col("c"), "mcnemar_stat": stat, "mcnemar_p_value": p})
    return g.drop("b", "c", *[f"{s}{c}" for s in ("m_", "b_") for c in ("tp", "tn", "fp", "fn", "n_prob", "ll", "bs")])


def incremental_value(signals: DataFrame, mapping: DataFrame, order=None) -> DataFrame:
    """Does a combined set beat its matched benchmark: both sides' metrics, lifts, test and status."""
    picks = reuse(pick_benchmarks(signals, mapping))  # a row per group, read on both sides of the join
    sides = _both_sides(incremental_pairs(signals, mapping, order, picks), GROUP_KEYS, "model", "benchmark") \
        .drop("n_target_mismatch")
    j = picks.join(sides, GROUP_KEYS, "left")
    status = F.when(F.col("benchmark_hpo_variant").isNull(), "missing_benchmark") \
        .when(F.col("n_matched").isNull(), "no_overlap").otherwise("ok")
    return j.withColumns({
        "status": status, "n_matched": F.coalesce("n_matched", F.lit(0)),
        "interpretation_flag": lift_class("accuracy_lift", "mcnemar_p_value"),
        "significant_raw_5pct": F.coalesce(F.col("mcnemar_p_value") < ALPHA, F.lit(False))})


def with_universe(signals: DataFrame, keys) -> DataFrame:
    """The universe digest of each group: the stamped one, else that of the tickers seen."""
    stamped = F.max(F.when(F.trim("coin_universe_hash") != "", F.col("coin_universe_hash"))) \
        if "coin_universe_hash" in signals.columns else F.lit(None).cast("string")
    return signals.groupBy(*keys).agg(
        F.coalesce(stamped, universe_digest(F.col("ticker"))).alias("universe"), F.count(F.lit(1)).alias("n_rows"))


def absolute_vs_naive(signals: DataFrame, order=None) -> DataFrame:
    """Every model run against the rolling-probability reference of its family.

    The universe digest only tells several references of one family apart; when it cannot, the row is
    marked ambiguous. Keys are matched null-safely.
    """
    match = ["horizon", "model_type", "panel_mode", "train_window_mode", "rolling_window_days"]
    keys = list(dict.fromkeys([*GROUP_KEYS, *match]))
    sig = signals.withColumn("rolling_window_days", F.coalesce("rolling_window_days", F.lit(-1.0)))
    models = sig.where((F.col("set_id") != NAIVE) & (F.lower("hpo_variant") != "naive"))
    naive = sig.where(F.col("set_id") == NAIVE)
    m_id = with_universe(models, keys)
    if "coin_universe_hash" not in naive.columns:
        naive = naive.withColumn("coin_universe_hash", F.lit(None).cast("string"))
    tag = F.lower(F.trim(F.coalesce("coin_universe_hash", F.lit(""))))
    naive = naive.withColumn("_tag", F.when(tag.isin("nan", "none", "null"), "").otherwise(tag))
    n_id = with_universe(naive, [*match, "_tag"]).select(
        *match, "_tag", F.col("universe").alias("naive_universe"))
    j = m_id.join(n_id, match, "left")
    w = W.partitionBy(*keys)
    same = F.col("naive_universe") == F.col("universe")
    j = j.withColumns({"_cands": F.count("naive_universe").over(w), "_same": F.count_if(same).over(w)})
    usable = F.when(F.col("_cands") <= 1, F.lit(True)).otherwise(same & (F.col("_same") == 1))
    j = j.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    pick = j.groupBy(*keys).agg(
        F.max("universe").alias("coin_universe_hash"), F.max("_cands").alias("_cands"),
        F.max(F.when(F.col("_ok"), F.struct("_tag", "naive_universe"))).alias("_pick"))
    # matched rows
    m = first_per_key(models, [*keys, *OBS], order).join(
        pick.select(*keys, F.col("_pick._tag").alias("_tag")).where(F.col("_tag").isNotNull()), keys)
    b = first_per_key(naive, [*match, "_tag", *OBS], order).select(
        *match, "_tag", *OBS, F.col("target").alias("target_b"), F.col("prediction").alias("prediction_b"),
        F.col("probability").alias("probability_b"))
    pairs = m.join(b, [*match, "_tag", *OBS]).withColumns({"correct_m": correct(), "correct_b": correct("prediction_b")})
    sides = _both_sides(pairs, keys, "model", "naive").drop("model_f1", "naive_f1", "f1_lift", "model_correct", "benchmark_correct")
    n_m = models.groupBy(*keys, *OBS).agg(F.count(F.lit(1)).alias("_k")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_model"), F.sum(F.col("_k") - 1).alias("n_duplicate_model_keys"))
    n_b = naive.groupBy(*match, "_tag", *OBS).agg(F.count(F.lit(1)).alias("_k")).groupBy(*match, "_tag").agg(
        F.count(F.lit(1)).alias("n_naive"), F.sum(F.col("_k") - 1).alias("n_duplicate_naive_keys"))
    out = pick.join(n_m, keys).join(sides, keys, "left").withColumn("_tag", F.col("_pick._tag")) \
        .join(n_b, [*match, "_tag"], "left")
    bad = F.col("n_target_mismatch") > 0
    status = F.when(F.col("_cands") == 0, "missing_naive").when(F.col("_pick").isNull(), "ambiguous_naive_identity") \
        .when(F.col("n_matched").isNull(), "no_overlap").when(bad, "target_mismatch").otherwise("ok")
    measured = ["model_accuracy", "naive_accuracy", "accuracy_lift", "model_balanced_accuracy", "naive_balanced_accuracy",
                "balanced_accuracy_lift", "model_brier", "naive_brier", "brier_improvement", "model_log_loss",
                "naive_log_loss", "log_loss_improvement", "mcnemar_b", "mcnemar_c", "mcnemar_stat", "mcnemar_p_value"]
    zero = F.lit(0)
    return out.withColumn("status", status).select(
        *[k for k in keys if k != "rolling_window_days"],
        F.when(F.col("rolling_window_days") >= 0, F.col("rolling_window_days")).alias("rolling_window_days"),
        "coin_universe_hash", F.col("_pick.naive_universe").alias("naive_coin_universe_hash"),
        "n_model", F.coalesce("n_naive", zero).alias("n_naive"), F.coalesce("n_matched", zero).alias("n_matched"),
        (F.col("n_model") - F.coalesce("n_matched", zero)).alias("n_unmatched_model"),
        (F.coalesce("n_naive", zero) - F.coalesce("n_matched", zero)).alias("n_unmatched_naive"),
        "n_duplicate_model_keys", F.coalesce("n_duplicate_naive_keys", zero).alias("n_duplicate_naive_keys"),
        F.when(F.col("n_matched").isNotNull(), ~bad).alias("targets_identical"),
        *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in measured],
        F.when(F.col("status") == "ok", F.col("mcnemar_p_value") < ALPHA).otherwise(False).alias("significant_raw_5pct"),
        "status")


def improvement_indicator(pairs: DataFrame) -> DataFrame:
    """+1 where only the model is right, -1 where only the benchmark is."""
    return pairs.withColumn("d", F.col("correct_m") - F.col("correct_b"))


def completeness(signals: DataFrame, keys=GROUP_KEYS, family=FAMILY_KEYS) -> DataFrame:
    """Rows, duplicates and missing timestamps of every run against its family's benchmark run."""
    keys, family = list(keys), list(family)
    pairs = signals.groupBy(*keys, *OBS).agg(F.count(F.lit(1)).alias("_n"))
    size = pairs.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.count_if(F.col("ticker").isNotNull() & F.col("timestamp").isNotNull()).alias("_pairs"),
        F.count_distinct("ticker").alias("n_tickers"), F.count_distinct("timestamp").alias("n_timestamps"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    times = pairs.where(F.col("timestamp").isNotNull()).select(*keys, "timestamp").distinct()
    grid = times.select("horizon", "timestamp").distinct()
    econ = times.where(F.col("set_id") == ECON).select(*family, "timestamp").distinct()
    n_grid = grid.groupBy("horizon").agg(F.count(F.lit(1)).alias("_grid"))
    n_econ = econ.groupBy(*family).agg(F.count(F.lit(1)).alias("expected_timestamps"))
    hit = times.join(econ, [*family, "timestamp"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_hit"))
    j = size.join(n_grid, "horizon").join(n_econ, family, "left").join(hit, keys, "left")
    exp, n_ts = F.col("expected_timestamps"), F.col("n_timestamps")
    j = j.withColumns({
        "n_duplicate_rows": F.col("n_rows") - F.col("_pairs"),
        "missing_timestamps": exp - F.coalesce("_hit", F.lit(0)),
        "expected_combinations": F.col("n_tickers") * exp,
        "coverage_vs_econ": ratio(n_ts, exp), "coverage_vs_forecast_sample": ratio(n_ts, "_grid")})
    j = j.withColumn("missing_combinations", F.when(
        exp.isNotNull(), F.greatest(F.col("expected_combinations") - F.col("_pairs"), F.lit(0))))
    is_econ = F.col("set_id") == ECON
    status = F.when(exp.isNull() & ~is_econ, "unknown").when(F.col("n_duplicate_rows") > 0, "incomplete") \
        .when(is_econ & (F.col("_grid") > n_ts), "incomplete").when(is_econ, "complete") \
        .when(F.col("missing_timestamps") > 0, "incomplete").when(F.col("missing_combinations") > 0, "incomplete") \
        .otherwise("complete")
    reason = F.when(exp.isNull() & ~is_econ, "no matched benchmark for this family") \
        .when(F.col("n_duplicate_rows") > 0, F.concat(F.col("n_duplicate_rows").cast("string"), F.lit(" duplicate rows"))) \
        .when(is_econ & (F.col("_grid") > n_ts), F.concat(F.lit("benchmark misses "), (F.col("_grid") - n_ts).cast("string"), F.lit(" timestamps"))) \
        .when(is_econ, "") \
        .when(F.col("missing_timestamps") > 0, F.concat(F.lit("misses "), F.col("missing_timestamps").cast("string"), F.lit(" timestamps"))) \
        .when(F.col("missing_combinations") > 0, F.concat(F.lit("ragged panel: "), F.col("missing_combinations").cast("string"), F.lit(" missing"))) \
        .otherwise("")
    return j.withColumns({"status": status, "reason": reason}).withColumn("is_complete", F.col("status") == "complete") \
        .drop("_pairs", "_grid", "_hit")


def strict_sets(signals: DataFrame, registry: DataFrame) -> DataFrame:
    """Keep registered sets and the reference run."""
    keep = registry.select("set_id").unionByName(registry.sparkSession.createDataFrame([(NAIVE,)], "set_id string")).distinct()
    return signals.join(keep, "set_id", "left_semi")
