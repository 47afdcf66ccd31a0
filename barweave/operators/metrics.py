"""Classification and probability metrics from one pass of conditional counts."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import GROUP_KEYS, HPO_OK
from ..functions.numeric import brier, clip_prob, log_loss, ratio

# Default trading thresholds and the distance from one half that counts as imbalance.
THRESHOLDS = (0.50, 0.55, 0.60, 0.65)
IMBALANCE = 0.05


def outcome_counts(y="target", pred="prediction", prob="probability", prefix="", where: Column = None):
    """Aggregates from which every metric follows; all combine map-side."""
    t, p = F.col(y).cast("int"), F.col(pred).cast("int")
    keep = F.lit(True) if where is None else where

    def n(cond):
        return F.count_if(keep & cond)

    q = F.col(prob)
    out = {"tp": n((p == 1) & (t == 1)), "tn": n((p == 0) & (t == 0)), "fp": n((p == 1) & (t == 0)),
           "fn": n((p == 0) & (t == 1)), "n_prob": n(q.isNotNull()),
           "ll": F.avg(F.when(keep, log_loss(t, q))), "bs": F.avg(F.when(keep, brier(t, clip_prob(q))))}
    return [c.alias(f"{prefix}{k}") for k, c in out.items()]


def metric_columns(prefix="", out_prefix="", balanced_single=True, brier_single=False):
    """Metric expressions over outcome_counts columns; single-class slices give nulls.

    ``balanced_single`` keeps balanced accuracy on a single class (the recall of that class);
    ``brier_single`` keeps the Brier score there.
    """
    tp, tn, fp, fn, npr = (F.col(f"{prefix}{c}") for c in ("tp", "tn", "fp", "fn", "n_prob"))
    n, pos, neg = tp + tn + fp + fn, tp + fn, tn + fp
    two = (pos > 0) & (neg > 0)
    tpr, tnr = ratio(tp, pos), ratio(tn, neg)
    bal = F.when(two, (tpr + tnr) / 2.0)
    if balanced_single:
        bal = F.coalesce(bal, tpr, tnr)
    full = npr == n
    cols = {
        "accuracy": ratio(tp + tn, n),
        "balanced_accuracy": bal,
        "f1": F.when(two, F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))),
        "precision": F.when(two, F.coalesce(ratio(tp, tp + fp), F.lit(0.0))),
        "recall": F.when(two, tpr),
        "log_loss": F.when(two & full, F.col(f"{prefix}ll")),
        "brier_score": F.when((F.lit(True) if brier_single else two) & full, F.col(f"{prefix}bs")),
    }
    return {f"{out_prefix}{k}": v for k, v in cols.items()}


def _n(prefix=""):
    return sum((F.col(f"{prefix}{c}") for c in ("tn", "fp", "fn")), F.col(f"{prefix}tp"))


def classification_metrics(signals: DataFrame, keys=GROUP_KEYS, dp=6) -> DataFrame:
    """One row per group: size, span, metrics, confusion counts and one-sided accuracies."""
    meta = [F.max(c).alias(c) for c in ("category", "label") if c in signals.columns and c not in keys]
    g = signals.groupBy(*keys).agg(
        *outcome_counts(), *meta, F.min("timestamp").alias("first_test_timestamp"),
        F.max("timestamp").alias("last_test_timestamp"), F.min("forecast_origin").alias("first_forecast_origin"),
        F.max("forecast_origin").alias("last_forecast_origin"), F.count_distinct("ticker").alias("n_tickers"))
    return _finish(g, dp)


def _finish(g, dp):
    out = g.withColumns({
        "n_obs": _n(), **{k: F.round(v, dp) for k, v in metric_columns().items()},
        "positive_accuracy": ratio("tp", F.col("tp") + F.col("fp")),
        "negative_accuracy": ratio("tn", F.col("tn") + F.col("fn"))})
    return out.drop("n_prob", "ll", "bs")


def metrics_summary(signals: DataFrame, keys=GROUP_KEYS, dp=6) -> DataFrame:
    """A pooled row and a row per ticker for each run, from one pass (grouping sets), with the tuning columns where runs were tuned."""
    from pyspark.sql.functions import grouping
    full = [F.col(k) for k in (*keys, "ticker")]
    sets = [[F.col(k) for k in keys], full]
    g = signals.groupingSets(sets, *full).agg(
        *outcome_counts(), grouping("ticker").alias("_pooled"), F.max("category").alias("category"),
        F.min("timestamp").alias("first_test_timestamp"), F.max("timestamp").alias("last_test_timestamp"))
    out = _finish(g, dp).withColumn(
        "ticker", F.when(F.col("_pooled") == 1, "pooled").otherwise(F.col("ticker"))).drop("_pooled")
    if "hpo_enabled" not in signals.columns:
        return out
    every = [*keys, "ticker"]
    tuned = hpo_summary(signals, keys).withColumn("ticker", F.lit("pooled")).unionByName(hpo_summary(signals, every)).drop("n_tuned")
    return out.join(tuned, every, "left")


def trade_mask(threshold: Column, prob="probability") -> Column:
    p = F.col(prob)
    return (threshold <= 0.5 + 1e-12) | (p > threshold) | (p < 1.0 - threshold)


def prediction_at(threshold: Column, prob="probability") -> Column:
    p = F.col(prob)
    return F.when(threshold <= 0.5 + 1e-12, (p >= 0.5).cast("int")).otherwise((p > threshold).cast("int"))


def threshold_analysis(signals: DataFrame, thresholds=THRESHOLDS, keys=GROUP_KEYS, dp=6) -> DataFrame:
    """Metrics on the traded rows per threshold; a threshold without trades keeps its row.

    All thresholds are counted in one pass of conditional aggregates, so rows are not multiplied.
    """
    aggs = [F.count(F.lit(1)).alias("n_obs"), F.max("category").alias("category")]
    rows = signals.withColumn("probability", clip_prob("probability"))
    for i, th in enumerate(thresholds):
        rows = rows.withColumn(f"_p{i}", prediction_at(F.lit(th)))
    for i, th in enumerate(thresholds):
        aggs += outcome_counts(pred=f"_p{i}", prefix=f"_{i}_", where=trade_mask(F.lit(th)))
    g = rows.groupBy(*keys).agg(*aggs)
    blocks = F.array(*[
        F.struct(F.lit(float(th)).alias("threshold"),
                 *[F.col(f"_{i}_{c}").alias(c) for c in ("tp", "tn", "fp", "fn", "n_prob", "ll", "bs")])
        for i, th in enumerate(thresholds)])
    x = g.select(*keys, "category", "n_obs", F.explode(blocks).alias("b")).select(*keys, "category", "n_obs", "b.*")
    m = metric_columns(brier_single=True)
    return x.select(
        *keys, "category", "threshold", "n_obs", _n().alias("n_trades"),
        F.round(ratio(_n(), "n_obs"), dp).alias("coverage"),
        *[F.round(m[k], dp).alias(k) for k in ("accuracy", "precision", "recall", "f1", "brier_score")])


def class_balance(signals: DataFrame) -> DataFrame:
    g = signals.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("base_rate_up"))
    d = F.abs(F.col("base_rate_up") - 0.5)
    return g.withColumns({"delta_from_half": d, "imbalance_flag": d > IMBALANCE})


def top_per_group(df: DataFrame, keys, order, n) -> DataFrame:
    """The report's best rows per group, over result tables of one row per model."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))) \
        .where(F.col("rank") <= n)


def leaderboard(pooled: DataFrame, n=20) -> DataFrame:
    order = [F.col("accuracy").desc(), *[F.col(k) for k in GROUP_KEYS[1:]]]
    return top_per_group(pooled.where(F.col("accuracy").isNotNull()), ["horizon"], order, n)


def summary_sections(pooled: DataFrame, vol: DataFrame = None, thresholds: DataFrame = None,
                     mcap: DataFrame = None, interaction: DataFrame = None, significance: DataFrame = None,
                     dp=6) -> DataFrame:
    """Headline rows of an evaluation, stacked: averages, best models and significance counts."""
    cols = ["section", "horizon", "item", "set_id", "model_type", "metric", "value"]

    def rows(df, section, value, item=None, set_id=None, model=None, metric="accuracy"):
        null = F.lit(None).cast("string")
        return df.select(
            F.lit(section).alias("section"), "horizon", (F.col(item).cast("string") if item else null).alias("item"),
            (F.col(set_id) if set_id else null).alias("set_id"), (F.col(model) if model else null).alias("model_type"),
            F.lit(metric).alias("metric"), F.round(F.col(value).cast("double"), dp).alias("value"))

    def best(df, section):
        b = top_per_group(df.where(F.col("accuracy").isNotNull()), ["horizon"],
                          [F.col("accuracy").desc(), "set_id", "model_type", "panel_mode"], 1)
        return rows(b, section, "accuracy", set_id="set_id", model="model_type")

    out = rows(pooled.where(F.col("accuracy").isNotNull()).groupBy("horizon", "category").agg(
        F.avg("accuracy").alias("v")), "avg_accuracy_per_category", "v", "category")
    out = out.unionByName(best(pooled.where(F.lower("category").isin("sentiment", "combined")), "best_sentiment_model"))
    if significance is not None:
        out = out.unionByName(rows(significance.groupBy("horizon").agg(
            F.count_if("significant_vs_benchmark").alias("v")), "n_significant_vs_benchmark", "v", metric="count"))
    if vol is not None:
        out = out.unionByName(rows(vol.where(F.col("accuracy").isNotNull()).groupBy("horizon", "vol_regime").agg(
            F.avg("accuracy").alias("v")), "avg_accuracy_per_vol_regime", "v", "vol_regime"))
    if thresholds is not None:
        out = out.unionByName(rows(thresholds.where(F.col("accuracy").isNotNull()).groupBy("horizon", "threshold").agg(
            F.avg("accuracy").alias("v")), "threshold_tradeoff", "v", "threshold"))
    if mcap is not None:
        out = out.unionByName(best(mcap.where((F.col("mcap_regime") == "small") & (F.col("n_obs") > 0)),
                                   "best_small_cap_model"))
    if interaction is not None:
        out = out.unionByName(best(interaction.where(
            (F.col("mcap_regime") == "small") & (F.col("vol_regime") == "high") & (F.col("n_obs") > 0)),
            "best_small_high_vol_model"))
    return out.select(cols)


def hpo_summary(signals: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    """Objective, median and most common choices, and the counts of all tuning statuses, of tuned rows.

    Only rows with ``hpo_enabled`` count (all, where that column is missing); a null status is an ok one, and ties of the most common go to the
    smaller. One histogram of (C, class weight, status) per group carries everything, so the state is bounded by the search grid.
    """
    absent = {c: F.lit(None).cast(k) for c, k in (("best_class_weight", "string"), ("hpo_objective", "string")) if c not in signals.columns}
    rows = signals.withColumns(absent) if absent else signals
    rows = rows.where(F.coalesce("hpo_enabled", F.lit(False))) if "hpo_enabled" in rows.columns else rows
    rows = rows.withColumns({"best_C": F.col("best_C").cast("double"), "hpo_status": F.coalesce("hpo_status", F.lit(HPO_OK))})
    hist = rows.groupBy(*keys, "best_C", "best_class_weight", "hpo_status").agg(
        F.count(F.lit(1)).alias("_n"), F.max("hpo_objective").alias("hpo_objective"))

    def most_common(column, name):
        known = hist.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum("_n").alias("_n"))
        return known.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), column)).alias(name))

    statuses = hist.groupBy(*keys, "hpo_status").agg(F.sum("_n").alias("_n")).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "hpo_status", F.col("_n").cast("string")))), ";").alias("hpo_status_counts"))
    out = rows.groupBy(*keys).agg(F.max("hpo_objective").alias("hpo_objective"), F.median("best_C").alias("best_C_median"), F.count(F.lit(1)).alias("n_tuned"))
    for part in (most_common("best_C", "best_C_mode"), most_common("best_class_weight", "best_class_weight_mode"), statuses):
        out = out.join(part, list(keys), "left")
    return out


def confusion_matrix(df: DataFrame, truth, pred, labels) -> DataFrame:
    """Counts and row shares of a labelled benchmark, every label pair present."""
    g = df.groupBy(F.col(truth).alias("true_label")).agg(*[
        F.count_if(F.col(pred) == x).alias(x) for x in labels])
    total = sum((F.col(x) for x in labels[1:]), F.col(labels[0]))
    return g.withColumns({f"{x}_share": ratio(F.col(x), total) for x in labels})


def class_report(df: DataFrame, truth, pred, labels) -> DataFrame:
    """Precision, recall, F1 and support per label, from one pass."""
    t, p = F.col(truth), F.col(pred)
    one = df.agg(*[a for x in labels for a in (
        F.count_if((t == x) & (p == x)).alias(f"{x}_tp"), F.count_if(t == x).alias(f"{x}_true"),
        F.count_if(p == x).alias(f"{x}_pred"))])
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"{x}_tp").alias("tp"), F.col(f"{x}_true").alias("support"),
                              F.col(f"{x}_pred").alias("n_pred")) for x in labels])
    x = one.select(F.explode(rows).alias("r")).select("r.*")
    zero = F.lit(0.0)
    return x.select(
        "label", F.coalesce(ratio("tp", "n_pred"), zero).alias("precision"), F.coalesce(ratio("tp", "support"), zero).alias("recall"),
        F.coalesce(ratio(2 * F.col("tp"), F.col("n_pred") + F.col("support")), zero).alias("f1"), "support")


def seeded_sample(df: DataFrame, key, n, seed=42) -> DataFrame:
    """A reproducible sample of n rows: the n smallest digests of key and seed (ordered limit, no full sort)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)
