"""Tests on matched forecasts: clustered differences, timestamp differentials, bootstrap, BH families."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import GROUP_KEYS
from ..functions.numeric import log_loss, ratio
from ..functions.tails import normal_two_sided, t_two_sided
from ..session import reuse
from .sequence import running, with_position

# Tolerances, bootstrap size and level, small-cluster warning, test families.
ZERO_SE = 1e-12
DEGENERATE_VAR = 1e-18
N_BOOT = 10_000
BOOT_CHUNK = 250
BOOT_SEED = 42
ALPHA = 0.05
FEW_CLUSTERS = 10
FAMILIES = {
    "A_H1_logloss": "confirmatory", "B_H1_directional": "confirmatory", "C_H2_volatility": "confirmatory",
    "D_H3_marketcap": "confirmatory", "E1_horizon_logloss": "exploratory", "E2_horizon_accuracy": "exploratory",
    "EXPL_sentiment_only_directional": "exploratory",
}
HORIZON_PAIRS = (("1d", "6h"), ("1d", "1h"), ("6h", "1h"))


# ---- clustered difference in improvement ---------------------------------------------------------

def cluster_difference(df: DataFrame, keys, d="d", regime="regime", treatment="high", control="low",
                       cluster="ticker") -> DataFrame:
    """OLS of d on a treatment dummy with cluster-robust standard error, in closed form.

    With one dummy the fit is two means, and the clusters enter only through their sums of d and counts on
    either side: one combinable aggregate per cluster, then one per group.
    """
    keys = list(keys)
    t, c = F.col(regime) == treatment, F.col(regime) == control
    x = df.where((t | c) & F.col(d).isNotNull())
    per = x.groupBy(*keys, cluster).agg(
        F.count_if(t).alias("n1"), F.count_if(c).alias("n0"),
        F.sum(F.when(t, F.col(d)).otherwise(0)).cast("double").alias("s1"),
        F.sum(F.when(c, F.col(d)).otherwise(0)).cast("double").alias("s0"))
    tot = per.groupBy(*keys).agg(
        F.sum("n1").alias("n_treatment"), F.sum("n0").alias("n_control"), F.count(F.lit(1)).alias("n_clusters"),
        ratio(F.sum("s1"), F.sum("n1")).alias("mean_d_treatment"), ratio(F.sum("s0"), F.sum("n0")).alias("mean_d_control"))
    u = ratio(F.col("s1") - F.col("n1") * F.col("mean_d_treatment"), "n_treatment") \
        - ratio(F.col("s0") - F.col("n0") * F.col("mean_d_control"), "n_control")
    meat = per.join(tot, keys).groupBy(*keys).agg(F.sum(u * u).alias("_v"))
    g, n = F.col("n_clusters"), F.col("n_treatment") + F.col("n_control")
    out = tot.join(meat, keys)
    enough = (F.col("n_control") >= 2) & (F.col("n_treatment") >= 2) & (g >= 2)
    se = F.sqrt(F.greatest(ratio(g, g - 1) * ratio(n - 1, n - 2) * F.col("_v"), F.lit(0.0)))
    out = out.withColumns({
        "diff_in_improvement": F.when(enough, F.col("mean_d_treatment") - F.col("mean_d_control")),
        "se_diff": F.when(enough, se), "dof": F.greatest(g - 1, F.lit(0)),
        "small_cluster_warning": g < FEW_CLUSTERS}).drop("_v")
    flat, none = F.col("se_diff") < ZERO_SE, F.abs("diff_in_improvement") < ZERO_SE
    tstat = F.when(flat, F.when(none, F.lit(0.0))).otherwise(ratio("diff_in_improvement", "se_diff"))
    out = out.withColumn("t_stat", tstat)
    out = out.withColumn("p_value", F.when(F.col("t_stat") == 0, F.lit(1.0)).otherwise(
        t_two_sided("t_stat", F.col("dof").cast("double"))))
    reason = F.when(F.col("se_diff").isNull(), "too_few_clusters_or_obs") \
        .when(F.col("t_stat").isNull(), "zero_cluster_robust_se_nonzero_effect").otherwise("")
    return out.withColumns({"test_valid": F.col("t_stat").isNotNull(), "inference_skip_reason": reason})


# ---- timestamp differentials ---------------------------------------------------------------------

def differentials(pairs: DataFrame, keys=GROUP_KEYS) -> DataFrame:
    """Per timestamp: size and mean differential of log loss and accuracy (positive: the model is better)."""
    d = log_loss("target", F.col("probability_b")) - log_loss("target", F.col("probability"))
    return pairs.groupBy(*keys, "timestamp").agg(
        F.count(F.lit(1)).alias("n_t"), F.avg(d).alias("ll"),
        F.avg((F.col("correct_m") - F.col("correct_b")).cast("double")).alias("acc"))


def effects(diff: DataFrame, value, keys=GROUP_KEYS) -> DataFrame:
    """Mean effect, size-weighted effect, series length, HAC lag, block length, degeneracy."""
    v = F.col(value)
    n = F.count(v)
    g = diff.groupBy(*keys).agg(
        n.alias("n_timestamps"), F.sum("n_t").alias("n_matched"), F.avg(v).alias("effect"),
        ratio(F.sum(v * F.col("n_t")), F.sum("n_t")).alias("effect_ntweighted"), F.var_pop(v).alias("_var"))
    t = F.col("n_timestamps").cast("double")
    return g.withColumns({
        "degenerate": (F.col("n_timestamps") < 2) | (F.col("_var") < DEGENERATE_VAR),
        "hac_lag": F.when(t > 1, F.floor(4.0 * F.pow(t / 100.0, F.lit(2.0 / 9.0)))).otherwise(0).cast("int"),
        "block_length": F.greatest(F.bround(F.pow(t, F.lit(1.0 / 3.0))), F.lit(1.0)).cast("int")}).drop("_var")


def hac(diff: DataFrame, stats: DataFrame, value, keys=GROUP_KEYS) -> DataFrame:
    """Newey-West standard error of the mean with Bartlett weights.

    Each row meets its L successors by an equi-join on (group, position), L growing like T^(2/9); lagged
    products then sum map-side.
    """
    keys = list(keys)
    x = with_position(diff.select(*keys, "timestamp", value), keys, "timestamp")
    x = x.join(stats.select(*keys, "effect", "hac_lag", "n_timestamps"), keys) \
        .withColumn("_dc", F.col(value) - F.col("effect"))
    lags = F.sequence(F.lit(0), F.col("hac_lag"))
    a = x.select(*keys, "hac_lag", "n_timestamps", F.col("_dc").alias("_a"), "_pos", F.explode(lags).alias("_k")) \
        .withColumn("_pos", F.col("_pos") + F.col("_k"))
    b = x.select(*keys, "_pos", F.col("_dc").alias("_b"))
    w = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(2.0 * (1.0 - F.col("_k") / (F.col("hac_lag") + 1.0)))
    j = a.join(b, [*keys, "_pos"]).withColumn("_p", F.col("_a") * F.col("_b"))
    g = j.groupBy(*keys).agg(
        F.sum(w * F.col("_p")).alias("_omega"), F.sum(F.when(F.col("_k") == 0, F.col("_p"))).alias("_g0"),
        F.max("n_timestamps").alias("_t"))
    omega = F.when(F.col("_omega") < 0, F.col("_g0")).otherwise(F.col("_omega")) / F.col("_t")
    return g.select(*keys, F.sqrt(F.greatest(omega, F.lit(0.0)) / F.col("_t")).alias("se_hac"))


def group_name(keys) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def drawn_start(group, replicate, block, starts, seed=BOOT_SEED) -> Column:
    """The start of a drawn block among ``starts``, from a digest of seed, group, replicate and block: a draw depends on its coordinates alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), group, replicate.cast("string"), block.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % starts


def block_sums(diff: DataFrame, sizes: DataFrame, value, keys) -> DataFrame:
    """(keys, start, full, rest): sums of a whole block and of the shorter last one from every start, as differences of running totals."""
    rows = running(diff.where(F.col(value).isNotNull()).select(*keys, "timestamp", value), keys, "timestamp", sums={"_sum": F.col(value), "_pos": F.lit(1)})
    total = rows.select(*keys, F.col("_pos").cast("long").alias("at"), "_sum").unionByName(sizes.select(*keys, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("_sum")))
    total = reuse(total)
    start = total.join(sizes, keys).where(F.col("at") < F.col("starts")).select(
        *keys, F.col("at").alias("start"), F.col("_sum").alias("_from"), (F.col("at") + F.col("length")).alias("_full"), (F.col("at") + F.col("short")).alias("_rest"))
    for c in ("full", "rest"):
        start = start.join(total.select(*keys, F.col("at").alias(f"_{c}"), F.col("_sum").alias(c)), [*keys, f"_{c}"])
    return start.select(*keys, "start", *[(F.col(c) - F.col("_from")).alias(c) for c in ("full", "rest")])


def bootstrap(diff: DataFrame, stats: DataFrame, value, keys=GROUP_KEYS, n_boot=N_BOOT, seed=BOOT_SEED) -> DataFrame:
    """Moving-block bootstrap of the mean: SE, 95 % interval, centred two-sided p.

    A replicate adds up the sums of its drawn blocks, which an equi-join looks up by start; a series of at most one block is drawn value by value.
    Draws are column code over (group, replicate, block), dealt by chunks of replicates to a given number of tasks, since their plan looks tiny
    until they are exploded. For the same reason they are the outer side of the look-up, which no join broadcasts; they are groups x replicates x
    blocks rows of three numbers, the block sums as many as the series have rows. The replicate count is a constant, so the exact percentiles
    keep a constant-size state.
    """
    keys, spark = list(keys), diff.sparkSession
    t = F.col("n_timestamps")
    length = F.when(t > F.col("block_length"), F.col("block_length")).otherwise(1).cast("long")
    sizes = stats.where(~F.col("degenerate")).select(*keys, "effect", t.alias("t"), length.alias("length"))
    sizes = reuse(sizes.withColumn("blocks", F.ceil(F.col("t") / F.col("length"))).withColumns({
        "starts": F.col("t") - F.col("length") + 1, "short": F.col("t") - (F.col("blocks") - 1) * F.col("length"), "g": group_name(keys),
        "gid": F.monotonically_increasing_id()}))
    jobs = sizes.select("gid", "g", "blocks", "starts", F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // BOOT_CHUNK) - 1))).alias("chunk"))
    jobs = jobs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gid", "chunk")
    first = (F.col("chunk") * BOOT_CHUNK).cast("long")
    draws = jobs.withColumn("r", F.explode(F.sequence(first, F.least(first + BOOT_CHUNK, F.lit(n_boot)) - 1)))
    draws = draws.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    draws = draws.select("gid", "r", (F.col("b") == F.col("blocks") - 1).alias("is_last"), drawn_start(F.col("g"), F.col("r"), F.col("b"), F.col("starts"), seed).alias("start"))
    rows = diff.select(*keys, "timestamp", value).join(sizes.select(*keys, "gid"), keys).drop(*keys)
    sums = reuse(block_sums(rows, sizes.select("gid", "length", "short", "starts"), value, ["gid"]))
    reps = draws.join(sums, ["gid", "start"], "left").groupBy("gid", "r").agg(F.sum(F.when(F.col("is_last"), F.col("rest")).otherwise(F.col("full"))).alias("_sum"))
    reps = reps.join(sizes.select("gid", "t", "effect"), "gid", "left").withColumn("_mean", F.col("_sum") / F.col("t"))
    m = F.col("_mean")
    g = reps.groupBy("gid").agg(
        F.stddev_samp(m).alias("se_boot"), F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"),
        F.avg((F.abs(m - F.col("effect")) >= F.abs("effect")).cast("int")).alias("p_boot"))
    return sizes.join(g, "gid").select(*keys, "se_boot", F.col("_ci")[0].alias("ci95_low"), F.col("_ci")[1].alias("ci95_high"), "p_boot")


def timestamp_test(pairs: DataFrame, value, keys=GROUP_KEYS, n_boot=N_BOOT, diff=None) -> DataFrame:
    """Diebold-Mariano-type test on the differential ``ll`` or ``acc``."""
    keys = list(keys)
    diff = differentials(pairs, keys) if diff is None else diff
    st = effects(diff, value, keys)
    out = st.join(hac(diff, st, value, keys), keys, "left")
    if n_boot:
        out = out.join(bootstrap(diff, st, value, keys, n_boot), keys, "left")
    z = F.when(~F.col("degenerate") & (F.col("se_hac") > 0), ratio("effect", "se_hac"))
    out = out.withColumn("z_hac", z).withColumn("p_hac", normal_two_sided("z_hac"))
    return out.withColumns({
        "se_hac": F.when(~F.col("degenerate"), F.col("se_hac")), "test_valid": ~F.col("degenerate"),
        "skip_reason": F.when(F.col("degenerate"), "degenerate_zero_variance").otherwise("")})


def horizon_contrasts(tests: DataFrame, effect="effect", se="se_boot", family="E1_horizon_logloss",
                      by=("set_id", "model_type", "panel_mode", "hpo_variant")) -> DataFrame:
    """Difference of an effect between bar widths, as a normal z."""
    by = list(by)
    wide = tests.groupBy(*by).agg(*[
        F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_{h}") for h in ("1d", "6h", "1h") for c in (effect, se)])
    rows = F.array(*[F.struct(
        F.lit(f"{a}_vs_{b}").alias("horizon_pair"), F.col(f"{effect}_{a}").alias("effect_h1"), F.col(f"{effect}_{b}").alias("effect_h2"),
        F.col(f"{se}_{a}").alias("s1"), F.col(f"{se}_{b}").alias("s2")) for a, b in HORIZON_PAIRS])
    x = wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    sed = F.sqrt(F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2"))
    x = x.withColumns({"family": F.lit(family), "diff": F.col("effect_h1") - F.col("effect_h2"), "se_diff": sed})
    x = x.withColumn("z_stat", F.when(F.col("se_diff") > 0, ratio("diff", "se_diff")))
    return x.withColumn("p_value_raw", normal_two_sided("z_stat")).drop("s1", "s2")


# ---- multiple testing ----------------------------------------------------------------------------

def benjamini_hochberg(records: DataFrame, p="p_value_raw", family="family", tie="test_id", alpha=ALPHA) -> DataFrame:
    """q-values within each family. A family holds one row per (set, bar width), so its window is small."""
    fam = W.partitionBy(family)
    known = F.col(p).isNotNull()
    r = F.row_number().over(fam.orderBy(F.col(p).asc_nulls_last(), tie))
    x = records.withColumns({"_r": r, "_n": F.count(p).over(fam)})
    x = x.withColumn("_q", F.when(known, F.col(p) * F.col("_n") / F.col("_r")))
    tail = fam.orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)
    q = F.when(known, F.least(F.min("_q").over(tail), F.lit(1.0)))
    return x.withColumn("q_value_bh", q).withColumns({
        "alpha_prespecified": F.lit(float(alpha)),
        "significant_bh": F.coalesce(F.col("q_value_bh") < alpha, F.lit(False))}).drop("_r", "_n", "_q")


RUN = ["set_id", "model_type", "panel_mode", "hpo_variant"]


def test_id(family, horizon, *run):
    return F.concat_ws("|", family, horizon, *run)


def _records(df, family, p, metric, horizon="horizon"):
    return df.select(
        test_id(F.lit(family), F.col(horizon), *RUN).alias("test_id"), F.lit(family).alias("family"),
        F.col(horizon).alias("horizon"), *RUN, F.lit(metric).alias("metric"), F.col(p).cast("double").alias("p_value_raw"))


def assemble_families(ll=None, incremental=None, vol_diff=None, size_diff=None, ll_contrasts=None,
                      acc_contrasts=None, sentiment_only=None) -> DataFrame:
    """All test records with their q-values; each family is corrected on its own. Two records of one test fail the job.

    A difference that could not be tested stays as a record without a p-value, which no correction counts, so its family is listed even when none could.
    """
    parts = []
    if ll is not None:
        parts.append(_records(ll, "A_H1_logloss", "p_boot" if "p_boot" in ll.columns else "p_hac", "log_loss"))
    if incremental is not None:
        parts.append(_records(incremental.where(F.col("status") == "ok"), "B_H1_directional", "mcnemar_p_value", "accuracy"))
    for d, fam in ((vol_diff, "C_H2_volatility"), (size_diff, "D_H3_marketcap")):
        if d is not None:
            parts.append(_records(d.withColumn("p_value", F.when(F.col("test_valid"), F.col("p_value"))), fam, "p_value", "accuracy"))
    for c, fam, m in ((ll_contrasts, "E1_horizon_logloss", "log_loss"), (acc_contrasts, "E2_horizon_accuracy", "accuracy")):
        if c is not None:
            parts.append(_records(c, fam, "p_value_raw", m, "horizon_pair"))
    if sentiment_only is not None:
        parts.append(_records(sentiment_only, "EXPL_sentiment_only_directional", "mcnemar_pval", "accuracy"))
    records = reduce(DataFrame.unionByName, parts)
    again = F.count(F.lit(1)).over(W.partitionBy("test_id")) > 1
    unique = F.when(again, F.raise_error(F.concat(F.lit("two records of test "), "test_id"))).otherwise(F.col("test_id"))
    return benjamini_hochberg(records.withColumn("test_id", unique))


def family_manifest(corrected: DataFrame) -> DataFrame:
    """Per family: role, number of tests and of discoveries, member ids."""
    role = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    ok = F.col("p_value_raw").isNotNull()
    return corrected.groupBy("family").agg(
        F.count_if(ok).alias("n_tests"), F.count_if(ok & F.col("significant_bh")).alias("n_significant_bh"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("test_id")))), ";").alias("member_test_ids")) \
        .withColumns({"family_role": role[F.col("family")], "correction": F.lit("BH")})


def distribute_q(table: DataFrame, corrected: DataFrame, family, horizon="horizon") -> DataFrame:
    """Bring a family's q-values back to the table its p-values came from."""
    q = corrected.where(F.col("family") == family).select(F.col("horizon").alias(horizon), *RUN, "q_value_bh", "significant_bh")
    return table.join(q, [horizon, *RUN], "left")


def pooled_verdicts(pooled: DataFrame, corrected: DataFrame) -> DataFrame:
    """One corrected directional verdict per pooled row, in place of uncorrected flags.

    Combined sets carry family B's, sentiment-only sets the exploratory family's; rows without a test keep nulls.
    """
    q = corrected.where(F.col("family").isin("B_H1_directional", "EXPL_sentiment_only_directional")).select(
        "horizon", *RUN, "family", F.col("q_value_bh").alias("mcnemar_q_value_bh_vs_econ"),
        F.col("significant_bh").alias("mcnemar_significant_bh_vs_econ"), F.col("p_value_raw").isNotNull().alias("_tested"))
    q = q.where("_tested").drop("_tested")
    return pooled.drop("significant_vs_econ", "significant_vs_benchmark").join(q, ["horizon", *RUN], "left")


def support_class(prob_sig, dir_sig):
    a, b = F.coalesce(F.col(prob_sig), F.lit(False)), F.coalesce(F.col(dir_sig), F.lit(False))
    return F.when(a & b, "strong").when(a, "probabilistic").when(b, "directional").otherwise("none")
