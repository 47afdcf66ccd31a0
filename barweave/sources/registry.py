"""The registered feature sets: one benchmark, four blocks per scorer alone, and each block on top."""
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Scorer tags and the columns of each sentiment block.
SCORER_TAGS = {"VAD": "vader", "CBT": "cryptobert"}
BLOCKS = {
    "L": ["{model}_title_score_mean"],
    "LD": ["{model}_title_score_mean", "{model}_title_score_std"],
    "DA": ["{model}_bullishness_ratio", "log1p_post_count"],
    "F": ["{model}_title_score_mean", "{model}_title_score_std", "{model}_bullishness_ratio", "log1p_post_count"],
}
CORE = ["log_return_t", "cum_log_return_7d", "cum_log_return_14d", "cum_log_return_21d", "realized_vol_14d",
        "volume_diff", "log_market_cap_lag1"]

# Name patterns of the feature groups, first fit counts.
GROUP_RULES = [
    ("price", r"^(log_return_t|cum_log_return_(7|14|21)d)$"), ("volatility", r"^realized_vol_14d$"), ("volume", r"^volume_diff$"),
    ("market_cap", r"^log_market_cap_lag1$"), ("sentiment", r"^(vader|cryptobert)_|bullishness|sentiment|^(log1p_)?post_count$|^has_posts$"),
]

# Name patterns with the fill of an empty slot and the value that marks one, first fit counts.
NEUTRAL_RULES = [
    (r"_weighted_mean$", None, 0.0), (r"(^|_)post_count$", 0, None), (r"bullishness", 0.5, 0.5), (r"_mean|_score", 0.0, 0.0), (r"", 0.0, None),
]


def set_rows():
    rows = [("ECON", "benchmark", "-", "price core", CORE)]
    for tag, model in SCORER_TAGS.items():
        for block, cols in BLOCKS.items():
            mine = [c.format(model=model) for c in cols]
            rows.append((f"SENT_{tag}_{block}", "sentiment", model, f"{model} block {block}", mine))
            rows.append((f"ECON_{tag}_{block}", "combined", model, f"price core + {model} block {block}", CORE + mine))
    return rows


def feature_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        set_rows(), "set_id string, category string, sentiment_model string, label string, features array<string>")


def benchmark_map(sets: DataFrame, benchmark="ECON") -> DataFrame:
    """Every combined set with the benchmark it is measured against."""
    return sets.where("category = 'combined'").select("set_id", F.lit(benchmark).alias("benchmark_set_id"))


def resolution_report(sets: DataFrame, columns) -> DataFrame:
    """Which requested features of each set exist in a table."""
    have = sets.sparkSession.createDataFrame([(c.lower(), c) for c in columns], "low string, column string")
    want = sets.select("set_id", F.explode("features").alias("feature")).withColumn("low", F.lower("feature"))
    return want.join(have, "low", "left").select(
        "set_id", "feature", "column", F.col("column").isNotNull().alias("resolved"))


def resolve(columns, numeric=(), exclude=()):
    """Feature columns of the registered sets that a table has; any numeric column when there are none."""
    low = {c.lower(): c for c in columns}
    found = {}
    for set_id, _, _, _, feats in set_rows():
        if set_id not in exclude:
            found.update({low[f.lower()]: None for f in feats if f.lower() in low})
    return list(found) or [c for c in columns if c in numeric]


def membership(sets: DataFrame) -> DataFrame:
    """Sorted set ids per feature."""
    return sets.select("set_id", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.array_join(F.array_sort(F.collect_set("set_id")), ";").alias("feature_set_ids"))


def group_of(name):
    """Group of a feature name: the first rule that fits."""
    return next((group for group, rule in GROUP_RULES if re.search(rule, name.lower())), "other")


def feature_group(name):
    """The same for a name given as a column."""
    out = F.lit("other")
    for group, rule in reversed(GROUP_RULES):
        out = F.when(F.lower(name).rlike(rule), group).otherwise(out)
    return out


def neutral_values(name):
    """(fill, sign): what a slot without posts is filled with, and the value that marks such a slot; None where there is none."""
    return next((fill, sign) for rule, fill, sign in NEUTRAL_RULES if re.search(rule, name.lower()))


def count_partner(name, columns):
    """The post count that tells whether a sentiment feature's slot was empty: its scorer's own before the common one."""
    if group_of(name) != "sentiment":
        return None
    own = [f"{m}_post_count" for m in SCORER_TAGS.values() if name.lower().startswith(f"{m}_")]
    return next((c for c in [*own, "post_count"] if c in columns), None)
