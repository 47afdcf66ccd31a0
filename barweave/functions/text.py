"""Text cleaning and lexicon scoring. Every step reads the whole text."""
import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .times import col

# Bodies that carry no text.
EMPTY_TEXTS = ["", "[removed]", "[deleted]", "nan", "none"]

# Patterns removed or unwrapped by the cleaner, in order.
CLEAN_STEPS = [
    (r"(?i)https?://[^\s]+|(?i)www\.[^\s]+", ""),
    (r"(?U)/?u/\w+", ""),
    (r"(?U)/?r/\w+", ""),
    (r"(?s)```.*?```", ""),
    (r"`([^`]*)`", "$1"),
    (r"\[([^\]]*)\]\([^\)]*\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(\*{1,3}|_{1,3})(.*?)\1", "$2"),
    (r"~~(.*?)~~", "$1"),
    (r"(?m)^>\s?", ""),
    (r"(?U)\s+", " "),
]

# Label cut-offs, normalisation constant and context weights of the lexicon scorer.
POSITIVE_FROM, NEGATIVE_TO = 0.05, -0.05
NORM_ALPHA = 15.0
NEGATION_FACTOR = -0.74
BOOST = 0.293
NEGATIONS = ["not", "no", "never", "none", "without", "nor", "cannot"]
BOOSTERS = ["very", "really", "extremely", "so", "most"]


def usable_text(c) -> Column:
    s = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return ~s.isin(EMPTY_TEXTS)


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else x)


def unescape(c) -> Column:
    """HTML entities to characters. Only texts with an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(col(c).contains("&"), col(c))), col(c))


def clean_text(c, decode=True) -> Column:
    """Strip links, handles and markdown; collapse whitespace. Null and blank texts are returned as is."""
    x = unescape(c) if decode else col(c)
    for pattern, to in CLEAN_STEPS:
        x = F.regexp_replace(x, pattern, to)
    return F.when(col(c).isNull() | (F.trim(col(c)) == ""), col(c)).otherwise(F.trim(x))


def cleaning_report(df: DataFrame, columns) -> DataFrame:
    """Mean length before and after cleaning, one row per text column, in one pass."""
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.length(c).alias("a"), F.length(clean_text(c)).alias("b"))
        for c in columns])).alias("x")).select("x.*")
    g = rows.groupBy("field").agg(F.avg("a").alias("mean_length_before"), F.avg("b").alias("mean_length_after"))
    return g.withColumn("reduction_pct", F.try_divide(
        (F.col("mean_length_before") - F.col("mean_length_after")) * 100.0, F.col("mean_length_before")))


def label_from_score(c) -> Column:
    s = col(c)
    return F.when(s >= POSITIVE_FROM, "positive").when(s <= NEGATIVE_TO, "negative") \
        .when(s.isNotNull(), "neutral")


def tokens(c) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{M}\p{N}']+"), lambda t: t != "")


def lexicon_scores(df: DataFrame, key, text, lexicon: DataFrame) -> DataFrame:
    """Score texts against a (token, valence) table: compound, pos/neg/neu shares and label.

    Every token takes its context (negation within the three words before it, booster right before
    it) along as three aligned arrays, so no per-text window is needed. The text is read once; sums per text
    combine map-side. Whether the lexicon is broadcast is left to its size.
    """
    t = df.select(key, tokens(text).alias("_t"))
    n_tok = F.size("_t")

    def shifted(k):
        """The token k places before, aligned with each token."""
        pad = F.array_repeat(F.lit(None).cast("string"), F.least(F.lit(k), n_tok))
        return F.concat(pad, F.slice("_t", F.lit(1), F.greatest(n_tok - k, F.lit(0))))

    z = F.arrays_zip(F.col("_t").alias("token"), shifted(1).alias("p1"), shifted(2).alias("p2"), shifted(3).alias("p3"))
    x = t.select(key, F.coalesce(n_tok, F.lit(0)).alias("n_tokens"), F.explode_outer(z).alias("z")) \
        .select(key, "n_tokens", "z.*").toDF(key, "n_tokens", "token", "p1", "p2", "p3")
    near = [F.coalesce(F.col(p).isin(NEGATIONS), F.lit(False)) for p in ("p1", "p2", "p3")]
    x = x.select(key, "n_tokens", "token", (near[0] | near[1] | near[2]).alias("negated"),
                 F.coalesce(F.col("p1").isin(BOOSTERS), F.lit(False)).alias("boosted"))
    x = x.join(lexicon.select("token", F.col("valence").cast("double").alias("valence")), "token", "left")
    v = F.col("valence") + F.when(F.col("boosted"), BOOST * F.signum("valence")).otherwise(0.0)
    v = F.when(F.col("negated"), v * NEGATION_FACTOR).otherwise(v)
    g = x.withColumn("v", v).groupBy(key).agg(
        F.max("n_tokens").alias("n_tokens"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"),
        F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("p"),
        F.sum(F.when(F.col("v") < 0, F.col("v") - 1).otherwise(0.0)).alias("n"), F.count_if(F.col("v") != 0).alias("h"))
    s, p, n = F.col("s"), F.col("p"), F.col("n")
    neutral = F.col("n_tokens") - F.col("h")
    total = p + F.abs(n) + neutral
    known = F.col("n_tokens") > 0
    out = g.select(
        key, F.when(known, F.round(s / F.sqrt(s * s + NORM_ALPHA), 4)).alias("score"),
        F.when(known, F.round(p / total, 3)).alias("prob_pos"), F.when(known, F.round(F.abs(n) / total, 3)).alias("prob_neg"),
        F.when(known, F.round(neutral / total, 3)).alias("prob_neu"))
    return out.withColumn("sentiment", label_from_score("score"))
