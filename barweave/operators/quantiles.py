"""Exact ranks, terciles and percentiles for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here values first
collapse to (group, value, count), spread by value; only bucket totals, at most ``buckets`` rows per
group, are scanned in order, and a final look opens just the buckets that hold a wanted rank.
Bucket borders are approximate quantiles, so a heavy tail or an outlier does not crowd one bucket; borders only
route, results stay exact.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sequence import with_position

BUCKETS = 256  # a power of two
SKETCH = 10_000


def _borders(v, buckets) -> Column:
    """Approximate quantiles that cut the rows of a group into about equal parts; the sketch's size is bounded."""
    return F.percentile_approx(F.col(v), [i / buckets for i in range(1, buckets)], SKETCH)


def _bucket(v, borders, buckets) -> Column:
    """The number of borders below the value, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.element_at(borders, i + s) < F.col(v), i + s).otherwise(i))


def _grouped(df, keys):
    """Keys to group by; a constant stands in when there are none."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def value_histogram(df: DataFrame, keys, value, buckets=BUCKETS, weight=None) -> DataFrame:
    """(keys, v, cnt, n, _bucket): one row per distinct value, with the group size.

    ``weight`` names a column that says how many rows each input row stands for.
    """
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt"))
    )
    span = hist.groupBy(*keys).agg(_borders("v", buckets).alias("_cuts"), F.sum("cnt").alias("n"))
    return hist.join(span, list(keys)).withColumn("_bucket", _bucket("v", F.col("_cuts"), buckets)).drop("_cuts")


def _bucket_starts(hist, keys):
    prior = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return (
        hist.groupBy(*keys, "_bucket").agg(F.sum("cnt").alias("_size"), F.max("n").alias("n"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(prior), F.lit(0)))
    )


def percentiles(df: DataFrame, keys, value, qs, names=None, buckets=BUCKETS) -> DataFrame:
    """Linear-interpolated percentiles, one column per requested fraction."""
    names = names or [f"p{int(round(q * 100)):02d}" for q in qs]
    data, by = _grouped(df, keys)
    hist = value_histogram(data, by, value, buckets)
    starts = _bucket_starts(hist, by)
    # the 0-based rank below and above each fraction, as far as it falls into the bucket
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for i, q in enumerate(qs)]))
    picks = (
        starts.withColumn("_w", wanted)
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_w.at"), F.ceil("_w.at")))))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_size")))
        .select(*by, "_bucket", "_start", F.col("_w.i").alias("_i"), F.col("_w.at").alias("_at"), "_rank")
    )
    opened = picks.groupBy(*by, "_bucket").agg(
        F.max("_start").alias("_start"), F.collect_set(F.struct("_i", "_at", "_rank")).alias("_ranks"))
    inside = W.partitionBy(*by, "_bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    found = (
        hist.join(opened, [*by, "_bucket"])
        .withColumn("_end", F.col("_start") + F.sum("cnt").over(inside))
        .withColumn("_r", F.explode("_ranks"))
        .where((F.col("_r._rank") >= F.col("_end") - F.col("cnt")) & (F.col("_r._rank") < F.col("_end")))
        .groupBy(*by, F.col("_r._i").alias("_i"))
        .agg(F.min("v").alias("_a"), F.max("v").alias("_b"), F.max("_r._at").alias("_at"))
        .withColumn("_v", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at")))
    )
    out = found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)])
    return out if keys else out.drop("_all")


def average_ranks(df: DataFrame, keys, value, buckets=BUCKETS, weight=None) -> DataFrame:
    """(keys, v, rank): the average 1-based rank of every distinct value."""
    hist = value_histogram(df, keys, value, buckets, weight)
    starts = _bucket_starts(hist, keys).select(*keys, "_bucket", "_start")
    inside = W.partitionBy(*keys, "_bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return (
        hist.withColumn("_in", F.sum("cnt").over(inside))
        .join(starts, [*keys, "_bucket"])
        .select(*keys, "v", "cnt", "n",
                (F.col("_start") + F.col("_in") - (F.col("cnt") - 1) / 2.0).alias("rank"))
    )


def with_value_position(df: DataFrame, keys, value, tiebreak, name="_pos", buckets=BUCKETS) -> DataFrame:
    """Dense 0-based position by (value, tiebreak) within the key, and the key's size as ``_n``."""
    data, by = _grouped(df.where(F.col(value).isNotNull()), keys)
    span = data.groupBy(*by).agg(_borders(value, buckets).alias("_cuts"), F.count(value).alias("_n"))
    data = data.join(span, by).withColumn("_part", _bucket(value, F.col("_cuts"), buckets)).drop("_cuts")
    out = with_position(data, by, [F.col(value), *[F.col(t) for t in tiebreak]], block=F.col("_part"), name=name).drop("_part")
    return out if keys else out.drop("_all")


def tercile(pos, n, labels=("low", "mid", "high")) -> Column:
    """Terciles of ranks 1..n cut at linear quantiles: 25 members split 8/8/9."""
    k, n = F.col(pos), F.col(n)
    return F.when(3 * k < n - 1, labels[0]).when(3 * k < 2 * (n - 1), labels[1]).otherwise(labels[2])
