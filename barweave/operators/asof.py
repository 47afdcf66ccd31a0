"""Backward as-of join."""
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import DAY_MICROS, micros
from .sequence import BLOCK_DAYS


def asof_join(left: DataFrame, right: DataFrame, by, left_on, right_on, values, strict=True,
              tie=None, block_days=BLOCK_DAYS, left_times: DataFrame = None) -> DataFrame:
    """Attach to each left row the last right row of the same key with right_on < left_on.

    ``strict=False`` also accepts equality. Unmatched left rows stay, with nulls. Both sides are
    stacked and cut into (key, calendar block) groups; each block starts with the last right row of
    the blocks before it, so neither a range join nor a whole key in one task is needed. ``tie``
    orders right rows that share a time.

    The (key, time) pairs of the left side are read once more to list its blocks; ``left_times`` names a
    cheaper table that has them, for a left side that is costly to compute.
    """
    by = [by] if isinstance(by, str) else list(by)
    width = F.lit(int(block_days * DAY_MICROS))
    block = ((F.col("_t") - F.pmod(F.col("_t"), width)) / width).cast("long")
    rest = [c for c in left.columns if c not in by]
    payload = F.struct(*[F.col(v) for v in values])
    rank = F.col(tie).cast("string") if tie else F.lit(None).cast("string")
    left_side, right_side = (0, 1) if strict else (1, 0)

    l_rows = left.select(
        *by, micros(left_on).alias("_t"), F.lit(left_side).alias("_side"), F.lit(None).cast("string").alias("_tie"),
        F.struct(*[F.col(c) for c in rest]).alias("_left")).withColumn("_block", block)
    r_rows = right.where(F.col(right_on).isNotNull()).select(
        *by, micros(right_on).alias("_t"), F.lit(right_side).alias("_side"), rank.alias("_tie"),
        payload.alias("_right")).withColumn("_block", block)

    times = l_rows if left_times is None else left_times.select(*by, micros(left_on).alias("_t")).withColumn("_block", block)
    blocks = times.select(*by, "_block").distinct().join(
        r_rows.groupBy(*by, "_block").agg(
            F.max_by("_right", F.struct("_t", "_tie")).alias("_last")), [*by, "_block"], "full")
    prior = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("_right", F.last("_last", ignorenulls=True).over(prior))
        .where(F.col("_right").isNotNull())
        .select(*by, (F.col("_block") * width).alias("_t"), F.lit(-1).alias("_side"),
                F.lit(None).cast("string").alias("_tie"), "_right", "_block")
    )
    stacked = l_rows.unionByName(r_rows, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # a carried row opens its block: it stands at the block's first instant with the lowest side
    w = W.partitionBy(*by, "_block").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    seen = stacked.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    return seen.select(
        *by, *[F.col(f"_left.{c}").alias(c) for c in rest],
        *[F.col(f"_hit.{v}").alias(v) for v in values]).select(*left.columns, *values)
