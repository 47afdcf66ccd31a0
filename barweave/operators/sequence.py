"""Ordered work inside a key without ever holding a whole key in one task.

A series is cut into calendar blocks. What a block needs from earlier blocks (how many rows came
before, a running total, the last value) is computed from one summary row per block, so a single key
with a third of all rows still spreads over as many tasks as it has blocks. The number of summary
rows per key is bounded by the calendar span, not by the row count.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import DAY_MICROS, micros

BLOCK_DAYS = 32
CHUNK_ROWS = 8192


def calendar_block(ts, days=BLOCK_DAYS) -> Column:
    m = micros(ts)
    width = F.lit(int(days * DAY_MICROS))
    return ((m - F.pmod(m, width)) / width).cast("long")


def _prior(keys, block="_block"):
    return W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)


def with_position(df: DataFrame, keys, order, block: Column = None, name="_pos") -> DataFrame:
    """Dense 0-based position of each row in its key.

    ``order`` is a total order within the key; ``block`` any expression that never decreases along it. The
    input is read twice, once for its keys and order alone, so a costly one is best stored first.
    """
    order = [order] if isinstance(order, (str, Column)) else list(order)
    block = calendar_block(order[0]) if block is None else block
    rows = df.withColumn("_block", block)
    before = (
        rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_prior(keys)), F.lit(0)))
        .drop("_n")
    )
    rn = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*order))
    return (
        rows.withColumn("_rn", rn)
        .join(before, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_rn") - 1)
        .drop("_before", "_rn", "_block")
    )


def sliding(df: DataFrame, keys, order, columns, before=1, after=0, block=None, chunk=CHUNK_ROWS) -> DataFrame:
    """Row-frame window columns over a key, evaluated on fixed-size chunks with an exact halo.

    ``columns`` maps a name to a function of the window spec; later entries may use earlier ones.
    ``before``/``after`` are how many neighbouring rows the whole set of columns can look at. A row is
    copied to a neighbouring chunk only when that chunk can see it, so copies are about
    (before + after) / chunk of the data.
    """
    if before + after >= chunk:
        chunk = 4 * (before + after)
    home = F.floor(F.col("_pos") / chunk)
    lo = F.greatest(F.floor((F.col("_pos") - after) / chunk), F.lit(0))
    hi = F.floor((F.col("_pos") + before) / chunk)
    out = (
        with_position(df, keys, order, block)
        .withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    )
    w = W.partitionBy(*keys, "_chunk").orderBy("_pos")
    for name, fn in columns.items():
        out = out.withColumn(name, fn(w))
    return out.where(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk", "_pos")


def running(df: DataFrame, keys, order, sums=None, maxes=None, block=None) -> DataFrame:
    """Running totals and running maxima from the first row of the key to the current one."""
    sums, maxes = dict(sums or {}), dict(maxes or {})
    order = [order] if isinstance(order, (str, Column)) else list(order)
    block = calendar_block(order[0]) if block is None else block
    rows = df.withColumn("_block", block)
    aggs = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    aggs += [F.max(c).alias(f"_m_{n}") for n, c in maxes.items()]
    carry = rows.groupBy(*keys, "_block").agg(*aggs)
    prior = _prior(keys)
    carry = carry.select(
        *keys, "_block",
        *[F.sum(f"_s_{n}").over(prior).alias(f"_cs_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(prior).alias(f"_cm_{n}") for n in maxes],
    )
    w = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({
        **{f"_is_{n}": F.sum(c).over(w) for n, c in sums.items()},
        **{f"_im_{n}": F.max(c).over(w) for n, c in maxes.items()},
    })
    rows = rows.join(carry, [*keys, "_block"])
    zero = F.lit(0)
    rows = rows.withColumns({
        **{n: F.when(F.col(f"_is_{n}").isNotNull() | F.col(f"_cs_{n}").isNotNull(),
                     F.coalesce(F.col(f"_is_{n}"), zero) + F.coalesce(F.col(f"_cs_{n}"), zero)) for n in sums},
        **{n: F.greatest(f"_im_{n}", f"_cm_{n}") for n in maxes},
    })
    extra = [f"_{p}_{n}" for n in sums for p in ("is", "cs")] + [f"_{p}_{n}" for n in maxes for p in ("im", "cm")]
    return rows.drop("_block", *extra)


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def _keep(df, keys, order, pick):
    """One row per key as a combinable aggregate: a million copies of one key meet as partial results."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
