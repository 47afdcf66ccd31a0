"""Time axis helpers. All event times are zone-less UTC timestamps (timestamp_ntz)."""
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bar widths and the number of bars per day.
BAR_SECONDS = {"15min": 900, "1h": 3600, "6h": 21600, "1d": 86400}
BARS_PER_DAY = {"15min": 96, "1h": 24, "6h": 4, "1d": 1}
DAY_MICROS = 86_400_000_000

# A median magnitude above the bound means this epoch unit; below all of them, seconds.
EPOCH_UNITS = [("ns", 1e17), ("us", 1e14), ("ms", 1e11)]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc(c) -> Column:
    return col(c).cast("timestamp").cast("timestamp_ntz")


def micros(c) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c) -> Column:
    return F.timestamp_micros(col(c)).cast("timestamp_ntz")


def bar_floor(c, horizon) -> Column:
    """Start of the epoch-aligned bar that holds the time."""
    m = micros(c)
    return from_micros(m - F.pmod(m, F.lit(BAR_SECONDS[horizon] * 1_000_000)))


def bar_micros(horizon) -> Column:
    """Bar width in microseconds, for a horizon given as text or as a column."""
    if isinstance(horizon, str) and horizon in BAR_SECONDS:
        return F.lit(BAR_SECONDS[horizon] * 1_000_000)
    h = col(horizon)
    out = F.lit(None).cast("long")
    for name, sec in BAR_SECONDS.items():
        out = F.when(h == name, F.lit(sec * 1_000_000)).otherwise(out)
    return out


def forecast_origin(ts="timestamp", horizon="horizon") -> Column:
    """A bar labelled t is known at t + h."""
    return from_micros(micros(ts) + bar_micros(horizon))


def in_forecast_sample(start, end_exclusive, origin="forecast_origin") -> Column:
    """start <= origin < end; compares the stored origin so the bound reaches the scan."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end_exclusive).cast("timestamp_ntz")
    return (col(origin) >= lo) & (col(origin) < hi)


def origin_mismatches(df: DataFrame, ts="timestamp", horizon="horizon", origin="forecast_origin") -> DataFrame:
    """Rows whose stored origin is not timestamp + h."""
    return df.where(~F.col(origin).eqNullSafe(forecast_origin(ts, horizon)))


def calendar_parts(df: DataFrame, ts="date") -> DataFrame:
    return df.withColumns({
        "date_only": F.to_date(ts),
        "hour": F.hour(ts),
        "weekday": F.date_format(ts, "EEEE"),
        "month": F.date_format(ts, "yyyy-MM"),
    })


def epoch_unit(df: DataFrame, value, by=()) -> DataFrame:
    """The epoch unit of a numeric time column, decided by the exact median magnitude: one row, or one per ``by`` group.

    Only counts and extremes around each bound are kept, so the state does not grow with the column:
    the median exceeds a bound when more than half of the values do, and on an even split when the
    mean of the two middle values does.
    """
    a = F.abs(col(value).cast("double"))
    aggs = [F.count(a).alias("n")]
    for u, t in EPOCH_UNITS:
        aggs += [
            F.count_if(a > t).alias(f"n_{u}"),
            F.max(F.when(a <= t, a)).alias(f"below_{u}"),
            F.min(F.when(a > t, a)).alias(f"above_{u}"),
        ]
    unit = F.lit("s")
    for u, t in reversed(EPOCH_UNITS):
        over = (2 * F.col(f"n_{u}") > F.col("n")) | (
            (F.col("n") > 0) & (2 * F.col(f"n_{u}") == F.col("n"))
            & ((F.col(f"below_{u}") + F.col(f"above_{u}")) / 2 > t))
        unit = F.when(over, F.lit(u)).otherwise(unit)
    return df.groupBy(*by).agg(*aggs).select(*by, unit.alias("unit"))


def normalise_times(df: DataFrame, column, out="timestamp", by=()) -> DataFrame:
    """Epoch numbers or ISO text to UTC; bad values become null.

    The unit of epoch numbers is inferred once for the column, or once for each group of ``by`` (file or series).
    """
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return df.withColumn(out, utc(column))
    if kind == "string":
        return df.withColumn(out, F.try_to_timestamp(F.col(column)).cast("timestamp_ntz"))
    if by:
        units = epoch_unit(df, column, by).withColumnsRenamed({c: f"_{c}_of_unit" for c in by})
        match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}_of_unit")) for c in by])
        df, unit = df.join(units, match, "left"), F.col("unit")
    else:
        units, unit = None, epoch_unit(df, column).scalar()
    v = F.col(column).cast("double")
    scale = F.when(unit == "ns", F.lit(1e-3)).when(unit == "us", F.lit(1.0)) \
        .when(unit == "ms", F.lit(1e3)).otherwise(F.lit(1e6))
    done = df.withColumn(out, from_micros(F.round(v * scale).cast("long")))
    return done.drop(*units.columns) if by else done
