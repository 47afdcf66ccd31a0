"""Training windows on the calendar: rolling sums, window metadata, folds and splits."""
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import DAY_MICROS, micros
from ..session import reuse
from .sequence import running, with_position

# Share and least number of timestamps before the first test, least training rows.
INIT_FRACTION, MIN_INIT, MIN_TRAIN = 0.5, 30, 20
VALIDATION_FRACTION = 0.2


def calendar_window(df: DataFrame, keys, ts, days, columns, stretch=4) -> DataFrame:
    """Aggregates over rows with t - days <= time < t, without a whole key in one task.

    Blocks are ``stretch`` windows wide; a row also goes to the next block when that one can see it, so
    about 1 + 1 / stretch copies are made. ``columns`` maps a name to a function of the window spec.
    """
    span = int(days * DAY_MICROS)
    width = F.lit(span * stretch)
    m = F.col("_m")
    home = F.floor(m / width)
    x = df.withColumn("_m", micros(ts)).withColumn("_home", home) \
        .withColumn("_b", F.explode(F.sequence(home, F.floor((m + span) / width))))
    w = W.partitionBy(*keys, "_b").orderBy("_m").rangeBetween(-span, -1)
    out = x.withColumns({n: fn(w) for n, fn in columns.items()})
    return out.where(F.col("_home") == F.col("_b")).drop("_m", "_home", "_b")


def _axis(df, ts="timestamp"):
    """The distinct timestamps with their 0-based position and total count."""
    ax = with_position(df.select(ts).distinct().withColumn("_all", F.lit(1)), ["_all"], ts, name="_i")
    n = df.agg(F.count_distinct(ts).alias("n")).scalar()
    return ax.withColumn("_n", n)


def first_test_index(n="_n", fraction=INIT_FRACTION, least=MIN_INIT):
    return F.greatest(F.floor(F.col(n) * fraction), F.lit(least))


def train_windows(df: DataFrame, ts="timestamp", mode="days", size=180) -> DataFrame:
    """For every timestamp its training window: count, first and last training time, start of validation.

    mode "expanding" takes everything before, "timestamps" the last ``size`` distinct timestamps, "days"
    the ``size`` calendar days before. The last fifth of the window, at least one timestamp and not all
    of it, is validation.
    """
    ax = reuse(_axis(df, ts))
    if mode == "expanding":
        win = ax.withColumn("_from", F.lit(0).cast("long"))
    elif mode == "timestamps":
        win = ax.withColumn("_from", F.greatest(F.col("_i") - size, F.lit(0)))
    else:
        n = calendar_window(ax, ["_all"], ts, size, {"_c": lambda w: F.count(F.lit(1)).over(w)})
        win = n.withColumn("_from", F.col("_i") - F.col("_c")).drop("_c")
    cnt = F.col("_i") - F.col("_from")
    n_val = F.least(F.greatest(F.bround(cnt * VALIDATION_FRACTION), F.lit(1)), cnt - 1)
    win = win.withColumns({"train_window_timestamps": cnt, "_last": F.col("_i") - 1,
                           "_val": F.when(cnt >= 2, F.col("_i") - n_val).cast("long")})
    at = ax.select(F.col("_i").alias("_j"), F.col(ts).alias("_t"))
    for pos, name in (("_from", "train_start_timestamp"), ("_last", "train_end_timestamp"), ("_val", "validation_start")):
        hit = at.withColumnsRenamed({"_j": pos, "_t": name})
        win = win.join(hit, pos, "left")
    some = F.col("train_window_timestamps") > 0
    return win.select(ts, F.col("_i").alias("test_index"), F.col("_n").alias("n_timestamps"), "train_window_timestamps",
                      F.when(some, F.col("train_start_timestamp")).alias("train_start_timestamp"),
                      F.when(some, F.col("train_end_timestamp")).alias("train_end_timestamp"), "validation_start")


def panel_rolling_probability(df: DataFrame, days=180, fraction=INIT_FRACTION, least=MIN_INIT,
                              min_train=MIN_TRAIN) -> DataFrame:
    """Naive reference: the ticker's mean target in the window before each time, else the pooled mean.

    Everything follows from sums per (ticker, time) and per time over the same calendar window.
    """
    rows = reuse(df.groupBy("ticker", "timestamp").agg(
        F.count("target").alias("_n"), F.sum("target").alias("_s"), F.max("target").alias("target")))
    own = calendar_window(rows, ["ticker"], "timestamp", days, {
        "_wn": lambda w: F.sum("_n").over(w), "_ws": lambda w: F.sum("_s").over(w)})
    per = rows.groupBy("timestamp").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).withColumn("_all", F.lit(1))
    pool = calendar_window(per, ["_all"], "timestamp", days, {
        "_pn": lambda w: F.sum("_n").over(w), "_ps": lambda w: F.sum("_s").over(w),
        "train_window_timestamps": lambda w: F.count(F.lit(1)).over(w),
        "train_start_timestamp": lambda w: F.min("timestamp").over(w),
        "train_end_timestamp": lambda w: F.max("timestamp").over(w)})
    ax = _axis(rows).where(F.col("_i") >= first_test_index(fraction=fraction, least=least)).select("timestamp")
    pool = pool.join(ax, "timestamp").where(F.col("_pn") >= min_train).drop("_n", "_s", "_all")
    j = own.where(F.col("target").isNotNull()).join(pool, "timestamp")
    p = F.coalesce(F.try_divide("_ws", "_wn"), F.try_divide("_ps", "_pn"))
    return j.select("timestamp", "ticker", "target", (p >= 0.5).cast("int").alias("prediction"), p.alias("probability"),
                    F.lit("ticker_rolling_probability_with_pooled_fallback").alias("benchmark_model"),
                    "train_window_timestamps", "train_start_timestamp", "train_end_timestamp")


def asset_rolling_probability(df: DataFrame, days=None, fraction=INIT_FRACTION, least=MIN_INIT) -> DataFrame:
    """Naive reference per asset, over the days before or everything before."""
    rows = df.select("ticker", "timestamp", "target", F.col("target").isNotNull().cast("int").alias("_n"))
    if days:
        w = calendar_window(rows, ["ticker"], "timestamp", days, {
            "_wn": lambda w: F.sum("_n").over(w), "_ws": lambda w: F.sum("target").over(w),
            "train_window_timestamps": lambda w: F.count(F.lit(1)).over(w)})
        w = with_position(w, ["ticker"], "timestamp", name="_i")
    else:
        r = running(rows, ["ticker"], "timestamp", sums={
            "_cn": F.col("_n"), "_cs": F.coalesce("target", F.lit(0)), "_i1": F.lit(1)})
        w = r.select("ticker", "timestamp", "target", (F.col("_cn") - F.col("_n")).alias("_wn"),
                     (F.col("_cs") - F.coalesce("target", F.lit(0))).alias("_ws"),
                     (F.col("_i1") - 1).alias("train_window_timestamps"), (F.col("_i1") - 1).alias("_i"))
    size = df.groupBy("ticker").agg(F.count_distinct("timestamp").alias("_total"))
    j = w.join(size, "ticker").where((F.col("_i") >= first_test_index("_total", fraction, least))
                                     & (F.col("_wn") >= least) & F.col("target").isNotNull())
    p = F.try_divide("_ws", "_wn")
    return j.select("timestamp", "ticker", "target", (p >= 0.5).cast("int").alias("prediction"), p.alias("probability"),
                    "train_window_timestamps")


def expanding_folds(df: DataFrame, keys, ts, n_folds) -> DataFrame:
    """Rows tagged (fold, role): fold i trains on the first i blocks and validates on the next one."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    x = with_position(df, keys, ts, name="_i").join(n, keys)
    size = F.floor(F.col("_n") / (n_folds + 1))
    b = F.floor(F.col("_i") / size)
    x = x.where(size >= 1).withColumn("_b", b).where(F.col("_b") <= n_folds)
    x = x.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("_b"), F.lit(1)), F.lit(n_folds))))
    return x.withColumn("role", F.when(F.col("_b") == F.col("fold"), "valid").otherwise("train")).drop("_i", "_n", "_b")


def window_contract(signals: DataFrame, bars_per_day) -> DataFrame:
    """Violations of a rolling run's window columns, one row per broken rule."""
    d, n, mode = F.col("rolling_window_days"), F.col("rolling_window_timestamps"), F.col("train_window_mode")
    both = d.isNotNull() & n.isNotNull()
    g = signals.agg(
        (F.count_distinct(mode) > 1).cast("int").alias("mode_not_constant"),
        ((F.count(d) > 0) & (F.count(d) < F.count(F.lit(1)))).cast("int").alias("days_partly_null"),
        ((F.count(n) > 0) & (F.count(n) < F.count(F.lit(1)))).cast("int").alias("timestamps_partly_null"),
        F.count_if(d <= 0).alias("days_not_positive"), F.count_if(n <= 0).alias("timestamps_not_positive"),
        (F.count_distinct(d) > 1).cast("int").alias("days_not_constant"),
        (F.count_distinct(n) > 1).cast("int").alias("timestamps_not_constant"),
        F.count_if(both & (n != F.floor(d * bars_per_day))).alias("timestamps_not_days_times_bars"),
        ((F.count(d) == 0) & (F.count(n) == 0)).cast("int").alias("no_window_given"))
    rows = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n_violations")) for c in g.columns])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def stamp_window(signals: DataFrame, days, bars_per_day) -> DataFrame:
    """The window configuration on every row; the timestamp count follows from the days."""
    return signals.withColumns({
        "train_window_mode": F.lit("rolling_fixed"), "rolling_window_days": F.lit(float(days)),
        "rolling_window_timestamps": F.lit(int(days * bars_per_day))})


def test_after_train(df: DataFrame) -> DataFrame:
    """Rows whose training window does not end before the test time."""
    return df.where(~(F.col("train_end_timestamp") < F.col("timestamp")))
