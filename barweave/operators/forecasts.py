"""Walk-forward logistic forecasts: windows, limits and shards of rows for the summed fits of ``fits``."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.identity import HPO_FALLBACKS, HPO_OK
from ..functions.times import DAY_MICROS, micros
from ..session import reuse
from .fits import WINDOW, Design, predictions, problems, score_sums, solve, window_moments, window_sums
from .preprocessing import WINSOR_FEATURES, WINSOR_MIN, WINSOR_Q
from .ranges import range_quantiles
from .sequence import sliding, with_position
from .windows import INIT_FRACTION, MIN_INIT, MIN_TRAIN, first_test_index, train_windows

# Search grid, default strength, and limits of the inner split.
C_GRID = (0.01, 0.1, 1.0, 10.0)
DEFAULT_C = 1.0
MIN_INNER, MIN_VALIDATION = 60, 20
OBJECTIVES = {"log_loss": 0, "brier_score": 1, "accuracy": 2}  # place in the sums of scores; accuracy counts hits below zero

SHARD_TICKERS = 64
OUT = ("set_id string, timestamp timestamp_ntz, ticker string, target int, prediction int, probability double, "
       "best_C double, hpo_score double, hpo_status string, train_window_timestamps long, "
       "train_start_timestamp timestamp_ntz, train_end_timestamp timestamp_ntz")


def _finite(c):
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))


def _design(df, sets, fixed_effects=False):
    """The sets, and which features have gaps."""
    features = sorted({f for fs in sets.values() for f in fs})
    got = df.agg(*[F.count_if(~_finite(f)) for f in features]).first()
    gaps = {f for f, n in zip(features, got) if n}
    masks = sorted({tuple(f for f in features if f in gaps and f in fs) for fs in sets.values()})
    of = {s: masks.index(tuple(f for f in features if f in gaps and f in fs)) for s, fs in sets.items()}
    names = [r["ticker"] for r in df.select("ticker").distinct().orderBy("ticker").collect()] if fixed_effects else []
    return Design(features, dict(sets), [list(m) for m in masks], of, [f for f in features if f in WINSOR_FEATURES], names)


def _rows(df, design):
    """(ticker, timestamp, t, y, x, has): entries as doubles, NaN where there is none; ``has`` lists the masks whose features are there."""
    number = lambda c: F.coalesce(F.when(_finite(c), F.col(c).cast("double")), F.lit(float("nan")))
    there = [F.lit(True) if not m else _all([_finite(f) for f in m]) for m in design.masks]
    has = F.filter(F.array(*[F.when(c & _finite("target"), F.lit(i)) for i, c in enumerate(there)]), lambda i: i.isNotNull())
    return df.select("ticker", "timestamp", micros("timestamp").alias("t"), number("target").alias("y"), F.array(*[number(f) for f in design.features]).alias("x"), has.alias("has"))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _limits(rows, windows, design, pooled):
    """(win, ticker, own) and (win, pool): lists of lower limits, then upper ones, of the clipped features; NaN where a feature has too few values.

    ``windows``: win, mask, lo, hi, and the ticker where each has windows of its own.
    """
    if not design.clipped:
        return None, None
    at = F.array(*[F.struct(F.lit(k).alias("f"), F.get("x", F.lit(design.features.index(f))).alias("v")) for k, f in enumerate(design.clipped)])
    long = reuse(rows.select("ticker", "t", F.explode("has").alias("mask"), "x").select("ticker", "t", "mask", F.explode(at).alias("p"))
                 .select("ticker", "mask", F.col("p.f").alias("f"), "t", F.col("p.v").alias("v")).where(~F.isnan("v")))
    f = F.explode(F.sequence(F.lit(0), F.lit(len(design.clipped) - 1))).alias("f")
    asked = windows.select("win", "mask", "lo", "hi", *(["ticker"] if not pooled else []))
    if pooled:
        asked = asked.join(long.select("mask", "ticker").distinct(), "mask")

    def lists(found, keys):
        pick = lambda i, j: F.max(F.when((F.col("f") == i) & (F.col("n") >= WINSOR_MIN), F.col("q")[j]))
        both = [F.coalesce(pick(i, j), F.lit(float("nan"))) for j in (0, 1) for i in range(len(design.clipped))]
        return found.groupBy(*keys).agg(F.array(*both).alias("lims"))

    own = lists(range_quantiles(long, asked.select("*", f), ["mask", "ticker", "f"], WINSOR_Q), ["win", "ticker"])
    if not pooled:
        return own, None
    return own, lists(range_quantiles(long, windows.select("win", "mask", "lo", "hi", f), ["mask", "f"], WINSOR_Q), ["win"])


def _payload(rows, windows, own, pool, design):
    """One row per (shard, ticker): its rows, and the windows that overlap the shard with their limits for the ticker."""
    packed = rows.groupBy("block", "bucket", "ticker").agg(F.array_sort(F.collect_list(F.struct("t", "y", "x"))).alias("rows"))
    no = F.array_repeat(F.lit(float("nan")), 2 * len(design.clipped))
    seen = windows.select("win", "mask", "lo", "hi", "s0", "s1", F.explode("shards").alias("s")).select("win", "mask", "lo", "hi", "s0", "s1", "s.block", "s.bucket")
    at = seen.join(packed.select("block", "bucket", "ticker"), ["block", "bucket"])
    if own is not None:
        at = at.join(own.withColumnRenamed("lims", "own"), ["win", "ticker"], "left")
        at = at.join(pool.withColumnRenamed("lims", "pool"), "win", "left") if pool is not None else at.withColumn("pool", F.lit(None).cast("array<double>"))
        pick = F.zip_with(F.coalesce("own", no), F.coalesce("pool", no), lambda a, b: F.when(F.isnan(a), b).otherwise(a))
    else:
        pick = no
    wins = at.select("block", "bucket", "ticker", F.struct("win", F.col("mask").cast("int").alias("mask"), "lo", "hi", "s0", "s1", pick.alias("lims")).cast(WINDOW).alias("w"))
    wins = wins.groupBy("block", "bucket", "ticker").agg(F.array_sort(F.collect_list("w")).alias("wins"))
    return reuse(packed.join(wins, ["block", "bucket", "ticker"]))


def _by_mask(windows, design):
    return windows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(len(design.masks) - 1))))


def _with_c(windows, design, c=None):
    """(set_id, win, c) of all sets for their mask's windows."""
    sets = F.array(*[F.struct(F.lit(s).alias("set_id"), F.lit(m).alias("m")) for s, m in design.mask_of.items()])
    out = windows.select("win", "mask", F.explode(sets).alias("s")).where("mask = s.m").select(F.col("s.set_id").alias("set_id"), "win")
    return out if c is None else out.withColumn("c", F.explode(F.array(*map(F.lit, map(float, c)))))


def _fitted(rows, windows, design, pooled, least, strengths, score=1):
    """(states, payload, moments) of the fits of ``strengths``; windows need ``least`` complete rows, and ``score`` scored ones."""
    own, pool = _limits(rows, windows, design, pooled)
    payload = _payload(rows, windows, own, pool, design)
    v = F.col("v")
    moments = window_moments(payload, windows, design, window_sums(payload, design).where((v[0] >= least) & (v[2] >= score)))
    return solve(payload, windows, design, problems(moments, design, strengths)), payload, moments


def _forecasts(rows, windows, design, pooled, min_train, chosen):
    """Forecasts of all windows with the strengths, scores and statuses of ``chosen`` (set_id, win, c, hpo_score, hpo_status)."""
    fits, payload, _ = _fitted(rows, windows, design, pooled, min_train, chosen.select("set_id", "win", "c"))
    lost = F.exists("raw", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    chosen = chosen.join(fits.select("set_id", "win", lost.alias("lost")), ["set_id", "win"], "left")
    fits = fits.where(~lost)
    out = predictions(payload, windows, design, fits)
    out = out.join(fits.select("fit", "set_id", "win"), "fit").join(chosen.where(~F.coalesce("lost", F.lit(False))).drop("lost"), ["set_id", "win"])
    meta = windows.select("win", "train_window_timestamps", "train_start_timestamp", "train_end_timestamp")
    at = F.timestamp_micros("t").cast("timestamp_ntz")
    return out.join(meta, "win").select(
        "set_id", at.alias("timestamp"), "ticker", F.col("target").cast("int").alias("target"), (F.col("probability") >= 0.5).cast("int").alias("prediction"), "probability",
        F.col("c").alias("best_C"), "hpo_score", "hpo_status", "train_window_timestamps", "train_start_timestamp", "train_end_timestamp")


def _tuned(rows, inner, design, pooled, grid, objective):
    """(set_id, win, c, hpo_score, hpo_status): the strength whose inner fit scores best on the validation rows; the first of equals."""
    every = _with_c(inner, design)
    order = {float(c): i for i, c in enumerate(grid)}
    fits, payload, tried = _fitted(rows, inner, design, pooled, MIN_INNER, _with_c(inner, design, grid), MIN_VALIDATION)
    fits = reuse(fits.where(~F.exists("raw", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).select("fit", "set_id", "win", "c", "raw", "mean", "scale"))
    sums = score_sums(payload, inner, design, fits)
    place = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    scored = fits.join(sums, "fit").select("set_id", "win", "c", (F.col("v")[OBJECTIVES[objective]] / F.col("v")[3]).alias("s"), F.element_at(place, F.col("c")).alias("i"))
    best = scored.where(~F.isnan("s")).groupBy("set_id", "win").agg(F.min(F.struct("s", "i", "c")).alias("best"))
    out = every.join(best, ["set_id", "win"], "left").join(tried.select("win", F.lit(True).alias("tried")), "win", "left")
    score = F.col("best.s") * (-1 if objective == "accuracy" else 1)
    status = F.when(F.col("best").isNotNull(), HPO_OK).when(F.col("tried"), HPO_FALLBACKS[1]).otherwise(HPO_FALLBACKS[0])
    return reuse(out.select("set_id", "win", F.coalesce("best.c", F.lit(DEFAULT_C)).alias("c"), score.alias("hpo_score"), status.alias("hpo_status")))


def _panel_windows(df, rows, design, days, tests, fraction, least, block, buckets):
    """Windows of every test time and mask; with the time at which validation starts among the mask's complete rows."""
    span = int(days * DAY_MICROS)
    w = train_windows(df.select("timestamp"), "timestamp", "days", days).where(
        (F.col("test_index") >= F.greatest(F.floor(F.col("n_timestamps") * fraction), F.lit(least))) & (F.col("train_window_timestamps") > 0))
    w = w if tests is None else w.where(tests)
    m, parts = micros("timestamp"), F.sequence(F.lit(0), F.lit(buckets - 1))
    blocks = F.sequence(F.floor((m - span) / block), F.floor(m / block))
    shards = F.flatten(F.transform(blocks, lambda b: F.transform(parts, lambda p: F.struct(b.alias("block"), p.cast("string").alias("bucket")))))
    w = _by_mask(w.drop("validation_start"), design).select(
        F.col("timestamp").alias("at"), "mask", (m - span).alias("lo"), m.alias("hi"), m.alias("s0"), m.alias("s1"), F.floor(m / block).alias("first_scored"),
        F.floor(m / block).alias("last_scored"), shards.alias("shards"), "train_window_timestamps", "train_start_timestamp", "train_end_timestamp")
    return reuse(w.withColumn("win", F.monotonically_increasing_id()))


def _inner_windows(rows, windows, design, days, block):
    """The windows cut where their validation part begins; windows that have none are left out."""
    cut = None
    for i in range(len(design.masks)):
        own = train_windows(rows.where(F.array_contains("has", i)).select("timestamp"), "timestamp", "days", days)
        own = own.select(F.col("timestamp").alias("at"), F.lit(i).alias("mask"), micros("validation_start").alias("cut")).where("cut is not null")
        cut = own if cut is None else cut.unionByName(own)
    at = windows.join(cut, ["at", "mask"])
    return reuse(at.withColumns({"s0": F.col("cut"), "s1": F.col("hi") - 1}).withColumns({
        "hi": F.col("cut"), "first_scored": F.floor(F.col("cut") / block), "last_scored": F.floor(F.col("s1") / block)}).drop("cut"))


def _chosen(rows, windows, inner, design, pooled, c, grid, objective):
    """Strength, score and status of every set and window."""
    if not grid:
        return _with_c(windows, design, [c]).withColumns({"hpo_score": F.lit(None).cast("double"), "hpo_status": F.lit("fixed")})
    found = _tuned(rows, inner(), design, pooled, grid, objective)
    default = _with_c(windows, design, [DEFAULT_C]).join(found, ["set_id", "win"], "left_anti").withColumns({
        "hpo_score": F.lit(None).cast("double"), "hpo_status": F.lit(HPO_FALLBACKS[0])})
    return found.unionByName(default)


def panel_walk_forward(df: DataFrame, sets, days=180, chunk_days=60, c=DEFAULT_C, grid=None, objective="log_loss",
                       fixed_effects=False, fraction=INIT_FRACTION, least=MIN_INIT, min_train=MIN_TRAIN, tests=None) -> DataFrame:
    """Rolling-window panel logit: one fit per test time and feature set.

    ``sets`` maps a set id to its feature columns. Rows lie in shards of ``chunk_days`` and at most about ``SHARD_TICKERS`` tickers; all fits advance
    together as sums over the shards (``fits``). With a ``grid`` each fit's strength is the best on the last fifth of its window. ``tests`` is a
    condition on ``timestamp`` that limits the test times, not the training rows. ``fixed_effects`` add a column per ticker, so the
    systems that are solved then have the universe's size.
    """
    design, block = _design(df, sets, fixed_effects), int(chunk_days * DAY_MICROS)
    buckets = max(1, -(-df.select("ticker").distinct().count() // SHARD_TICKERS))
    rows = reuse(_rows(df, design).withColumns({"block": F.floor(F.col("t") / block), "bucket": F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("string")}))
    windows = _panel_windows(df, rows, design, days, tests, fraction, least, block, buckets)
    chosen = _chosen(rows, windows, lambda: _inner_windows(rows, windows, design, days, block), design, True, c, grid, objective)
    return _forecasts(rows, windows, design, True, min_train, chosen)


def asset_walk_forward(df: DataFrame, sets, chunk=250, c=DEFAULT_C, grid=None, objective="log_loss",
                       fraction=INIT_FRACTION, least=MIN_INIT, min_train=MIN_TRAIN) -> DataFrame:
    """Expanding-window logit per asset. A shard holds ``chunk`` rows of one asset and never travels to later windows; their coefficients come to it."""
    design = _design(df, sets)
    n = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_first"))
    rows = reuse(with_position(_rows(df, design), ["ticker"], "timestamp", name="_i").withColumns({"block": F.floor(F.col("_i") / chunk), "bucket": F.col("ticker")}))
    at = sliding(rows.select("ticker", "timestamp", "t", "_i"), ["ticker"], "timestamp", {"prev": lambda w: F.lag("timestamp").over(w)}, before=1)
    w = _by_mask(at.join(n, "ticker").where((F.col("_i") >= first_test_index("_n", fraction, least)) & (F.col("_i") > 0)), design)
    home = F.floor(F.col("_i") / chunk)
    shards = F.transform(F.sequence(F.lit(0).cast("long"), home), lambda b: F.struct(b.alias("block"), F.col("ticker").alias("bucket")))
    windows = reuse(w.select(
        F.col("timestamp").alias("at"), "ticker", "mask", micros("_first").alias("lo"), F.col("t").alias("hi"), F.col("t").alias("s0"), F.col("t").alias("s1"),
        home.alias("first_scored"), home.alias("last_scored"), shards.alias("shards"), F.col("_i").alias("train_window_timestamps"),
        F.col("_first").alias("train_start_timestamp"), F.col("prev").alias("train_end_timestamp")).withColumn("win", F.monotonically_increasing_id()))

    def inner():
        """The last fifth of the complete rows, counted in rows."""
        done = None
        for i in range(len(design.masks)):
            mine = with_position(rows.where(F.array_contains("has", i)).select("ticker", "timestamp", "t", "block"), ["ticker"], "timestamp", name="_k")
            k = mine.select(F.col("ticker"), F.col("timestamp").alias("at"), F.lit(i).alias("mask"), "_k").where("_k >= 2")
            cut = F.col("_k") - F.least(F.greatest(F.bround(F.col("_k") * 0.2), F.lit(1)), F.col("_k") - 1)
            k = k.withColumn("_c", cut.cast("long")).join(mine.select("ticker", F.col("_k").alias("_c"), F.col("t").alias("cut"), F.col("block").alias("cut_block")), ["ticker", "_c"])
            done = k if done is None else done.unionByName(k)
        j = windows.join(done.select("ticker", "at", "mask", "cut", "cut_block"), ["ticker", "at", "mask"])
        return reuse(j.withColumns({"s0": F.col("cut"), "s1": F.col("hi") - 1}).withColumns({"hi": F.col("cut"), "first_scored": F.col("cut_block")}).drop("cut", "cut_block"))

    chosen = _chosen(rows, windows, inner, design, False, c, grid, objective)
    return _forecasts(rows, windows, design, False, min_train, chosen)


def stamp_universe(signals: DataFrame, requested: DataFrame, available: DataFrame) -> DataFrame:
    """Digest and size of the requested, available and realised universes on every row."""
    from ..functions.identity import universe_digest
    out = signals
    for name, src in (("requested", requested), ("available", available), ("realized", signals)):
        one = src.agg(universe_digest(F.col("ticker")).alias("h"), F.count_distinct(F.upper(F.trim("ticker"))).alias("n"))
        out = out.withColumns({f"{name}_coin_universe_hash": one.select("h").scalar(),
                               f"n_{name}_tickers": one.select("n").scalar()})
    return out.withColumn("coin_universe_hash", F.col("requested_coin_universe_hash"))


def score_with(df: DataFrame, text, load, labels=("positive", "negative", "neutral")) -> DataFrame:
    """Score texts with a user's model: ``load()`` runs once per task and returns texts -> probabilities.

    Adds label (the most probable), score P(positive) - P(negative) and the three probabilities;
    unusable texts get nulls.
    """
    from ..functions.text import EMPTY_TEXTS
    short = ("prob_pos", "prob_neg", "prob_neu")
    schema = StructType(list(df.schema.fields)).add("sentiment", "string").add("score", "double")
    for s in short:
        schema = schema.add(s, "double")

    def run(batches):
        model = load()
        for pdf in batches:
            t = pdf[text].fillna("").astype(str)
            ok = ~t.str.strip().str.lower().isin(EMPTY_TEXTS)
            p = np.full((len(pdf), 3), np.nan)
            if ok.any():
                p[ok.to_numpy()] = np.asarray(model(t[ok].tolist()), dtype=float)
            o = pdf.copy()
            o["sentiment"] = [labels[i] if g else None for i, g in zip(np.nan_to_num(p).argmax(axis=1), ok)]
            o["score"] = [a - b if g else None for a, b, g in zip(p[:, 0], p[:, 1], ok)]
            for j, s in enumerate(short):
                o[s] = [v if g else None for v, g in zip(p[:, j], ok)]
            yield o

    return df.mapInPandas(run, schema)
