"""Many logistic fits at once, as sums over shards of rows.

A shard holds the rows of some tickers in one block of time, as arrays, with the limits that each training window sets for each ticker; it is written
once and never copied to windows. What travels is the small table of coefficients: a Newton step sends each window's
coefficients to the shards it overlaps, every shard clips its rows by the window's limits and adds up loss, gradient and Hessian of all its windows as
batched matrix products, Spark sums these by fit, and one small system per fit is solved. Fits that have converged retire; every step is a
stored table. No group holds a window, a series or the universe.

Means and deviations of a window are two passes of the same kind and travel with its coefficients, so nothing outside a window touches a fit.
"""
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse

NEAR, MOST_STEPS = 1e-7, 60  # relative gradient from which one more step is exact enough; steps before a fit is taken as it is
CELLS = 1_500_000  # numbers of a batch of windows in one shard
WIDE = 400  # sums that are aggregated as columns; wider ones as rows
SHARD = ["block", "bucket"]
WINDOW = "struct<win:long,mask:int,lo:long,hi:long,s0:long,s1:long,lims:array<double>>"


@dataclass
class Design:
    """What every task needs to know of the sets: columns by set, the columns a mask requires, clipped columns, tickers with an effect."""
    features: list
    sets: dict
    masks: list                # features that must be there, by mask
    mask_of: dict              # set -> mask
    clipped: list              # features with limits, the order of ``lims`` (lower ones first, then upper ones)
    effects: list = field(default_factory=list)

    def columns(self, set_id):
        return [self.features.index(f) for f in self.sets[set_id]]

    def width(self, set_id):
        return 1 + len(self.sets[set_id]) + len(self.effects)


def _list_matrix(lists, width):
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Shard:
    """The rows of one shard as matrices, and its windows."""

    def __init__(self, table, design):
        self.design, d = design, design
        rows = table.column("rows").combine_chunks()
        t, y, x = rows.flatten().flatten()
        self.t, self.y = t.to_numpy(), y.to_numpy(zero_copy_only=False)
        self.x = _list_matrix(x, len(d.features))
        sizes = [len(r) for r in rows]
        self.tickers = table.column("ticker").to_pylist()
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        some = np.isfinite(self.y)
        self.whole = [some & np.isfinite(self.x[:, [d.features.index(f) for f in m]]).all(axis=1) for m in d.masks]
        self.y = np.where(some, self.y, 0.0)
        wins = table.column("wins").combine_chunks()
        win, mask, lo, hi, s0, s1, lims = wins[0].values.flatten()
        self.win, self.mask, self.lo, self.hi, self.s0, self.s1 = (a.to_numpy() for a in (win, mask, lo, hi, s0, s1))
        self.at = {w: i for i, w in enumerate(self.win.tolist())}
        k = len(d.clipped)
        lims = np.stack([_list_matrix(w.values.flatten()[6], 2 * k) if k else np.zeros((len(win), 0)) for w in wins])
        self.low, self.high = np.where(np.isnan(lims[..., :k]), -np.inf, lims[..., :k]), np.where(np.isnan(lims[..., k:]), np.inf, lims[..., k:])
        self.clip = [d.features.index(f) for f in d.clipped]
        if d.effects:
            place = {e: i for i, e in enumerate(d.effects)}
            own = np.array([place.get(t, -1) for t in self.tickers])[self.owner]
            self.dummies = (own[:, None] == np.arange(len(d.effects))[None, :]).astype(float)

    def batches(self, windows):
        """Window indices in slices whose rows fit a batch."""
        step = max(1, CELLS // max(1, self.x.size))
        return [windows[i:i + step] for i in range(0, len(windows), step)]

    def values(self, windows):
        """Clipped entries, (windows, rows, features); 0 where there is none."""
        x = np.broadcast_to(self.x, (len(windows), *self.x.shape)).copy()
        if self.clip:
            low, high = self.low[:, windows][self.owner], self.high[:, windows][self.owner]
            x[:, :, self.clip] = np.clip(x[:, :, self.clip], low.transpose(1, 0, 2), high.transpose(1, 0, 2))
        return np.nan_to_num(x, copy=False)

    def trains(self, windows):
        m = (self.t >= self.lo[windows, None]) & (self.t < self.hi[windows, None])
        return m & np.array(self.whole)[self.mask[windows]]

    def scored(self, windows):
        m = (self.t >= self.s0[windows, None]) & (self.t <= self.s1[windows, None])
        return m & np.array(self.whole)[self.mask[windows]]

    def matrix(self, values, set_id, mean, scale):
        """Standardised, with a leading one and the ticker effects, (windows, rows, width)."""
        parts = [np.ones((*values.shape[:2], 1)), (values[:, :, self.design.columns(set_id)] - mean[:, None, :]) / scale[:, None, :]]
        if self.design.effects:
            parts.append(np.broadcast_to(self.dummies, (len(values), *self.dummies.shape)))
        return np.concatenate(parts, axis=2)

    def fits(self, table):
        """Per set and batch: rows of the table, window indices, the windows' matrices, coefficients."""
        order = {}
        for i, (s, w) in enumerate(zip(table.column("set_id").to_pylist(), table.column("win").to_pylist())):
            order.setdefault(self.at[w], []).append((s, i))
        columns = [table.column(c).combine_chunks() for c in ("raw", "mean", "scale")]
        for part in self.batches(np.array(sorted(order), np.int64)):
            if not len(part):
                continue
            values, by_set = self.values(part), {}
            for k, w in enumerate(part.tolist()):
                for s, i in order[w]:
                    by_set.setdefault(s, []).append((k, i))
            for s, pairs in by_set.items():
                k, i = (np.array(c) for c in zip(*pairs))
                k_set = len(self.design.sets[s])
                coefs, mean, scale = (_list_matrix(c.take(pa.array(i)), n) for c, n in zip(columns, (self.design.width(s), k_set, k_set)))
                yield i, part[k], self.matrix(values[k], s, mean, scale), coefs


def _lists(parts):
    """A column of lists from matrices whose rows they are."""
    sizes = np.concatenate([np.full(len(m), m.shape[1]) for m in parts]) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.zeros(0), *(np.ravel(m) for m in parts)])))


def _probability(x, coefs):
    m = np.clip(np.matmul(x, coefs[:, :, None])[:, :, 0], -500, 500)
    return m, 1 / (1 + np.exp(-m))


def window_sums(payload: DataFrame, design: Design) -> DataFrame:
    """Per window a list v: training rows, positives, scored rows, sums of the clipped features, rows per ticker with an effect."""
    def run(table):
        s, out = Shard(table, design), []
        for w in s.batches(np.arange(len(s.win))):
            m = s.trains(w).astype(float)
            n = [m.sum(axis=1)[:, None], (m @ s.y)[:, None], s.scored(w).sum(axis=1)[:, None], np.matmul(m[:, None, :], s.values(w))[:, 0]]
            out.append(np.hstack([*n, m @ s.dummies] if design.effects else n))
        return pa.table({"win": pa.array(s.win, pa.int64()), "v": _lists(out)})

    width = 3 + len(design.features) + len(design.effects)
    return sum_lists(payload.groupBy(*SHARD).applyInArrow(run, "win long, v array<double>"), ["win"], "v", width)


def window_moments(payload: DataFrame, windows: DataFrame, design: Design, sums: DataFrame) -> DataFrame:
    """(win, n, mean, scale, seen) of the windows in ``sums`` with rows of both classes; a constant feature has scale 1, so it is only centred."""
    k, n = len(design.features), F.col("v")[0]
    rows = reuse(sums.where((F.col("v")[1] > 0) & (F.col("v")[1] < n)).select(
        "win", n.alias("n"), F.transform(F.slice("v", 4, k), lambda s: s / n).alias("mean"), F.slice("v", 4 + k, max(1, len(design.effects))).alias("seen")))

    def run(left, right):
        if not len(left) or not len(right):
            return pa.table({"win": pa.array([], pa.int64()), "v": _lists([])})
        s, wins, out = Shard(left, design), right.column("win").to_pylist(), []
        mean, at = _list_matrix(right.column("mean").combine_chunks(), k), np.array([s.at[w] for w in wins])
        for part in s.batches(np.arange(len(wins))):
            off = (s.values(at[part]) - mean[part][:, None, :]) ** 2
            out.append(np.matmul(s.trains(at[part]).astype(float)[:, None, :], off)[:, 0])
        return pa.table({"win": pa.array(wins, pa.int64()), "v": _lists(out)})

    sent = rows.join(windows.select("win", F.explode("shards").alias("s")), "win").select("win", "mean", "s.block", "s.bucket")
    squares = sum_lists(payload.groupBy(*SHARD).cogroup(sent.groupBy(*SHARD)).applyInArrow(run, "win long, v array<double>"), ["win"], "v", k)
    spread = F.zip_with("v", "mean", lambda q, m: F.when(F.sqrt(q / F.col("n")) > 1e-12 * F.abs(m), F.sqrt(q / F.col("n"))).otherwise(1.0))
    return reuse(rows.join(squares, "win").select("win", "n", "mean", spread.alias("scale"), "seen"))


def sum_lists(df: DataFrame, keys, col, width) -> DataFrame:
    """Sums of equally placed entries of lists; shorter lists give shorter sums."""
    if width <= WIDE:
        sums = F.array(*[F.sum(F.get(col, F.lit(i))) for i in range(width)])
        return df.groupBy(*keys).agg(F.max(F.size(col)).alias("_n"), sums.alias(col)).withColumn(col, F.slice(col, 1, F.col("_n"))).drop("_n")
    long = df.select(*keys, F.posexplode(col).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias(col)).withColumn(col, F.transform(col, lambda s: s["_v"]))


def _derivatives(design):
    def run(left, right):
        if not len(left) or not len(right):
            return pa.table({"fit": pa.array([], pa.int64()), "v": _lists([])})
        shard, ids, out = Shard(left, design), [], []
        fit = right.column("fit").to_numpy()
        for i, w, x, coefs in shard.fits(right):
            m, p = _probability(x, coefs)
            train = shard.trains(w)
            loss = ((np.logaddexp(0.0, m) - shard.y * m) * train).sum(axis=1)
            g = np.matmul(((p - shard.y) * train)[:, None, :], x)[:, 0]
            h = np.matmul((x * (p * (1 - p) * train)[:, :, None]).transpose(0, 2, 1), x)
            rows, cols = np.triu_indices(x.shape[2])
            ids.append(fit[i])
            out.append(np.hstack([loss[:, None], g, h[:, rows, cols]]))
        return pa.table({"fit": pa.array(np.concatenate(ids)), "v": _lists(out)})
    return run


STATE = ("fit long, set_id string, win long, c double, n double, mean array<double>, scale array<double>, seen array<double>, raw array<double>, "
         "w array<double>, f double, step array<double>, t double, slope double, grad double, steps int, done int")


def _advance(trial, f, t, slope, c, n, seen, v, effects):
    """One decision of each fit of a width: take the trial point and make the next step from there, or halve the step.

    Gives whether the trial was taken, its value, the step from it, the slope along that, the largest gradient entry, and whether that is near.
    """
    d = trial.shape[1]
    ridge = np.r_[0.0, np.ones(d - 1)]
    value = 0.5 * (ridge * trial * trial).sum(axis=1) + c * v[:, 0]
    taken = np.isnan(f) | (t <= 1e-8) | (value <= f - 1e-4 * t * slope)
    rows, cols = np.triu_indices(d)
    h = np.zeros((len(trial), d, d))
    h[:, rows, cols] = h[:, cols, rows] = v[:, 1 + d:] * c[:, None]
    h += np.diag(ridge + 1e-12)
    g = ridge * trial + c[:, None] * v[:, 1:1 + d]
    if effects:  # the first ticker and those that the window does not hold are the reference
        off = (seen <= 0) | (np.cumsum(seen > 0, axis=1) == 1)
        i, j = np.nonzero(off)
        j += d - effects
        h[i, j], h[i, :, j], g[i, j] = 0.0, 0.0, 0.0
        h[i, j, j] = 1.0
    bad = ~np.isfinite(h).all(axis=(1, 2))
    h[bad] = np.eye(d)
    step = np.linalg.solve(h, g[:, :, None])[:, :, 0]
    step[bad] = np.nan
    most = np.abs(g).max(axis=1)
    return taken, value, step, (g * step).sum(axis=1), most, (most < NEAR * np.maximum(1.0, c * n)) | ~np.isfinite(step).all(axis=1)


def _stepped(design):
    names = [f.split()[0] for f in STATE.split(", ")]
    lists = ("raw", "w", "step")

    def run(batches):
        for b in batches:
            widths = np.diff(b.column("raw").offsets.to_numpy())
            for d in np.unique(widths).tolist():
                part = b.take(pa.array(np.flatnonzero(widths == d)))
                one = {k: part.column(k).to_numpy(zero_copy_only=False) for k in ("f", "t", "slope", "c", "n", "grad", "steps")}
                trial, v = _list_matrix(part.column("raw"), d), _list_matrix(part.column("v"), 1 + d + d * (d + 1) // 2)
                seen = _list_matrix(part.column("seen"), len(design.effects)) if design.effects else None
                taken, value, step, slope, most, near = _advance(trial, one["f"], one["t"], one["slope"], one["c"], one["n"], seen, v, len(design.effects))
                w = trial
                if not taken.all():  # their last point and step stand, and the step is halved
                    back = np.flatnonzero(~taken)
                    old = part.take(pa.array(back))
                    w = trial.copy()
                    w[back], step[back] = _list_matrix(old.column("w"), d), _list_matrix(old.column("step"), d)
                t = np.where(taken, 1.0, one["t"] / 2)
                steps = one["steps"] + 1
                new = {"w": _lists([w]), "step": _lists([step]), "raw": _lists([w - t[:, None] * step]), "t": pa.array(t), "f": pa.array(np.where(taken, value, one["f"])),
                       "slope": pa.array(np.where(taken, slope, one["slope"])), "grad": pa.array(np.where(taken, most, one["grad"])), "steps": pa.array(steps.astype(np.int32)),
                       "done": pa.array(((taken & near) | (steps >= MOST_STEPS)).astype(np.int32))}
                yield pa.RecordBatch.from_arrays([new[k].cast(b.schema.field(k).type) if k in lists else new.get(k, part.column(k)) for k in names], names=names)
    return run


def to_shards(fits: DataFrame, windows: DataFrame) -> DataFrame:
    """Each fit's coefficients at every shard that its window overlaps."""
    columns = ["fit", "set_id", "win", "raw", "mean", "scale"]
    return fits.select(*columns).join(windows.select("win", F.explode("shards").alias("s")), "win").select(*columns, "s.block", "s.bucket")


def problems(moments: DataFrame, design: Design, strengths: DataFrame) -> DataFrame:
    """The first state of each fit: ``strengths`` (set_id, win, c) with the window's moments of the set's columns, from coefficients of 0."""
    pick = F.lit(None)
    for s in design.sets:
        pick = F.when(F.col("set_id") == s, F.array(*[F.lit(i) for i in design.columns(s)])).otherwise(pick)
    at, none = strengths.join(moments, "win").withColumn("cols", pick), F.lit(None)

    def chosen(name):
        return F.transform("cols", lambda i: F.get(name, i)).alias(name)

    zeros = F.array_repeat(F.lit(0.0), F.size("cols") + 1 + len(design.effects))
    return at.select(
        F.monotonically_increasing_id().alias("fit"), "set_id", "win", "c", "n", chosen("mean"), chosen("scale"),
        "seen", zeros.alias("raw"), none.cast("array<double>").alias("w"), none.cast("double").alias("f"), none.cast("array<double>").alias("step"), F.lit(1.0).alias("t"),
        F.lit(0.0).alias("slope"), none.cast("double").alias("grad"), F.lit(0).alias("steps"), F.lit(0).alias("done"))


def solve(payload: DataFrame, windows: DataFrame, design: Design, start: DataFrame) -> DataFrame:
    """Newton steps for all fits until each has converged. Gives the states; ``raw`` holds the coefficients, ``grad`` the last gradient's largest entry."""
    d = max((design.width(s) for s in design.sets), default=1)
    state, finished = reuse(start), None
    for _ in range(2 * MOST_STEPS):
        if state.isEmpty():
            break
        sent = to_shards(state, windows)
        parts = payload.groupBy(*SHARD).cogroup(sent.groupBy(*SHARD)).applyInArrow(_derivatives(design), "fit long, v array<double>")
        sums = sum_lists(parts, ["fit"], "v", 1 + d + d * (d + 1) // 2)
        now = reuse(state.join(sums, "fit").select(*[f.split()[0] for f in STATE.split(", ")], "v").mapInArrow(_stepped(design), STATE))
        out = now.where("done = 1")
        finished = out if finished is None else finished.unionByName(out)
        state = now.where("done = 0")
    return finished if finished is not None else state


def _scores(design):
    def run(left, right):
        if not len(left) or not len(right):
            return pa.table({"fit": pa.array([], pa.int64()), "v": _lists([])})
        shard, ids, out = Shard(left, design), [], []
        fit = right.column("fit").to_numpy()
        for i, w, x, coefs in shard.fits(right):
            _, p = _probability(x, coefs)
            m, y = shard.scored(w), shard.y
            q = np.clip(p, 1e-15, 1 - 1e-15)
            terms = -(y * np.log(q) + (1 - y) * np.log(1 - q)), (q - y) ** 2, -((p >= 0.5) == (y == 1)).astype(float), np.ones_like(p)
            ids.append(fit[i])
            out.append(np.stack([np.where(m, v, 0.0).sum(axis=1) for v in terms], axis=1))
        return pa.table({"fit": pa.array(np.concatenate(ids)), "v": _lists(out)})
    return run


def score_sums(payload, windows, design, fits) -> DataFrame:
    """Per fit the sums of log loss, Brier score and minus the hits over the scored rows of its window, and their number."""
    parts = payload.groupBy(*SHARD).cogroup(to_shards(fits, windows).groupBy(*SHARD)).applyInArrow(_scores(design), "fit long, v array<double>")
    return sum_lists(parts, ["fit"], "v", 4)


def _predictions(design):
    names = ("fit", "ticker", "t", "target", "probability")

    def run(left, right):
        cols = [[] for _ in names]
        if len(left) and len(right):
            shard, fit = Shard(left, design), right.column("fit").to_numpy()
            tickers = np.array(shard.tickers, dtype=object)[shard.owner]
            for i, w, x, coefs in shard.fits(right):
                _, p = _probability(x, coefs)
                at, row = np.nonzero(shard.scored(w))
                for col, v in zip(cols, (fit[i][at], tickers[row], shard.t[row], shard.y[row].astype(np.int64), p[at, row])):
                    col.append(v)
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64()
        return pa.table({n: pa.array(np.concatenate(c) if c else [], k) for n, c, k in zip(names, cols, kinds)})
    return run


def predictions(payload, windows, design, fits) -> DataFrame:
    """(fit, ticker, t, target, probability) of the scored rows of each fit's window."""
    scored = windows.select("win", F.filter("shards", lambda s: (s["block"] >= F.col("first_scored")) & (s["block"] <= F.col("last_scored"))).alias("shards"))
    return payload.groupBy(*SHARD).cogroup(to_shards(fits, scored).groupBy(*SHARD)).applyInArrow(
        _predictions(design), "fit long, ticker string, t long, target int, probability double")
