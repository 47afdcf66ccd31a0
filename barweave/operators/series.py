"""Stationarity, persistence, long memory, breaks and fold stability of feature series.

Tests are solved from sums. A series is cut into chunks of rows with the few rows before them; a chunk gives cross products of its rows, and a
test's regressions, long-run variances and partial sums follow from the added products of the series. So no task reads a
whole series; what meets per series is one small table of products per chunk. Frequencies and break candidates are plain
aggregations over positions.
"""
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.numeric import clean, ratio, slope
from ..functions.tails import kolmogorov_p, normal_two_sided
from ..session import reuse
from .inference import ALPHA, benjamini_hochberg
from .sequence import running, sliding, with_position
from .windows import expanding_folds

# Least lengths, published 5 % critical values and response surfaces.
MIN_N = {"adf": 50, "kpss": 50, "dfgls": 50, "pp": 50, "ar1": 30, "gph": 200, "cips": 20, "ks_fold": 30}
ADF_SURFACE = {"c": (-2.86154, -2.8903, -4.234, -40.04), "ct": (-3.41049, -4.3904, -9.036, -45.374)}
KPSS_5 = {"c": 0.463, "ct": 0.146}
DFGLS_5 = {"c": [(math.inf, -1.95)], "ct": [(50, -3.19), (100, -3.03), (200, -2.93), (math.inf, -2.89)]}
CIPS_5 = {"c": -2.15, "ct": -2.66}
CIPS_CLIP = (-6.19, 2.61)
CIPS_LAGS = 4
CHUNK = 4096
SERIES = ["ticker", "feature"]


def centred(long: DataFrame) -> DataFrame:
    """Finite values of each series about their mean, numbered from 0: ticker, feature, timestamp, y, i, n, level, flat."""
    x = long.select(*SERIES, "timestamp", clean("v").alias("v")).where(F.col("v").isNotNull())
    stats = x.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("level"), (F.max("v") == F.min("v")).alias("flat"))
    return with_position(x, SERIES, "timestamp", name="i").join(stats, SERIES).withColumn("y", F.col("v") - F.col("level")).drop("v")


def _chunked(x, halo, chunk=CHUNK):
    """Rows with the chunk they belong to, copied to the next one where it looks back on them."""
    chunk = max(chunk, 2 * halo)
    return x.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("i") / chunk), F.floor((F.col("i") + halo) / chunk)))).where(
        F.col("chunk") * chunk < F.col("n")).withColumn("home", F.floor(F.col("i") / chunk) == F.col("chunk"))


def adf_lags(n):
    return int(4 * (n / 100.0) ** 0.25)


def pp_lags(n):
    return int(math.ceil(12 * (n / 100.0) ** 0.25))


def kpss_lags(n):
    """Lags that the automatic rule looks at; the bandwidth it then chooses can be anything up to n - 1."""
    return int(n ** (2 / 9))


def _products(i, y, home, n, p, top):
    """Products of one chunk.

    Rows z = (dy, y before, 1, t, dy lagged 1..p) give one matrix per number of usable lags; values and times give products per lag up to ``top``; and partial
    sums from the chunk's start give those of the partial sums. Times are centred, and scaled by n in z.
    """
    out = []
    tc = i + 1 - (n + 1) / 2
    at = np.flatnonzero(home & (i >= 1))
    usable = np.minimum(i[at] - 1, p)

    def before(k):
        return y[np.maximum(at - k, 0)]

    z = np.column_stack([y[at] - before(1), before(1), np.ones(len(at)), tc[at] / n, *[before(k) - before(k + 1) for k in range(1, p + 1)]])
    for g in np.unique(usable):
        zz = z[usable == g].copy()
        zz[:, 4 + g:] = 0.0
        out.append(("z", int(g), (zz.T @ zz).ravel()))
    own = np.flatnonzero(home)
    lags = np.zeros((top + 1, 3))
    for k in range(top + 1):
        r = own[i[own] >= k]
        lags[k] = y[r] @ y[r - k], y[r] @ tc[r - k] + tc[r] @ y[r - k], tc[r] @ tc[r - k]
    out.append(("lag", 0, lags.ravel()))
    part, q = np.cumsum(y[own]), (i[own] + 1.0) * (i[own] + 1 - n) / 2
    out.append(("part", 0, np.array([len(own), y[own].sum(), part.sum(), part @ part, part @ q, q.sum(), q @ q])))
    return out


def _fit(s, y, xs):
    """(coefficients, residual sum of squares, inverse of the normal matrix) of z[y] on z[xs] from the products s."""
    scale = np.sqrt(np.maximum(np.diag(s)[xs], 1e-300))
    inv = np.linalg.pinv(s[np.ix_(xs, xs)] / np.outer(scale, scale)) / np.outer(scale, scale)
    b = inv @ s[xs, y]
    return b, float(s[y, y] - b @ s[xs, y]), inv


def _adf(by_lag, top, det):
    """t of the level before, lag order by BIC on the common sample, refitted on all usable rows."""
    def rows(at_least):
        return sum(m for g, m in by_lag.items() if g >= at_least)

    def design(p):
        return [1, *range(4, 4 + p), *det]

    common, best, lag = rows(top), math.inf, 0
    n = common[2, 2]
    for p in range(top + 1):
        k = len(design(p))
        if n <= k:
            break
        rss = _fit(common, 0, design(p))[1]
        if rss <= 0:
            return math.nan
        bic = n * (math.log(2 * math.pi * rss / n) + 1) + math.log(n) * k
        if bic < best:
            best, lag = bic, p
    s = rows(lag)
    b, rss, inv = _fit(s, 0, design(lag))
    se = math.sqrt(max(rss / max(s[2, 2] - len(b), 1) * inv[0, 0], 0.0))
    return b[0] / se if se > 0 else math.nan


def _pp(by_lag, n, det):
    """Level-before t corrected for serial correlation by a Bartlett long-run variance."""
    s = sum(by_lag.values())
    d = len(s)
    m = n - 1
    # y = dy + y before, on (y before, deterministics): the coefficient of y before is one more than that of dy
    b, rss, inv = _fit(s, 0, [1, *det])
    rho = 1 + b[0]

    def residual(k):
        """The residual k rows earlier as a combination of z."""
        w = np.zeros(d)
        w[1] += 1 - rho
        w[4:3 + k] -= 1
        w[4:4 + k] += rho
        for c, j in zip(b[1:], det):
            w[j] -= c
            if j == 3:
                w[2] += c * k / n
        return w
    now = np.zeros(d)
    now[0] = 1
    now[1] = -b[0]
    for c, j in zip(b[1:], det):
        now[j] -= c
    lags = pp_lags(n)
    g0, lam = rss / m, rss / m
    for k in range(1, min(lags, m - 1) + 1):
        usable = sum(x for g, x in by_lag.items() if g >= k)
        lam += 2 * (1 - k / (lags + 1)) * float(now @ usable @ residual(k)) / m
    s2 = rss / max(m - len(b), 1)
    se = math.sqrt(max(s2 * inv[0, 0], 0.0))
    if lam <= 0 or se <= 0:
        return math.nan
    return math.sqrt(g0 / lam) * b[0] / se - 0.5 * (lam - g0) / math.sqrt(lam) * (m * se / math.sqrt(s2))


def _dfgls(by_lag, n, first, det):
    """ADF without deterministics on the GLS-detrended series; detrending is a linear map of the products."""
    s = sum(by_lag.values())
    d = len(s)
    a = 1 + (-7.0 if len(det) == 1 else -13.5) / n
    q = np.zeros((3, d))  # quasi-differences of y, constant and trend
    q[0, 0], q[0, 1], q[1, 2], q[2, 3], q[2, 2] = 1, 1 - a, 1 - a, 1 - a, a / n
    t0 = (1 - (n + 1) / 2) / n
    head = np.array([first, 1.0, t0])
    g = (q @ s @ q.T + np.outer(head, head))[:1 + len(det), :1 + len(det)]
    b = np.append(_fit(g, 0, list(range(1, 1 + len(det))))[0], 0.0)[:2]
    m = np.eye(d)
    m[0, 2] -= b[1] / n
    m[1, 2] -= b[0] - b[1] / n
    m[1, 3] -= b[1]
    m[4:, 2] -= b[1] / n
    return _adf({k: m @ x @ m.T for k, x in by_lag.items()}, adf_lags(n), [])


def _kpss(lags, parts, n, kind):
    """(scaled squares of the partial sums of the detrended series, its slope, the bandwidth of its long-run variance, the sum of the series)."""
    beta = 0.5 * lags[0, 1] / lags[0, 2] if kind == "ct" else 0.0
    auto = lags[:, 0] - beta * lags[:, 1] + beta ** 2 * lags[:, 2]
    s0, s1 = auto[0] / n, 0.0
    for k in range(1, kpss_lags(n) + 1):
        prod = auto[k] / (n / 2)
        s0 += prod
        s1 += k * prod
    width = int(min(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3), n - 1)) if s0 else 0
    eta, start = 0.0, 0.0
    for count, total, l, ll, lq, q, qq in parts:  # chunks in order, each from the sum before it
        eta += ll + 2 * start * l + count * start ** 2 - 2 * beta * (lq + start * q) + beta ** 2 * qq
        start += total
    return float(eta / n ** 2), float(beta), width, float(start)


def adf_critical(n, kind):
    a, b, c, d = ADF_SURFACE[kind]
    return a + b / n + c / n ** 2 + d / n ** 3


def dfgls_critical(n, kind):
    return next(v for top, v in DFGLS_5[kind] if n <= top)


def joint_class(a_c, a_ct, k_c, k_ct):
    """Column form of the joint reading of both tests under both trends."""
    known = a_c.isNotNull() & a_ct.isNotNull() & k_c.isNotNull() & k_ct.isNotNull()
    return F.when(~known, "n/a").when(a_c & ~k_c, "I(0)").when(a_ct & ~k_ct, "trend-stationary") \
        .when(~a_c & k_c, "I(1)").when(a_c & k_c, "conflicting").otherwise("inconclusive")


_TESTS = [f"{t}_{k}" for t in ("dfgls", "pp", "adf", "kpss") for k in ("c", "ct")]
_NAMES = ["n_obs", *[f"{t}_{s}" for t in _TESTS for s in ("stat", "reject")], "ar1_rho", "ar1_const"]
_TYPES = ["long", *["double", "boolean"] * len(_TESTS), "double", "double"]
# What the second pass of the KPSS test needs; its statistics come from there.
_KPSS = [f"_{v}_{k}" for k in KPSS_5 for v in ("eta", "beta", "width", "total")]
_KPSS_TYPES = ["double", "double", "long", "double"] * len(KPSS_5)


def _solve(n, flat, first, by_lag, lags, parts):
    """All statistics of a series from its products; of KPSS all but the long-run variance."""
    out = dict.fromkeys(_NAMES + _KPSS)
    out["n_obs"] = n
    if flat:
        return out
    for kind, det in (("c", [2]), ("ct", [2, 3])):
        jobs = {"adf": (lambda: _adf(by_lag, adf_lags(n), det), lambda s: s < adf_critical(n, kind)),
                "pp": (lambda: _pp(by_lag, n, det), lambda s: s < adf_critical(n, kind)),
                "dfgls": (lambda: _dfgls(by_lag, n, first, det), lambda s: s < dfgls_critical(n, kind))}
        for t, (stat, reject) in jobs.items():
            if n >= MIN_N[t]:
                s = stat()
                if math.isfinite(s):
                    out[f"{t}_{kind}_stat"], out[f"{t}_{kind}_reject"] = float(s), bool(reject(s))
        if n >= MIN_N["kpss"]:
            out |= zip([f"_{v}_{kind}" for v in ("eta", "beta", "width", "total")], _kpss(lags, parts, n, kind))
    if n >= MIN_N["ar1"]:
        b = _fit(sum(by_lag.values()), 0, [1, 2])[0]
        out["ar1_rho"], out["ar1_const"] = float(1 + b[0]), float(b[1])
    return out


def series_tests(long: DataFrame) -> DataFrame:
    """The whole battery per (ticker, feature) of a long table (ticker, timestamp, feature, v).

    Passes over chunks: one for the products that every test is solved from, one for the robust error of the AR(1) coefficient, which needs its
    residuals, and one for the long-run variances of the KPSS tests, which need their bandwidths. The chunk tables are written once, since the solutions are read several times.
    """
    x = reuse(centred(long))
    longest = x.agg(F.max("n")).first()[0] or 1
    halo = max(pp_lags(longest), adf_lags(longest), kpss_lags(longest)) + 1
    cols = "ticker string, feature string"

    def gather(key, pdf):
        pdf = pdf.sort_values("i")
        n = int(pdf["n"].iloc[0])
        i, y, home = pdf["i"].to_numpy(), pdf["y"].to_numpy(), pdf["home"].to_numpy(dtype=bool)
        first = float(y[0]) if i[0] == 0 else None
        rows = _products(i, y, home, n, max(pp_lags(n), adf_lags(n)), kpss_lags(n))
        return pd.DataFrame([(*key, n, bool(pdf["flat"].iloc[0]), first, kind, g, v.tolist()) for kind, g, v in rows],
                            columns=[*SERIES, "chunk", "n", "flat", "first", "kind", "g", "s"])

    products = reuse(_chunked(x, halo).select(*SERIES, "chunk", "i", "y", "n", "flat", "home").groupBy(*SERIES, "chunk").applyInPandas(
        gather, cols + ", chunk long, n long, flat boolean, first double, kind string, g long, s array<double>"))

    def solve(key, pdf):
        n = int(pdf["n"].iloc[0])
        z, lags, parts = {}, 0.0, []
        for r in pdf.sort_values("chunk").itertuples():
            v = np.asarray(r.s, dtype=float)
            if r.kind == "z":
                z[r.g] = z.get(r.g, 0.0) + v.reshape(math.isqrt(len(v)), -1)
            elif r.kind == "lag":
                lags = lags + v.reshape(-1, 3)
            else:
                parts.append(v)
        first = pdf["first"].dropna()
        o = _solve(n, bool(pdf["flat"].iloc[0]), float(first.iloc[0]), z, lags, parts)
        return pd.DataFrame([[*key, *[o[c] for c in _NAMES + _KPSS]]], columns=[*SERIES, *_NAMES, *_KPSS], dtype=object)

    # A group here holds n / CHUNK rows of products.
    solved = reuse(products.groupBy(*SERIES).applyInPandas(solve, cols + ", " + ", ".join(f"{n} {t}" for n, t in zip(_NAMES + _KPSS, _TYPES + _KPSS_TYPES))))
    out = solved.join(_ar1_errors(x, solved), SERIES, "left").join(_long_run(x, solved), SERIES, "left")
    for k, cut in KPSS_5.items():
        lr = F.col(f"_lr_{k}")
        out = out.withColumn(f"kpss_{k}_stat", F.when(lr > 0, F.col(f"_eta_{k}") / lr)).withColumn(f"kpss_{k}_reject", F.col(f"kpss_{k}_stat") > cut)
    out = out.drop(*_KPSS, *[f"_lr_{k}" for k in KPSS_5])
    rho = F.col("ar1_rho")
    out = out.withColumn("ar1_halflife", F.when((rho > 0) & (rho < 1), -math.log(2) / F.ln(rho))).drop("ar1_const")
    out = out.join(long_memory(long).drop("gph_n"), SERIES, "left")
    c = F.col
    out = out.withColumn("joint_class", joint_class(c("adf_c_reject"), c("adf_ct_reject"), c("kpss_c_reject"), c("kpss_ct_reject")))
    conflict = F.col("joint_class") == "conflicting"
    return out.withColumns({g: F.when(conflict, F.col(g)) for g in ("gph_d", "gph_se", "gph_pval_d0", "gph_m")})


def _long_run(x, solved):
    """Bartlett long-run variances of the detrended series for bandwidths of any length.

    (width + 1) times the weighted sum of all lag products is the sum of squares of all sums of width + 1 neighbours, the cut ones at both ends
    too. Such a sum is a difference of two running totals, so a chunk needs its rows and those width + 1 before them, not the rows between.
    """
    size = CHUNK
    known = solved.where("_eta_c is not null").select(*SERIES, *_KPSS)
    rows = running(x.select(*SERIES, "i", "y", "n"), SERIES, "i", sums={"total": F.col("y")}, block=F.floor(F.col("i") / size)).join(known, SERIES)
    seen = [F.floor((F.col("i") + k) / size) for k in (F.lit(0), *[F.col(f"_width_{k}") + 1 for k in KPSS_5])]
    rows = rows.drop("y").withColumn("chunk", F.explode(F.array_distinct(F.array(*seen))))

    def gather(key, pdf):
        pdf = pdf.sort_values("i")
        n, i, total = int(pdf["n"].iloc[0]), pdf["i"].to_numpy(), pdf["total"].to_numpy()
        out = []
        for k in KPSS_5:
            beta, width, end = float(pdf[f"_beta_{k}"].iloc[0]), int(pdf[f"_width_{k}"].iloc[0]), float(pdf[f"_total_{k}"].iloc[0])

            def upto(t):
                """The running total of the detrended series; 0 before it and its sum after it."""
                inside = (t >= 0) & (t < n)
                u = t[inside]
                p = np.where(t < 0, 0.0, end)
                p[inside] = total[np.searchsorted(i, u)] - beta * (u + 1.0) * (u + 1 - n) / 2
                return p
            t = np.arange(key[2] * size, min((key[2] + 1) * size, n + width + 1))
            d = upto(t) - upto(t - width - 1)
            out.append(float(d @ d) / (width + 1) / n)
        return pd.DataFrame([(*key, *out)], columns=[*SERIES, "chunk", *KPSS_5])

    return rows.groupBy(*SERIES, "chunk").applyInPandas(gather, "ticker string, feature string, chunk long, " + ", ".join(f"{k} double" for k in KPSS_5)).groupBy(
        *SERIES).agg(*[F.sum(k).alias(f"_lr_{k}") for k in KPSS_5])


def _ar1_errors(x, solved):
    """HAC standard error of the AR(1) coefficient: Bartlett sums of score products, lag by lag and chunk by chunk."""
    longest = x.agg(F.max("n")).first()[0] or 1
    halo = int(math.ceil(longest ** (1 / 3))) + 1
    rows = x.join(solved.where("ar1_rho is not null").select(*SERIES, "ar1_rho", "ar1_const"), SERIES)

    def gather(key, pdf):
        pdf = pdf.sort_values("i")
        n, rho, c = int(pdf["n"].iloc[0]), pdf["ar1_rho"].iloc[0], pdf["ar1_const"].iloc[0]
        i, y, home = pdf["i"].to_numpy(), pdf["y"].to_numpy(), pdf["home"].to_numpy(dtype=bool)
        prev = np.r_[np.nan, y[:-1]]
        u = y - c - rho * prev
        g = np.column_stack([u, prev * u])
        own = np.flatnonzero(home & (i >= 1))
        lags = int(math.ceil(n ** (1 / 3)))
        s = g[own].T @ g[own]
        for k in range(1, lags + 1):
            r = own[i[own] >= k + 1]
            w = g[r].T @ g[r - k]
            s = s + (1 - k / (lags + 1)) * (w + w.T)
        q = np.column_stack([np.ones(len(own)), prev[own]])
        return pd.DataFrame([(*key, *s.ravel(), *(q.T @ q).ravel())], columns=[*SERIES, "chunk", *"abcdefgh"])

    sums = (_chunked(rows, halo).groupBy(*SERIES, "chunk").applyInPandas(gather, "ticker string, feature string, chunk long, " + ", ".join(f"{k} double" for k in "abcdefgh"))
            .groupBy(*SERIES).agg(*[F.sum(k).alias(k) for k in "abcdefgh"]))
    # [inv(Q) S inv(Q)] of the slope, written out for two regressors
    det = F.col("e") * F.col("h") - F.col("f") * F.col("g")
    p, q = -F.col("f") / det, F.col("e") / det
    var = p * p * F.col("a") + p * q * (F.col("b") + F.col("c")) + q * q * F.col("d")
    return sums.select(*SERIES, F.sqrt(F.greatest(var, F.lit(0.0))).alias("ar1_se"))


def _waves(key, table):
    """Sums of y * cos and y * sin over one chunk of a series at its lowest sqrt(n) frequencies; angles from whole numbers of turns."""
    n, i, y = table.column("n")[0].as_py(), table.column("i").to_numpy().astype(np.int64), table.column("y").to_numpy()
    ks = np.arange(1, int(np.floor(np.sqrt(n))) + 1)
    sums = [(np.cos(a) @ y, np.sin(a) @ y) for part in np.array_split(ks, -(-len(ks) // 256)) for a in [2 * np.pi * ((part[:, None] * i) % n) / n]]
    columns = {"k": pa.array(ks), "n": pa.array(np.full(len(ks), n, np.int64)), "re": pa.array(np.concatenate([s[0] for s in sums])), "im": pa.array(np.concatenate([s[1] for s in sums]))}
    return pa.table({**{c: pa.array([v.as_py()] * len(ks), pa.string()) for c, v in zip(SERIES, key)}, **columns})


def long_memory(long: DataFrame) -> DataFrame:
    """Log-periodogram slope over the lowest sqrt(n) frequencies of every series of MIN_N values or more.

    Every chunk of a series gives one pair of sums per frequency, added up over the chunks: sqrt(n) * n / ``CHUNK`` rows for a series of n.
    """
    x = centred(long)
    size = x.groupBy(*SERIES).agg(F.first("n").alias("gph_n"))
    held = x.where((F.col("n") >= MIN_N["gph"]) & ~F.col("flat")).select(*SERIES, "n", "i", "y", F.floor(F.col("i") / CHUNK).alias("chunk"))
    sums = held.groupBy(*SERIES, "chunk").applyInArrow(lambda key, t: _waves(key[:len(SERIES)], t), ", ".join(f"{c} string" for c in SERIES) + ", k long, n long, re double, im double")
    per = sums.groupBy(*SERIES, "k", "n").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (2 * math.pi * F.col("n"))
    half = F.sin(math.pi * F.col("k") / F.col("n"))
    per = per.withColumns({"lp": F.when(power > 0, F.ln(power)), "lf": -F.ln(4 * half * half)})
    g = per.groupBy(*SERIES).agg(slope("lp", "lf").alias("gph_d"), F.count(F.lit(1)).alias("gph_m"), F.count("lp").alias("_used"))
    g = g.where("_used = gph_m").withColumn("gph_se", math.pi / F.sqrt(24.0 * F.col("gph_m")))
    g = g.withColumn("gph_pval_d0", normal_two_sided(F.col("gph_d") / F.col("gph_se")))
    return size.join(g, SERIES, "left").select(*SERIES, "gph_n", "gph_d", "gph_se", "gph_pval_d0", "gph_m")


def corrected(records: DataFrame, pvals, keys=tuple(SERIES), block="horizon", alpha=ALPHA) -> DataFrame:
    """Adds ``*_pval_bh`` and ``*_reject_bh`` to the records of many series: p-values corrected within (block, test).

    Where a block has fewer than two p-values of a test, both stay null. A block holds one row per series, so its ranking is small.
    """
    at = [block, *keys]
    tests = F.explode(F.array(*[F.struct(F.lit(p).alias("test"), F.col(p).alias("p")) for p in pvals])).alias("t")
    long = records.select(*at, tests).select(*at, "t.test", F.col("t.p").alias("p_value_raw"), F.concat_ws("|", block, "t.test").alias("family"), F.concat_ws("|", *keys).alias("test_id"))
    q = benjamini_hochberg(long, alpha=alpha).withColumn("_known", F.count("p_value_raw").over(W.partitionBy("family")))
    one = {p: F.max(F.when((F.col("test") == p) & (F.col("_known") >= 2), F.col("q_value_bh"))) for p in pvals}
    wide = q.groupBy(*at).agg(*[e.alias(f"{p}_bh") for p, e in one.items()])
    return records.join(wide.withColumns({p.replace("pval", "reject") + "_bh": F.col(f"{p}_bh") <= alpha for p in pvals}), at, "left")


def persistence(long: DataFrame) -> DataFrame:
    """AR(1) coefficient of every series as a regression slope on the row before it (built-in only)."""
    x = long.where(F.col("v").isNotNull()).select("ticker", "feature", "timestamp", "v")
    lag = sliding(x, ["ticker", "feature"], "timestamp", {"_l": lambda w: F.lag("v").over(w)}, before=1)
    g = lag.groupBy("ticker", "feature").agg(F.count(F.lit(1)).alias("ar1_n"), slope("v", "_l").alias("ar1_rho"))
    rho = F.col("ar1_rho")
    return g.withColumn("ar1_halflife", F.when((rho > 0) & (rho < 1), -math.log(2) / F.ln(rho)))


def cips(long: DataFrame, kind="c") -> DataFrame:
    """Panel unit-root test: cross-sectionally augmented regressions per ticker, truncated and averaged.

    The cross-section mean is an aggregate per (feature, time). A row counts where its ticker has the values of the times right before it; the
    regressions are solved from sums of products.
    """
    x = long.where(F.col("v").isNotNull()).select("feature", "ticker", "timestamp", "v")
    bar = x.groupBy("feature", "timestamp").agg(F.avg("v").alias("bar"))
    axis = with_position(bar, ["feature"], "timestamp", name="_i")
    size = axis.groupBy("feature").agg(F.count(F.lit(1)).alias("n_obs"))
    p = CIPS_LAGS
    lags = {"_before": lambda w: F.lag("_i", p + 1).over(w), "_bar1": lambda w: F.lag("bar", 1).over(w)}
    lags |= {f"_v{k}": (lambda w, k=k: F.lag("v", k).over(w)) for k in range(1, p + 2)}
    j = sliding(x.join(axis, ["feature", "timestamp"]), ["feature", "ticker"], "timestamp", lags, before=p + 1)
    whole = F.col("_i") - F.col("_before") == p + 1
    z = [F.col("v") - F.col("_v1"), F.lit(1.0), F.col("_v1"), F.col("_bar1"), F.col("bar") - F.col("_bar1"),
         *[F.col(f"_v{k}") - F.col(f"_v{k + 1}") for k in range(1, p + 1)], *([F.col("_i").cast("double")] if kind == "ct" else [])]
    names = [f"z{k}" for k in range(len(z))]
    pairs = [(a, b) for a in range(len(z)) for b in range(a, len(z))]
    sums = j.withColumns(dict(zip(names, z))).groupBy("feature", "ticker").agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(whole, F.col(names[a]) * F.col(names[b]))).alias(f"s{a}_{b}") for a, b in pairs])
    d = len(z)

    @F.pandas_udf(DoubleType())
    def t_stat(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            m = np.zeros((d, d))
            for (a, b), q in zip(pairs, v):
                m[a, b] = m[b, a] = q
            b, rss, inv = _fit(m, 0, list(range(1, d)))
            se = math.sqrt(max(rss / max(m[1, 1] - len(b), 1) * inv[1, 1], 0.0))
            out.append(b[1] / se if se > 0 else None)
        return pd.Series(out, dtype="float64")

    enough = sums.where((F.col("rows") >= MIN_N["cips"] + p + 2) & (F.col("s1_1") >= 20))
    t = enough.select("feature", "ticker", t_stat(F.array(*[f"s{a}_{b}" for a, b in pairs])).alias("t"))
    clipped = F.greatest(F.least("t", F.lit(CIPS_CLIP[1])), F.lit(CIPS_CLIP[0]))
    g = t.where(F.col("t").isNotNull()).groupBy("feature").agg(F.avg(clipped).alias("cips_stat"), F.count(F.lit(1)).alias("n_sections"))
    return g.where(F.col("n_sections") >= 4).join(size, "feature").withColumns({
        "trend": F.lit(kind), "cips_5pct_cv": F.lit(CIPS_5[kind]), "cips_reject": F.col("cips_stat") < CIPS_5[kind]})


def _bessel_quarter(q):
    """K_{1/4}(q) scaled by exp(q), by its integral."""
    t = np.linspace(0, 12, 4001)
    return np.trapezoid(np.exp(-q * (np.cosh(t) - 1)) * np.cosh(t / 4), t)


def cvm_tail(stat, nx, ny):
    """Asymptotic two-sample Cramer-von Mises tail."""
    n, k = nx + ny, nx * ny
    et = (1 + 1 / n) / 6
    vt = (n + 1) * (4 * k * n - 3 * (nx * nx + ny * ny) - 2 * k) / (45 * n * n * 4 * k)
    x = 1 / 6 + (stat - et) / math.sqrt(45 * vt)
    if x < 0.003:
        return 1.0
    cdf = 0.0
    for j in range(20):
        y = 4 * j + 1
        q = y * y / (16 * x)
        u = math.exp(math.lgamma(j + 0.5) - math.lgamma(j + 1)) / (math.pi ** 1.5 * math.sqrt(x))
        term = u * math.sqrt(y) * math.exp(-2 * q) * _bessel_quarter(q) if q < 350 else 0.0
        cdf += term
        if abs(term) < 1e-12:
            break
    return min(max(1.0 - cdf, 0.0), 1.0)


@F.pandas_udf(DoubleType())
def cvm_p(s: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
    return pd.Series([cvm_tail(a, float(b), float(c)) for a, b, c in zip(s, nx, ny)], dtype="float64")


def fold_stability(long: DataFrame, n_folds=5) -> DataFrame:
    """KS and Cramer-von Mises between each expanding training part and the block after it.

    Both follow from merged ranks: windows over (series, fold), which the calendar bounds.
    """
    keys = ["ticker", "feature"]
    x = long.where(F.col("v").isNotNull()).select(*keys, "timestamp", "v")
    f = expanding_folds(x, keys, "timestamp", n_folds)
    w = W.partitionBy(*keys, "fold")
    upto = w.orderBy("v").rangeBetween(W.unboundedPreceding, 0)
    tr, va = (F.col("role") == "train").cast("int"), (F.col("role") == "valid").cast("int")
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, "fold", "v"))
    y = f.withColumns({
        "_nx": F.sum(tr).over(w), "_ny": F.sum(va).over(w), "_cx": F.sum(tr).over(upto), "_cy": F.sum(va).over(upto),
        "_r": F.count(F.lit(1)).over(upto) - (ties - 1) / 2.0,
        "_j": F.row_number().over(W.partitionBy(*keys, "fold", "role").orderBy("v", "timestamp"))})
    d = F.abs(F.col("_cx") / F.col("_nx") - F.col("_cy") / F.col("_ny"))
    sq = (F.col("_r") - F.col("_j")) * (F.col("_r") - F.col("_j"))
    g = y.groupBy(*keys, "fold").agg(
        F.max("_nx").alias("n_train"), F.max("_ny").alias("n_val"), F.max(d).alias("ks_stat"),
        (F.max("_nx") * F.sum(F.when(F.col("role") == "train", sq).otherwise(0.0))
         + F.max("_ny") * F.sum(F.when(F.col("role") == "valid", sq).otherwise(0.0))).alias("_u"))
    g = g.where((F.col("n_val") >= MIN_N["ks_fold"]) & (F.col("n_train") >= MIN_N["ks_fold"]))
    nx, ny = F.col("n_train").cast("double"), F.col("n_val").cast("double")
    n = nx + ny
    return g.withColumn("cvm_stat", F.col("_u") / (nx * ny * n) - (4 * nx * ny - 1) / (6 * n)).withColumns({
        "ks_pval": kolmogorov_p(F.sqrt(ratio(nx * ny, n)) * F.col("ks_stat")), "cvm_pval": cvm_p("cvm_stat", nx, ny)}).drop("_u")


# ---- structural breaks ---------------------------------------------------------------------------

def structural_breaks(long: DataFrame, max_breaks=5, min_frac=0.15, fixed=None) -> DataFrame:
    """Breaks in the mean per (ticker, feature): greedy binary segmentation, their number by BIC or fixed.

    Every row is a candidate. From prefix sums its gain in the segment it lies in is known, so a step is one aggregation that keeps the best candidate of
    each series, and the breaks found so far travel back as a short array. The prefix sums are written once for the steps.
    """
    x = centred(long).withColumns({"y1": F.col("y"), "y2": F.col("y") * F.col("y")})
    run = running(x, SERIES, "i", sums={"c1": F.col("y1"), "c2": F.col("y2")}, block=F.floor(F.col("i") / CHUNK))
    run = reuse(run.select(*SERIES, "timestamp", "i", "n", (F.col("c1") - F.col("y1")).alias("s1"), (F.col("c2") - F.col("y2")).alias("s2"), "c1", "c2"))
    point = F.struct(F.col("i").cast("long").alias("i"), "s1", "s2", "timestamp")
    end = F.struct(F.col("n").cast("long").alias("i"), F.col("c1").alias("s1"), F.col("c2").alias("s2"), "timestamp")
    state = run.groupBy(*SERIES, "n").agg(F.max(F.when(F.col("i") == F.col("n") - 1, end)).alias("stop"))
    least = F.greatest(F.lit(10), F.bround(F.col("n") * min_frac, 0)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"), F.col("stop.timestamp").alias("timestamp"))
    state = state.withColumns({"least": least, "start": start, "found": F.slice(F.array("stop"), 1, 0)})
    rows = run.select(*SERIES, "timestamp", "i", "s1", "s2")

    def cost(a, b):
        d = b["s1"] - a["s1"]
        return b["s2"] - a["s2"] - d * d / (b["i"] - a["i"])

    for _ in range(max_breaks if fixed is None else fixed):
        state = reuse(state)
        cuts = F.concat(F.array("start"), F.col("found"), F.array("stop"))
        j = rows.join(state.where((F.col("n") >= 30) & (F.col("least") * 2 <= F.col("n"))).withColumn("cuts", cuts), SERIES)
        a = F.array_max(F.filter("cuts", lambda c: c["i"] <= F.col("i")))
        b = F.array_min(F.filter("cuts", lambda c: c["i"] > F.col("i")))
        j = j.withColumns({"a": a, "b": b}).where((F.col("i") >= F.col("a.i") + F.col("least")) & (F.col("i") <= F.col("b.i") - F.col("least")))
        gain = cost(F.col("a"), F.col("b")) - cost(F.col("a"), point) - cost(point, F.col("b"))
        best = j.groupBy(*SERIES).agg(F.max_by(point, F.struct(gain.alias("g"), (-F.col("i")).alias("k"))).alias("next"))
        state = state.join(best, SERIES, "left").withColumn(
            "found", F.when(F.col("next").isNotNull(), F.concat("found", F.array("next"))).otherwise(F.col("found"))).drop("next")

    def bic(k):
        cuts = F.array_sort(F.concat(F.array("start"), F.slice("found", F.lit(1), k), F.array("stop")))
        rss = F.aggregate(F.sequence(F.lit(1), k + 1), F.lit(0.0), lambda s, q: s + cost(F.element_at(cuts, q), F.element_at(cuts, q + 1)))
        n = F.col("n").cast("double")
        return F.when(rss > 0, n * F.ln(rss / n) + (k + 1) * F.ln(n)).otherwise(F.lit(float("inf")))

    tried = F.sequence(F.lit(0), F.size("found")) if fixed is None else F.array(F.size("found"))
    pick = F.array_min(F.transform(tried, lambda k: F.struct(bic(k).alias("b"), k.alias("k"))))
    fits = (F.col("n") >= 30) & (F.col("least") * 2 <= F.col("n"))
    out = state.withColumn("pick", pick).withColumn("kept", F.array_sort(F.slice("found", F.lit(1), F.coalesce("pick.k", F.lit(0)))))
    edges = F.concat(F.array("start"), F.col("kept"), F.array("stop"))
    out = out.withColumn("lengths", F.transform(F.sequence(F.lit(1), F.size("kept") + 1), lambda q: F.element_at(edges, q + 1)["i"] - F.element_at(edges, q)["i"]))
    k, mid = F.size("lengths"), F.array_sort("lengths")
    median = (F.element_at(mid, F.floor((k + 1) / 2).cast("int")) + F.element_at(mid, F.floor(k / 2 + 1).cast("int"))) / 2.0
    return out.select(*SERIES, F.col("n").alias("n_obs"), F.size("kept").cast("long").alias("n_breaks"),
                      F.transform("kept", lambda c: c["timestamp"]).alias("break_timestamps"), F.col("lengths").alias("segment_lengths"),
                      median.alias("median_segment_length"), (F.col("n") / k).alias("mean_segment_length"),
                      F.when(fits & (F.col("pick.b") < float("inf")), F.col("pick.b")).alias("best_bic"))
