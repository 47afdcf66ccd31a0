"""Textbook forms of the series tests on whole arrays, to compare the distributed ones with."""
import math

import numpy as np

from barweave.operators.series import ADF_SURFACE, CIPS_LAGS, DFGLS_5, KPSS_5, MIN_N


def ols(y, x):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return b, y - x @ b


def _tstat(y, x, j):
    b, u = ols(y, x)
    n, k = x.shape
    s2 = u @ u / max(n - k, 1)
    se = math.sqrt(max(s2 * np.linalg.pinv(x.T @ x)[j, j], 0.0))
    return (b[j] / se if se > 0 else np.nan), u


def max_lag(n, k=4):
    return int(k * (n / 100.0) ** 0.25)


def _trend(n, kind):
    cols = [np.ones(n)] if kind in ("c", "ct") else []
    if kind == "ct":
        cols.append(np.arange(1, n + 1, dtype=float))
    return np.column_stack(cols) if cols else np.empty((n, 0))


def _adf_design(y, p, first, kind):
    dy = np.diff(y)
    rows = np.arange(first, len(dy))
    lags = [dy[rows - i] for i in range(1, p + 1)]
    return dy[rows], np.column_stack([y[rows], *lags, _trend(len(rows), kind)])


def adf_stat(y, kind, top=None):
    """t of the lagged level, lag order by BIC on a common sample, refitted on all usable rows."""
    top = max_lag(len(y)) if top is None else top
    best, lag = np.inf, 0
    for p in range(top + 1):
        d, x = _adf_design(y, p, top, kind)
        n, k = x.shape
        if n <= k:
            break
        _, u = ols(d, x)
        rss = u @ u
        if rss <= 0:
            return np.nan, p
        bic = n * (math.log(2 * math.pi * rss / n) + 1) + math.log(n) * k
        if bic < best:
            best, lag = bic, p
    d, x = _adf_design(y, lag, lag, kind)
    return _tstat(d, x, 0)[0], lag


def adf_critical(n, kind):
    a, b, c, d = ADF_SURFACE[kind]
    return a + b / n + c / n ** 2 + d / n ** 3


def kpss_stat(y, kind):
    """Partial sums of the detrended series over its long-run variance, automatic bandwidth."""
    n = len(y)
    _, r = ols(y, _trend(n, kind))
    s0, s1 = r @ r / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        prod = r[i:] @ r[:-i] / (n / 2)
        s0 += prod
        s1 += i * prod
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    lr = (r @ r + 2 * sum((1 - i / (lags + 1)) * (r[i:] @ r[:-i]) for i in range(1, lags + 1))) / n
    return (np.sum(np.cumsum(r) ** 2) / n ** 2 / lr if lr > 0 else np.nan), lags


def pp_stat(y, kind):
    """Lagged-level t corrected for serial correlation by a Bartlett long-run variance."""
    n = len(y) - 1
    x = np.column_stack([y[:-1], _trend(n, kind)])
    b, u = ols(y[1:], x)
    lags = int(math.ceil(12 * (len(y) / 100.0) ** 0.25))
    g0 = u @ u / n
    lam = g0 + 2 * sum((1 - i / (lags + 1)) * (u[i:] @ u[:-i]) / n for i in range(1, min(lags, n - 1) + 1))
    s2 = u @ u / max(n - x.shape[1], 1)
    se = math.sqrt(max(s2 * np.linalg.pinv(x.T @ x)[0, 0], 0.0))
    if lam <= 0 or se <= 0:
        return np.nan
    return math.sqrt(g0 / lam) * (b[0] - 1) / se - 0.5 * (lam - g0) / math.sqrt(lam) * (n * se / math.sqrt(s2))


def dfgls_stat(y, kind):
    """ADF without deterministics on the GLS-detrended series."""
    n = len(y)
    a = 1 + (-7.0 if kind == "c" else -13.5) / n
    z = _trend(n, kind)
    qy, qz = np.r_[y[0], y[1:] - a * y[:-1]], np.vstack([z[:1], z[1:] - a * z[:-1]])
    b, _ = ols(qy, qz)
    return adf_stat(y - z @ b, "n", max_lag(n))


def dfgls_critical(n, kind):
    return next(v for top, v in DFGLS_5[kind] if n <= top)


def ar1(y):
    """Persistence, its HAC standard error and the half-life of a shock."""
    x = np.column_stack([np.ones(len(y) - 1), y[:-1]])
    b, u = ols(y[1:], x)
    g = x * u[:, None]
    s = g.T @ g
    lags = int(math.ceil(len(y) ** (1 / 3)))
    for i in range(1, lags + 1):
        c = g[i:].T @ g[:-i]
        s += (1 - i / (lags + 1)) * (c + c.T)
    inv = np.linalg.pinv(x.T @ x)
    rho = float(b[1])
    return rho, math.sqrt(max((inv @ s @ inv)[1, 1], 0.0)), (-math.log(2) / math.log(rho) if 0 < rho < 1 else None)


def gph(y, power=0.5):
    """Log-periodogram slope over the lowest frequencies."""
    x = y - y.mean()
    n = len(x)
    m = int(n ** power)
    if m < 5:
        return None
    f = 2 * np.pi * np.arange(1, m + 1) / n
    per = np.abs(np.fft.fft(x)[1:m + 1]) ** 2 / (2 * np.pi * n)
    if (per <= 0).any():
        return None
    b, _ = ols(np.log(per), np.column_stack([np.ones(m), -np.log(4 * np.sin(f / 2) ** 2)]))
    se = math.pi / math.sqrt(24.0 * m)
    return float(b[1]), se, math.erfc(abs(b[1] / se) / math.sqrt(2)), m


_TESTS = [f"{t}_{k}" for t in ("dfgls", "pp", "adf", "kpss") for k in ("c", "ct")]
_NAMES = ["n_obs", *[f"{t}_{s}" for t in _TESTS for s in ("stat", "reject")], "ar1_rho", "ar1_se", "ar1_halflife", "gph_d", "gph_se",
          "gph_pval_d0", "gph_m"]
_TYPES = ["long", *["double", "boolean"] * len(_TESTS), "double", "double", "double", "double", "double", "double", "long"]


def _battery(y):
    n = len(y)
    out = dict.fromkeys(_NAMES)
    out["n_obs"] = n
    flat = n == 0 or np.ptp(y) == 0
    for k in ("c", "ct"):
        jobs = {"adf": lambda: adf_stat(y, k)[0], "kpss": lambda: kpss_stat(y, k)[0], "pp": lambda: pp_stat(y, k), "dfgls": lambda: dfgls_stat(y, k)[0]}
        for t, f in jobs.items():
            if n < MIN_N[t] or flat:
                continue
            s = f()
            if s is None or not np.isfinite(s):
                continue
            out[f"{t}_{k}_stat"] = float(s)
            cut = {"adf": lambda: s < adf_critical(n, k), "pp": lambda: s < adf_critical(n, k), "kpss": lambda: s > KPSS_5[k],
                   "dfgls": lambda: s < dfgls_critical(n, k)}[t]
            out[f"{t}_{k}_reject"] = bool(cut())
    if n >= MIN_N["ar1"] and not flat:
        out["ar1_rho"], out["ar1_se"], out["ar1_halflife"] = ar1(y)
    if n >= MIN_N["gph"] and not flat:
        g = gph(y)
        if g:
            out["gph_d"], out["gph_se"], out["gph_pval_d0"], out["gph_m"] = g
    return out


def segment(y, min_size, n_breaks):
    """Greedy binary segmentation of the mean; break positions in the order they were found."""
    s1, s2 = np.r_[0.0, np.cumsum(y)], np.r_[0.0, np.cumsum(y * y)]

    def best(a, b):
        k = np.arange(a + min_size, b - min_size + 1)
        if len(k) == 0:
            return 0.0, None

        def cost(i, j):
            return s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (j - i)

        gain = cost(a, b) - cost(np.full_like(k, a), k) - cost(k, np.full_like(k, b))
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    leaves, found = {(0, len(y)): best(0, len(y))}, []
    for _ in range(n_breaks):
        (a, b), (_, k) = max(leaves.items(), key=lambda kv: kv[1][0] if kv[1][1] is not None else -1.0)
        if k is None:
            break
        found.append(k)
        del leaves[(a, b)]
        leaves[(a, k)], leaves[(k, b)] = best(a, k), best(k, b)
    return found


def detect_breaks(y, max_breaks=5, min_frac=0.15, fixed=None):
    """(breaks, BIC): the number of breaks by BIC, or a fixed number."""
    n = len(y)
    size = max(10, int(round(n * min_frac)))
    if n < 30 or size * 2 > n:
        return [], None
    order = segment(y, size, fixed if fixed is not None else max_breaks)

    def bic(k):
        cuts = [0, *sorted(order[:k]), n]
        rss = sum(float(np.sum((y[a:b] - y[a:b].mean()) ** 2)) for a, b in zip(cuts, cuts[1:]))
        return n * math.log(rss / n) + (k + 1) * math.log(n) if rss > 0 else math.inf

    ks = [len(order)] if fixed is not None else list(range(len(order) + 1))
    scores = [bic(k) for k in ks]
    i = int(np.argmin(scores))
    return sorted(order[:ks[i]]), (scores[i] if math.isfinite(scores[i]) else None)


def cips_t(v, bar, index, kind, p=CIPS_LAGS):
    """t of the lagged level in the cross-sectionally augmented regression of one section."""
    if len(index) < MIN_N["cips"] + p + 2:
        return None
    span = index[-1] - index[0] + 1
    y, b = np.full(span, np.nan), np.full(span, np.nan)
    y[index - index[0]], b[index - index[0]] = v, bar
    dy, db = np.diff(y, prepend=np.nan), np.diff(b, prepend=np.nan)

    def back(a, k):
        return np.r_[np.full(k, np.nan), a[:-k]]

    m = np.column_stack([dy, np.ones(span), back(y, 1), back(b, 1), db, *[back(dy, k) for k in range(1, p + 1)]]
                        + ([np.arange(span, dtype=float)] if kind == "ct" else []))
    m = m[np.isfinite(m).all(axis=1)]
    return _tstat(m[:, 0], m[:, 1:], 1)[0] if len(m) >= 20 else None
