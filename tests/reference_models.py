"""One window at a time: the solver, preprocessor and tuner that the summed fits are compared with."""
import numpy as np

from barweave.functions.identity import HPO_FALLBACKS, HPO_OK
from barweave.operators.forecasts import DEFAULT_C, MIN_INNER, MIN_VALIDATION
from barweave.operators.preprocessing import WINSOR_FEATURES, WINSOR_MIN, WINSOR_Q
from barweave.operators.windows import VALIDATION_FRACTION


def fit_logit(x, y, c, tol=1e-10, max_iter=100):
    """Minimise |w|^2 / 2 + c * sum log-loss with a free intercept, by damped Newton steps."""
    n, k = x.shape
    z = np.hstack([np.ones((n, 1)), x])
    ridge = np.r_[0.0, np.ones(k)]
    w = np.zeros(k + 1)

    def value(v):
        s = z @ v
        return 0.5 * np.dot(ridge * v, v) + c * np.sum(np.logaddexp(0.0, s) - y * s)

    f = value(w)
    for _ in range(max_iter):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -500, 500)))
        g = ridge * w + c * (z.T @ (p - y))
        if np.max(np.abs(g)) < tol * max(1.0, c * n):
            break
        h = c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge) + 1e-12 * np.eye(k + 1)
        step = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-8 and value(w - t * step) > f - 1e-4 * t * np.dot(g, step):
            t /= 2
        w = w - t * step
        f = value(w)
    return w


def predict_logit(w, x):
    return 1.0 / (1.0 + np.exp(-np.clip(w[0] + x @ w[1:], -500, 500)))


class Preprocessor:
    """Clip limits, scaling and ticker dummies of one training window, frozen for its test rows."""

    def __init__(self, x, tickers, features, fixed_effects):
        self.limits, self.cols = {}, [i for i, f in enumerate(features) if f in WINSOR_FEATURES]
        self.pooled = self._limits(x)
        for t in np.unique(tickers):
            self.limits[t] = self._limits(x[tickers == t])
        xw = self.clip(x, tickers)
        self.mean, sd = xw.mean(axis=0), xw.std(axis=0)
        self.scale = np.where(sd > 0, sd, 1.0)
        self.names = np.unique(tickers)[1:] if fixed_effects else np.array([])

    def _limits(self, x):
        if len(x) < WINSOR_MIN or not self.cols:
            return None
        return np.quantile(x[:, self.cols], WINSOR_Q, axis=0)

    def clip(self, x, tickers):
        out = x.copy()
        for t in np.unique(tickers):
            lim = self.limits.get(t)
            lim = self.pooled if lim is None else lim
            if lim is not None:
                rows = np.flatnonzero(tickers == t)
                out[np.ix_(rows, self.cols)] = np.clip(out[np.ix_(rows, self.cols)], lim[0], lim[1])
        return out

    def __call__(self, x, tickers):
        z = (self.clip(x, tickers) - self.mean) / self.scale
        if len(self.names):
            z = np.hstack([z, (tickers[:, None] == self.names[None, :]).astype(float)])
        return z


def _score(y, p, objective):
    q = np.clip(p, 1e-15, 1 - 1e-15)
    if objective == "accuracy":
        return -float(np.mean((p >= 0.5) == (y == 1)))
    if objective == "brier_score":
        return float(np.mean((q - y) ** 2))
    return float(np.mean(-(y * np.log(q) + (1 - y) * np.log(1 - q))))


def _fit(x, y, tk, features, fe, c):
    pre = Preprocessor(x, tk, features, fe)
    w = fit_logit(pre(x, tk), y, c)
    if not np.isfinite(w).all():
        raise FloatingPointError("no finite solution")
    return pre, w


def tune(x, y, tk, ts, features, fe, grid, objective, by_time):
    """Choose C on the last fifth of the window, refit on all of it; first best wins."""
    if by_time:
        u = np.unique(ts)
        n = len(u)
        n_val = min(max(int(round(n * VALIDATION_FRACTION)), 1), n - 1) if n >= 2 else 0
        inner = ts < u[n - n_val] if n_val else np.zeros(len(ts), bool)
    else:
        n = len(ts)
        n_val = min(max(int(round(n * VALIDATION_FRACTION)), 1), n - 1) if n >= 2 else 0
        inner = np.arange(n) < n - n_val
    best, best_c, status = None, DEFAULT_C, HPO_OK
    if inner.sum() < MIN_INNER or (~inner).sum() < MIN_VALIDATION or len(np.unique(y[inner])) < 2:
        status = HPO_FALLBACKS[0]
    else:
        pre = Preprocessor(x[inner], tk[inner], features, fe)
        a, b = pre(x[inner], tk[inner]), pre(x[~inner], tk[~inner])
        for c in grid:
            try:
                s = _score(y[~inner], predict_logit(fit_logit(a, y[inner], c), b), objective)
            except (np.linalg.LinAlgError, FloatingPointError):
                continue
            if np.isfinite(s) and (best is None or s < best):
                best, best_c = s, c
        if best is None:
            status = HPO_FALLBACKS[1]
    try:
        pre, w = _fit(x, y, tk, features, fe, best_c)
    except (np.linalg.LinAlgError, FloatingPointError):
        best_c, status = DEFAULT_C, HPO_FALLBACKS[2]
        pre, w = _fit(x, y, tk, features, fe, best_c)
    score = None if best is None else (-best if objective == "accuracy" else best)
    return pre, w, best_c, score, status
