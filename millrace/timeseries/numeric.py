"""Numpy kernels for one series: decomposition, spectra, diagnostics, models, change points."""

from __future__ import annotations

import math

import numpy as np

# decomposition and spectra ------------------------------------------------------


def decompose(y: np.ndarray, period: int, multiplicative: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual): centred moving average, phase means brought to mean 0 (or 1)."""
    n = len(y)
    if n < 2 * period:
        raise ValueError("two periods are needed")
    kernel = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = len(kernel) // 2
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(y, kernel, "valid")
    detrended = y / trend if multiplicative else y - trend
    phase = np.array([np.nanmean(detrended[i::period]) for i in range(period)])
    phase = phase / phase.mean() if multiplicative else phase - phase.mean()
    seasonal = phase[np.arange(n) % period]
    return trend, seasonal, y / trend / seasonal if multiplicative else y - trend - seasonal


def periodogram(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, power) of the mean-free series."""
    d = y - y.mean()
    f = np.fft.rfft(d)
    return np.fft.rfftfreq(len(y)), (np.abs(f) ** 2) / len(y)


def dominant_frequencies(y: np.ndarray, top: int = 3) -> list[tuple[float, float]]:
    freq, power = periodogram(y)
    best = np.argsort(-power[1:], kind="stable")[:top] + 1
    return [(float(freq[i]), float(power[i])) for i in best]


# autocorrelation and tests --------------------------------------------------------


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    d = y - y.mean()
    q = (d * d).sum()
    return np.array([1.0 if not k else (d[k:] * d[:-k]).sum() / q if q else 0.0 for k in range(lags + 1)])


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    """Levinson-Durbin."""
    r = acf(y, lags)
    out, phi, v = [1.0], np.zeros(0), 1.0
    for k in range(1, lags + 1):
        a = (r[k] - (phi * r[k - 1 : 0 : -1]).sum()) / v if v > 1e-15 else 0.0
        phi = np.r_[phi - a * phi[::-1], a]
        v *= 1 - a * a
        out.append(a)
    return np.array(out)


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail by the regularised incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def ljung_box(y: np.ndarray, lags: int) -> tuple[float, float]:
    n, r = len(y), acf(y, lags)
    q = n * (n + 2) * sum(r[k] ** 2 / (n - k) for k in range(1, lags + 1))
    return q, _chi2_tail(q, lags)


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = (e @ e) / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.maximum(s2 * np.diag(np.linalg.pinv(x.T @ x)), 0))


#: Fixed: large-sample 1, 5 and 10 % points of the tests with a constant.
ADF_CRITICAL = (-3.43, -2.86, -2.57)
KPSS_CRITICAL = (0.739, 0.463, 0.347)


def adf(y: np.ndarray, lags: int | None = None) -> dict:
    """Augmented Dickey-Fuller with a constant; stationary if the statistic is under the 5 % point."""
    lags = round(len(y) ** (1 / 3)) if lags is None else lags
    d = np.diff(y)
    target = d[lags:]
    x = np.column_stack([y[lags:-1], np.ones(len(target)), *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    beta, se = _ols(x, target)
    stat = float(beta[0] / se[0]) if se[0] else 0.0
    return {"statistic": stat, "lags": lags, "stationary": stat < ADF_CRITICAL[1]}


def kpss(y: np.ndarray, lags: int | None = None) -> dict:
    n = len(y)
    lags = round(n ** (1 / 3)) if lags is None else lags
    e = y - y.mean()
    s2 = (e @ e) / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * s2)) if s2 > 0 else 0.0
    return {"statistic": stat, "lags": lags, "stationary": stat < KPSS_CRITICAL[1]}


# models -------------------------------------------------------------------------------


def yule_walker(y: np.ndarray, p: int) -> np.ndarray:
    if not p:
        return np.zeros(0)
    r = acf(y, p)
    m = r[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))]
    return np.linalg.lstsq(m, r[1:], rcond=None)[0]


class Arima:
    """ARIMA(p, d, q) x (P, D, Q, s): AR terms by Yule-Walker, MA terms by least squares on long-AR residuals (Hannan-Rissanen)."""

    def __init__(self, p: int = 1, d: int = 0, q: int = 0, seasonal: tuple[int, int, int, int] = (0, 0, 0, 0)):
        self.p, self.d, self.q, self.seasonal = p, d, q, seasonal

    def fit(self, y: np.ndarray) -> Arima:
        sp, sd, sq, s = self.seasonal
        self.history = [np.asarray(y, float)]
        z = self.history[0]
        for _ in range(sd):
            z = z[s:] - z[:-s]
            self.history.append(z)
        for _ in range(self.d):
            z = np.diff(z)
            self.history.append(z)
        if len(z) < 3:
            raise ValueError("the series is too short")
        self.mean = z.mean()
        x = z - self.mean
        ar = [*range(1, self.p + 1), *[s * k for k in range(1, sp + 1)]]
        ma = [*range(1, self.q + 1), *[s * k for k in range(1, sq + 1)]]
        self.ar_lags, self.ma_lags = sorted(set(ar)), sorted(set(ma))
        e = np.zeros(len(x))
        if not self.ma_lags and self.ar_lags == list(range(1, self.p + 1)):
            self.ar, self.ma = yule_walker(x, self.p), np.zeros(0)
        else:
            long = min(max([*self.ar_lags, *self.ma_lags]) + 5, len(x) // 3)
            phi = yule_walker(x, long)
            e[long:] = x[long:] - sum(phi[k - 1] * x[long - k : -k] for k in range(1, long + 1)) if long else x
            start = max([long, *self.ar_lags, *self.ma_lags])
            design = np.column_stack([*[x[start - k : len(x) - k] for k in self.ar_lags], *[e[start - k : len(x) - k] for k in self.ma_lags]])
            beta = np.linalg.lstsq(design, x[start:], rcond=None)[0]
            self.ar, self.ma = beta[: len(self.ar_lags)], beta[len(self.ar_lags) :]
        e = np.zeros(len(x))
        for t in range(len(x)):
            e[t] = x[t] - sum(a * x[t - k] for a, k in zip(self.ar, self.ar_lags, strict=True) if t >= k) - sum(b * e[t - k] for b, k in zip(self.ma, self.ma_lags, strict=True) if t >= k)
        self.x, self.e = x, e
        m = len(self.ar) + len(self.ma) + 1
        sigma2 = max(float(e @ e) / len(e), 1e-12)
        self.aic = len(e) * math.log(sigma2) + 2 * m
        self.bic = len(e) * math.log(sigma2) + m * math.log(len(e))
        return self

    def forecast(self, steps: int) -> np.ndarray:
        x, e = list(self.x), list(self.e)
        out = []
        for _ in range(steps):
            v = sum(a * x[-k] for a, k in zip(self.ar, self.ar_lags, strict=True) if k <= len(x)) + sum(b * e[-k] for b, k in zip(self.ma, self.ma_lags, strict=True) if k <= len(e))
            x.append(v)
            e.append(0.0)
            out.append(v + self.mean)
        z = np.array(out)
        levels = self.history[:-1]
        _, sd, _, s = self.seasonal
        for i, before in reversed(list(enumerate(levels))):
            if i >= sd:
                z = before[-1] + np.cumsum(z)
            else:
                past = list(before)
                for v in z:
                    past.append(past[-s] + v)
                z = np.array(past[len(before) :])
        return z


def auto_arima(y: np.ndarray, max_p: int = 3, max_d: int = 1, max_q: int = 2, criterion: str = "aic") -> Arima:
    best = None
    for d in range(max_d + 1):
        for p in range(max_p + 1):
            for q in range(max_q + 1):
                try:
                    m = Arima(p, d, q).fit(y)
                except (ValueError, np.linalg.LinAlgError):
                    continue
                if best is None or getattr(m, criterion) < getattr(best, criterion):
                    best = m
    if best is None:
        raise ValueError("no model fits")
    return best


class ExponentialSmoothing:
    """Simple, double (trend) or triple (trend and season) smoothing with given weights."""

    def __init__(self, kind: str = "simple", alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, period: int = 12, multiplicative: bool = False):
        self.kind, self.alpha, self.beta, self.gamma, self.period, self.multiplicative = kind, alpha, beta, gamma, period, multiplicative

    def fit(self, y: np.ndarray) -> ExponentialSmoothing:
        y = np.asarray(y, float)
        self.level, self.trend, self.season = float(y[0]), 0.0, []
        if self.kind == "double":
            self.trend = float(y[1] - y[0]) if len(y) > 1 else 0.0
        if self.kind == "triple":
            m = self.period
            if len(y) < 2 * m:
                raise ValueError("two periods are needed")
            self.level = float(y[:m].mean())
            self.trend = float((y[m : 2 * m].mean() - y[:m].mean()) / m)
            self.season = [float(v / self.level if self.multiplicative else v - self.level) for v in y[:m]]
        self.fitted = []
        for t, v in enumerate(y):
            s = self.season[t % self.period] if self.season else None
            base = self.level + self.trend
            self.fitted.append(base if s is None else base * s if self.multiplicative else base + s)
            clean = v if s is None else v / s if self.multiplicative else v - s
            before = self.level
            self.level = self.alpha * clean + (1 - self.alpha) * base
            if self.kind != "simple":
                self.trend = self.beta * (self.level - before) + (1 - self.beta) * self.trend
            if s is not None:
                now = v / self.level if self.multiplicative else v - self.level
                self.season[t % self.period] = self.gamma * now + (1 - self.gamma) * s
        self.n = len(y)
        return self

    def forecast(self, steps: int) -> np.ndarray:
        out = []
        for h in range(1, steps + 1):
            v = self.level + h * self.trend
            if self.season:
                s = self.season[(self.n + h - 1) % self.period]
                v = v * s if self.multiplicative else v + s
            out.append(v)
        return np.array(out)


class MovingAverage:
    def __init__(self, window: int = 3):
        self.window = window

    def fit(self, y: np.ndarray) -> MovingAverage:
        self.past = list(np.asarray(y, float)[-self.window :])
        return self

    def forecast(self, steps: int) -> np.ndarray:
        past, out = list(self.past), []
        for _ in range(steps):
            out.append(float(np.mean(past[-self.window :])))
            past.append(out[-1])
        return np.array(out)


def make_model(name: str, **params):
    kinds = {"arima": Arima, "sma": MovingAverage, "smoothing": ExponentialSmoothing}
    if name == "auto_arima":
        class Auto:
            def fit(self, y):
                self.best = auto_arima(y, **params)
                return self

            def forecast(self, steps):
                return self.best.forecast(steps)

        return Auto()
    return kinds[name](**params)


def backtest(y: np.ndarray, model: str, horizon: int, folds: int, sliding: bool = False, **params) -> list[dict]:
    """Errors of each fold; training grows, or slides at constant length."""
    n, out = len(y), []
    first = n - folds * horizon
    if first < 2:
        raise ValueError("the series is too short for these folds")
    for k in range(folds):
        end = first + k * horizon
        train = y[end - first : end] if sliding else y[:end]
        e = y[end : end + horizon] - make_model(model, **params).fit(train).forecast(horizon)
        actual = y[end : end + horizon]
        safe = actual != 0
        out.append({"fold": k, "mae": float(np.abs(e).mean()), "rmse": float(np.sqrt((e * e).mean())), "mape": float(np.abs(e[safe] / actual[safe]).mean()) if safe.any() else 0.0})
    return out


def pelt(y: np.ndarray, penalty: float | None = None, least: int = 2) -> list[int]:
    """Starts of new segments of constant mean and at least ``least`` values: the least cost of all ways to cut, by pruned search.

    A start that is beaten at t cannot begin a segment that ends at t + least or later, so it stays open until then.
    """
    n = len(y)
    y = y - y.mean() if n else y
    s, q = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(y * y)]
    penalty = 2 * math.log(max(n, 2)) * max(float(np.var(np.diff(y)) / 2) if n > 2 else 1.0, 1e-12) if penalty is None else penalty

    def cost(a: int, b: int) -> float:
        return q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)

    best, before, closes = np.full(n + 1, np.inf), np.zeros(n + 1, int), {0: n + 1}
    best[0] = -penalty
    for t in range(least, n + 1):
        closes = {a: end for a, end in closes.items() if t < end}
        values = [(best[a] + cost(a, t) + penalty, a) for a in closes if t - a >= least]
        if values:
            best[t], before[t] = min(values)
            for a in closes:
                if t - a >= least and best[a] + cost(a, t) > best[t]:
                    closes[a] = min(closes[a], t + least)
        closes[t] = n + 1
    out, t = [], n
    while t > 0:
        t = int(before[t])
        if t:
            out.append(t)
    return out[::-1]
