"""Exact Gaussian likelihood of one seasonal ARMA series with regressors.

The model is u = w - x beta with phi(B) Phi(B^m) u = theta(B) Theta(B^m) e. Given the
contribution c of what lies before the first row to the first r rows, the innovations are
linear in the data: e = theta^-1 (phi u) - H c, where H holds shifted copies of the expansion
of 1/theta. c is normal with the covariance S of the stationary process, so the exact
likelihood needs no step through time: with M = H'H,

    x' V^-1 y = ex' ey - (H'ex)' S (I + M S)^-1 (H'ey),    log |V| = log |I + M S|.

beta and the variance are profiled out. Parameters are partial autocorrelations through tanh,
so every trial is stationary and invertible. Many trials are evaluated at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

BOUND = 0.998
STEP = 1e-4
DAMP = 1e-9


class Order(NamedTuple):
    p: int = 0
    d: int = 0
    q: int = 0
    sp: int = 0
    sd: int = 0
    sq: int = 0

    @property
    def terms(self) -> int:
        return self.p + self.q + self.sp + self.sq


class Fit(NamedTuple):
    """``ar`` and ``ma`` are the multiplied-out lag weights; ``before`` is the estimate of c."""

    order: Order
    ar: np.ndarray
    ma: np.ndarray
    beta: np.ndarray
    sigma2: float
    log_likelihood: float
    residual: np.ndarray
    before: np.ndarray
    terms: np.ndarray


def from_partial(u: np.ndarray) -> np.ndarray:
    """Stable AR weights (trials, k) from free numbers (trials, k)."""
    pac, out = BOUND * np.tanh(u), np.zeros_like(u)
    for k in range(u.shape[1]):
        last = pac[:, k: k + 1]
        out[:, :k] = out[:, :k] - last * out[:, :k][:, ::-1]
        out[:, k: k + 1] = last
    return out


def _product(plain: np.ndarray, seasonal: np.ndarray, m: int, sign: float) -> np.ndarray:
    """(1 + sign a1 B + ...)(1 + sign b1 B^m + ...), without the leading 1 and the sign."""
    p, s = plain.shape[1], seasonal.shape[1]
    out = np.zeros((len(plain), p + m * s))
    out[:, :p] = plain
    for j in range(s):
        at = m * (j + 1) - 1
        out[:, at] += seasonal[:, j]
        for i in range(p):
            out[:, at + i + 1] += sign * plain[:, i] * seasonal[:, j]
    return out


def lag_weights(order: Order, u: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """AR and MA weights of all lags for every trial."""
    cuts = np.cumsum([order.p, order.q, order.sp])
    p, q, sp, sq = np.split(u, cuts, axis=1)
    ar = _product(from_partial(p), from_partial(sp), m, -1.0)
    ma = _product(-from_partial(q), -from_partial(sq), m, 1.0)
    return ar, ma


def _fast_length(n: int) -> int:
    """The least 2^a, 3 2^a or 5 2^a from n on."""
    return min(f << max(0, (-(-n // f) - 1).bit_length()) for f in (1, 3, 5))


def _stationary(ar: np.ndarray, ma: np.ndarray, r: int) -> np.ndarray:
    """Covariance of c for unit innovations: S = T S T' + k k'."""
    trials = len(ar)
    phi, theta = np.zeros((trials, r)), np.zeros((trials, r))
    phi[:, : ar.shape[1]], theta[:, : ma.shape[1]] = ar, ma
    step = np.zeros((trials, r, r))
    step[:, :, 0] = phi
    step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    gain = (phi + theta)[:, :, None]
    out = gain @ gain.transpose(0, 2, 1)
    for _ in range(40):
        out = out + step @ out @ step.transpose(0, 2, 1)
        step = step @ step
        if not np.abs(step).max() > 1e-12:
            break
    return out


def _solved(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """Normal equations of every trial; a column without content gets no weight."""
    size = np.einsum("lii->li", xtx)
    scale = np.sqrt(np.where(size > 1e-20 * np.maximum(size.max(axis=1, keepdims=True), 1e-300), size, np.inf))
    inverse = np.linalg.pinv(xtx / (scale[:, :, None] * scale[:, None, :]), rcond=1e-10, hermitian=True)
    return (inverse @ (xty / scale)[:, :, None])[:, :, 0] / scale


class Likelihood:
    """Trials of one order on one (differenced) series ``w`` with regressors ``x``."""

    def __init__(self, order: Order, w: np.ndarray, x: np.ndarray, m: int):
        self.order, self.m, self.n = order, m, len(w)
        self.data = np.concatenate([w[None, :], x.T])
        # Responses are infinite and the transform is circular: what wraps around is damped by DAMP.
        self.width = _fast_length(2 * self.n)
        damping = DAMP ** (1.0 / self.width)
        self.damp = damping ** np.arange(self.n)
        self.seen = np.fft.rfft(self.data * self.damp, self.width)
        longest = max(order.p + order.sp * m, order.q + order.sq * m)
        lag = np.arange(1, longest + 1)[:, None]
        self.waves = damping**lag * np.exp(-2j * np.pi / self.width * lag * np.arange(self.width // 2 + 1))

    def _parts(self, u: np.ndarray):
        ar, ma = lag_weights(self.order, u, self.m)
        r = max(ar.shape[1], ma.shape[1])
        # 1 / theta and phi / theta, as they respond to one innovation and to the data
        inverse = 1.0 / (1.0 + ma @ self.waves[: ma.shape[1]])
        filtered = inverse * (1.0 - ar @ self.waves[: ar.shape[1]])
        h = np.fft.irfft(inverse, self.width)[:, : self.n] / self.damp if r else inverse.real[:, : self.n]
        e = np.fft.irfft(filtered[:, None, :] * self.seen, self.width)[:, :, : self.n] / self.damp
        q = e @ e.transpose(0, 2, 1)
        if not r:
            return ar, ma, h, e, q, np.zeros(len(u)), None, None, r
        first = np.zeros((len(u), r, r))
        lagged = np.zeros((len(u), r, e.shape[1]))
        for j in range(min(r, self.n)):
            shifted = h[:, : self.n - j]
            lagged[:, j] = np.einsum("lt,lct->lc", shifted, e[:, :, j:])
            first[:, 0, j] = np.einsum("lt,lt->l", h[:, j:], shifted)
        end = np.zeros((len(u), r))
        end[:, : min(r, self.n)] = h[:, ::-1][:, : min(r, self.n)]
        gram = first
        for i in range(1, r):
            gram[:, i, 0] = gram[:, 0, i]
            gram[:, i, 1:] = gram[:, i - 1, :-1] - end[:, i - 1: i] * end[:, : r - 1]
        s = _stationary(ar, ma, r)
        inner = np.eye(r) + gram @ s
        # estimate of c is s (I + gram s)^-1 H'e, for each column of the data
        smooth = s @ np.linalg.solve(inner, lagged)
        q = q - lagged.transpose(0, 2, 1) @ smooth
        return ar, ma, h, e, q, np.linalg.slogdet(inner)[1], smooth, lagged, r

    def _profile(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        beta = _solved(q[:, 1:, 1:], q[:, 1:, 0]) if q.shape[1] > 1 else np.zeros((len(q), 0))
        rest = q[:, 0, 0] - np.einsum("li,li->l", beta, q[:, 1:, 0])
        return beta, np.maximum(rest, 1e-12 * np.maximum(q[:, 0, 0], 1e-12)) / self.n

    def value(self, u: np.ndarray) -> np.ndarray:
        """Log-likelihood of every trial (trials, terms)."""
        with np.errstate(all="ignore"):
            _, _, _, _, q, log_det, *_ = self._parts(u)
            sigma2 = self._profile(q)[1]
            out = -0.5 * (self.n * (np.log(2 * np.pi * sigma2) + 1.0) + log_det)
        return np.where(np.isfinite(out), out, -np.inf)

    def at(self, u: np.ndarray) -> Fit:
        """Everything that follows from one set of terms."""
        u = np.asarray(u, float).reshape(1, -1)
        ar, ma, h, e, q, _, smooth, _, r = self._parts(u)
        beta, sigma2 = self._profile(q)
        weights = np.concatenate([[1.0], -beta[0]])
        residual = weights @ e[0]
        before = smooth[0] @ weights if r else np.zeros(0)
        for j in range(min(r, self.n)):
            residual[j:] -= before[j] * h[0, : self.n - j]
        return Fit(self.order, ar[0], ma[0], beta[0], float(sigma2[0]), float(self.value(u)[0]), residual, before, u[0])

    def maximise(self, rounds: int = 40, start: np.ndarray | None = None) -> Fit:
        """Quasi-Newton from ``start`` or the best of fixed starts; each round is two batches of trials."""
        k = self.order.terms
        if not k:
            return self.at(np.zeros(0))
        if len(self.data) > 2:
            return self._in_turn(rounds)
        starts = np.concatenate([np.zeros((1, k)), 0.4 * np.eye(k), -0.4 * np.eye(k), 0.8 * np.eye(k)])
        if start is not None:
            starts = start[None]
        values = self.value(starts)
        u, best = starts[np.argmax(values)], values.max()
        if not np.isfinite(best):
            return self.at(np.zeros(k))
        inverse, slope, rate = np.eye(k) / self.n, self._slope(u), 0
        for _ in range(rounds):
            way = inverse @ slope
            size = np.abs(way).max()
            way = way * min(1.0, 1.0 / size) if size > 0 else way
            lengths = np.array([1.0, 0.5, 0.2, 0.05, 0.01, 2.0])
            trials = u + lengths[:, None] * way
            values = self.value(trials)
            at = int(np.argmax(values))
            if not values[at] > best:
                if rate:
                    break
                inverse, rate = np.eye(k) / self.n, 1
                continue
            rate, gain, moved = 0, values[at] - best, trials[at] - u
            u, best = trials[at], values[at]
            now = self._slope(u)
            if gain < 1e-7 or np.abs(now).max() < 1e-5:
                break
            bend = slope - now
            inner = bend @ moved
            if inner > 1e-12:
                a = np.eye(k) - np.outer(moved, bend) / inner
                inverse = a @ inverse @ a.T + np.outer(moved, moved) / inner
            slope = now
        return self.at(u)

    def _in_turn(self, rounds: int) -> Fit:
        """Terms given the regression, the regression given the terms, until neither gains.

        The two are nearly independent, so a few turns reach the joint optimum, and the search for the
        terms has one column whatever the number of regressors.
        """
        w, x = self.data[0], self.data[1:]
        beta, u, best = _solved((x @ x.T)[None], (x @ w)[None])[0], None, -np.inf
        for _ in range(20):
            trial = Likelihood(self.order, w - beta @ x, np.zeros((self.n, 0)), self.m).maximise(rounds, u).terms
            value = self.value(trial[None])[0]
            if not value > best + 1e-8:
                break
            u, best, beta = trial, value, self._profile(self._parts(trial[None])[4])[0][0]
        return self.at(trial if u is None else u)

    def _slope(self, u: np.ndarray) -> np.ndarray:
        move = STEP * np.eye(len(u))
        values = self.value(np.concatenate([u + move, u - move]))
        out = (values[: len(u)] - values[len(u):]) / (2 * STEP)
        return np.where(np.isfinite(out), out, 0.0)


def continued(fit: Fit, u: np.ndarray, h: int) -> np.ndarray:
    """Expected next h values of u = w - x beta."""
    n, (ar, ma) = len(u), (fit.ar, fit.ma)
    u, e = np.concatenate([u, np.zeros(h)]), np.concatenate([fit.residual, np.zeros(h)])
    for t in range(n, n + h):
        a, b = min(len(ar), t), min(len(ma), t)
        u[t] = ar[:a] @ u[t - a: t][::-1] + ma[:b] @ e[t - b: t][::-1] + (fit.before[t] if t < len(fit.before) else 0.0)
    return u[n:]


def response(ar: Sequence[float], ma: Sequence[float], h: int) -> np.ndarray:
    """The first h weights of theta(B) / phi(B)."""
    out = np.zeros(h)
    for t in range(h):
        out[t] = (1.0 if not t else ma[t - 1] if t <= len(ma) else 0.0) + sum(ar[i] * out[t - 1 - i] for i in range(min(t, len(ar))))
    return out
