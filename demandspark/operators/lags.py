"""Orders, differences and lag vectors that the seasonal ARIMA steps share."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np

from demandspark.operators.gram import least_squares
from demandspark.operators.grids import ORDER_COLUMNS


def candidates(limits: Mapping[str, int], period: int | None) -> list[tuple[int, ...]]:
    """(grid_id, p, d, q, P, D, Q); without a period the seasonal orders are 0."""
    top = [limits[k] if period or k.islower() else 0 for k in ORDER_COLUMNS]
    out = []
    # the first name varies fastest, so the product runs over the reversed names
    for number, back in enumerate(itertools.product(*[range(t + 1) for t in reversed(top)])):
        p, d, q, sp, sd, sq = reversed(back)
        if period and (p + q == 0 or sp + sq == 0):
            continue
        out.append((number, p, d, q, sp, sd, sq))
    return out


def difference_weights(d: int, seasonal_d: int, period: int) -> dict[int, float]:
    """Coefficients by lag of (1-B)^d (1-B^m)^D."""
    poly = np.array([1.0])
    seasonal = np.zeros(period + 1)
    seasonal[0], seasonal[-1] = 1.0, -1.0
    for factor in [np.array([1.0, -1.0])] * d + [seasonal] * seasonal_d:
        poly = np.convolve(poly, factor)
    return {lag: float(c) for lag, c in enumerate(poly) if c}


def ar_lags(order: Sequence[int], period: int) -> list[int]:
    """Lags of an order pair (non-seasonal, seasonal)."""
    return [*range(1, order[0] + 1), *(period * j for j in range(1, order[1] + 1))]


def pick_lag(span: int, lag: int) -> np.ndarray:
    v = np.zeros(span + 2)
    v[span + 1 - lag] = 1.0
    return v


def innovation_basis(g: np.ndarray, n: int, span: int, long_ar: int) -> np.ndarray:
    """The innovation of the current row as weights on its lag vector."""
    order = max(1, min(long_ar, n // 4))  # a short series supports fewer lags
    block = [0, *(span + 1 - i for i in range(1, order + 1))]
    coef = least_squares(g[np.ix_(block, block)], g[block, span + 1])
    v = pick_lag(span, 0)
    v[block] -= coef
    return v


def lagged_basis(v: np.ndarray, lag: int) -> np.ndarray:
    """The same linear form ``lag`` rows earlier (the constant stays)."""
    out = np.zeros_like(v)
    out[0] = v[0]
    out[1:-lag] = v[1 + lag:]
    return out


def largest_root(lags: Sequence[int], coef: np.ndarray) -> float:
    """Largest modulus of the lag polynomial's inverse roots; below 1 is stable."""
    if not len(lags):
        return 0.0
    dense = np.zeros(max(lags))
    dense[np.asarray(lags) - 1] = coef
    companion = np.eye(len(dense), k=-1)
    companion[0] = dense
    return float(np.max(np.abs(np.linalg.eigvals(companion))))
