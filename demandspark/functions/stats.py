"""Distribution functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandspark.schema import SERVICE_LEVEL_Z

# ---------------------------------------------------------------------------
# Published approximation coefficients.
# ---------------------------------------------------------------------------
# Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687,
            138.3577518672690, -30.66479806614716, 2.506628277459239]
ACKLAM_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866,
            66.80131188771972, -13.28068155288572]
ACKLAM_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838,
            -2.549732539343734, 4.374664141464968, 2.938163982698783]
ACKLAM_D = [0.007784695709041462, 0.3224671290700398, 2.445134137003996,
            3.754408661907416]
ACKLAM_TAIL = 0.02425
# Abramowitz and Stegun 7.1.26, error function.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    """Horner form, highest power first."""
    value = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        value = value * x + F.lit(float(c))
    return value


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal; NULL outside (0, 1)."""
    centre = p - 0.5
    r = centre * centre
    middle = centre * polynomial(ACKLAM_A, r) / polynomial([*ACKLAM_B, 1.0], r)

    def tail(prob: Column) -> Column:
        q = F.sqrt(-2.0 * F.ln(prob))
        return polynomial(ACKLAM_C, q) / polynomial([*ACKLAM_D, 1.0], q)

    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < ACKLAM_TAIL, tail(p))
        .when(p > 1 - ACKLAM_TAIL, -tail(1 - p))
        .otherwise(middle)
    )


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * x)
    erf = 1.0 - t * polynomial(list(reversed(ERF_A)), t) * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def chi2_upper_tail_even(q: Column, df: int) -> Column:
    """P(X > q) for an even number of degrees of freedom (closed form)."""
    if df % 2:
        raise ValueError("closed form needs an even number of degrees of freedom")
    half = q / 2.0
    series = F.lit(1.0)
    term = F.lit(1.0)
    for i in range(1, df // 2):
        term = term * half / float(i)
        series = series + term
    return F.exp(-half) * series


def service_level_z(level: Column) -> Column:
    """Safety factor: the two conventional rounded values, else the quantile."""
    exact = normal_quantile(level)
    z = F
    for value, score in SERVICE_LEVEL_Z.items():
        z = z.when(level == value, F.lit(score))
    return z.otherwise(exact)
