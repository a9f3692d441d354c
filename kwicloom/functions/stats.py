"""Association measures as columns, and Clopper-Pearson bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def association(o: Column, e: Column) -> dict[str, Column]:
    """The measures of observed against expected frequency, with infinities where expected is 0."""
    both = (o > 0) & (e > 0)
    mi = F.when(both, F.log2(o / F.nullif(e, F.lit(0.0)))).otherwise(0.0)
    mi3 = F.when(both, F.log2(F.pow(o, F.lit(3)) / F.nullif(e, F.lit(0.0)))).otherwise(0.0)
    local = o * mi
    diff = o - e
    signed_inf = F.when(diff > 0, F.lit(INF)).when(diff < 0, F.lit(-INF)).otherwise(0.0)
    return {
        "MI": mi,
        "MI3": mi3,
        "local_MI": local,
        "log_local_MI": F.signum(local) * F.log1p(F.abs(local)),
        "z_score": F.when(e > 0, diff / F.sqrt(F.nullif(e, F.lit(0.0)))).otherwise(signed_inf),
        "t_score": F.when(o > 0, diff / F.sqrt(F.nullif(o, F.lit(0.0)))).otherwise(signed_inf),
        "simple_ll": 2 * (F.when(both, o * F.ln(o / F.nullif(e, F.lit(0.0)))).otherwise(0.0) - diff),
    }


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def beta_quantile(p: float, a: float, b: float) -> float:
    """The ``p`` quantile of the beta distribution, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if incomplete_beta(a, b, mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def conservative_log_ratio(f1: int, f2: int, n1: int, n2: int, alpha: float = 0.05) -> float:
    """The bound of the log2 ratio nearest 0 by the Clopper-Pearson interval of f1 in f1 + f2, at ``alpha / (f1 + f2)``; 0 inside it."""
    if f1 + f2 == 0:
        return 0.0
    level = alpha / (f1 + f2) / 2
    if n1 > 0 and n2 > 0:
        # the interval holds equal shares, as for most words, if neither tail beyond them is as small as the level
        even, least = n1 / (n1 + n2), level * (1 + 1e-6) + 1e-13
        if (not f1 or incomplete_beta(f1, f2 + 1, even) > least) and (not f2 or incomplete_beta(f2, f1 + 1, 1 - even) > least):
            return 0.0
    low = beta_quantile(level, f1, f2 + 1) if f1 else 0.0
    high = beta_quantile(1 - level, f1 + 1, f2) if f2 else 1.0

    def log_ratio(p: float, edge: float) -> float:
        if 0 < p < 1 and n1 > 0 and n2 > 0:
            return math.log2(n2 * p / (n1 * (1 - p)))
        return -INF if p == edge == 0 or (edge == 1 and p != 1) else INF

    lower, upper = log_ratio(low, 0), log_ratio(high, 1)
    if lower <= 0 <= upper:
        return 0.0
    return lower if (f1 / n1 if n1 else 0.0) > (f2 / n2 if n2 else 0.0) else upper
