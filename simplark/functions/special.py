"""Tails of distributions as SQL text, for any engine, and as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Chebyshev fit to erfc (relative error 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc_sql(z: str) -> str:
    """erfc(z) for z >= 0."""
    t = f"(1.0 / (1.0 + 0.5 * ({z})))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-({z}) * ({z}) + {poly}))"


def two_sided_sql(z: str) -> str:
    """Two-sided normal p of |z|."""
    return f"least(1.0, {erfc_sql(f'(abs({z}) / sqrt(2.0))')})"


def upper_sql(z: str) -> str:
    """P(Z >= z)."""
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * {erfc_sql(f'(abs({z}) / sqrt(2.0))')} ELSE 1.0 - 0.5 * {erfc_sql(f'(abs({z}) / sqrt(2.0))')} END)"


def kolmogorov_sql(d: str, n1: str, n2: str, terms: int = 20) -> str:
    """Asymptotic two-sample Kolmogorov-Smirnov p of the gap d."""
    x = f"({d} * sqrt(CAST({n1} AS DOUBLE) * {n2} / ({n1} + {n2})))"
    series = " + ".join(f"{'-' if k % 2 == 0 else ''}2.0 * exp(-2.0 * {k * k} * {x} * {x})" for k in range(1, terms + 1))
    return f"(CASE WHEN {x} < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, {series})) END)"


def log_factorial(n: Column) -> Column:
    """ln(n!), by the sum below 32 and Stirling's series from there on (error under 1e-13)."""
    small = F.lit([math.lgamma(k + 1) for k in range(32)])
    x = n.cast("double") + 1
    big = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 32, F.get(small, n.cast("int"))).otherwise(big)


def hypergeometric_tail(observed: Column, row: Column, column: Column, total: Column) -> Column:
    """P(X >= observed), X the marked among ``row`` drawn of ``total`` with ``column`` marked."""

    @F.pandas_udf("double")
    def tail(observed: pd.Series, row: pd.Series, column: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_upper(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(observed, row, column, total, strict=True)])

    return tail(observed.cast("long"), row.cast("long"), column.cast("long"), total.cast("long"))


def hypergeometric_upper(observed: int, row: int, column: int, total: int) -> float:
    """The tail from the observed value, term by term from the larger side of the mode until terms vanish: no array, however large the groups."""
    low, high = max(0, row + column - total), min(row, column)
    if observed <= low:
        return 1.0
    if observed > high:
        return 0.0
    lf = lambda n: math.lgamma(n + 1)
    at = lambda j: math.exp(lf(row) + lf(total - row) + lf(column) + lf(total - column) - lf(total) - lf(j) - lf(row - j) - lf(column - j) - lf(total - row - column + j))
    mode = (row + 1) * (column + 1) // (total + 2)
    up = observed > mode  # terms fall from here on; else one minus the other side
    j = observed if up else observed - 1
    sum_, term = 0.0, at(j)
    while low <= j <= high and term > sum_ * 1e-17 and term > 0:
        sum_ += term
        if up:
            term *= (row - j) * (column - j) / ((j + 1) * (total - row - column + j + 1))
            j += 1
        else:
            term *= j * (total - row - column + j) / ((row - j + 1) * (column - j + 1))
            j -= 1
    return min(1.0, sum_) if up else max(0.0, 1.0 - sum_)


def conditional_odds(observed: Column, row: Column, column: Column, total: Column, level: float = 0.95) -> Column:
    """(estimate, lower, upper) of the odds ratio of a 2 x 2 table, given its margins."""

    @F.pandas_udf("struct<estimate: double, lower: double, upper: double>")
    def odds(observed: pd.Series, row: pd.Series, column: pd.Series, total: pd.Series) -> pd.DataFrame:
        made = [fisher_odds(int(a), int(b), int(c), int(d), level) for a, b, c, d in zip(observed, row, column, total, strict=True)]
        return pd.DataFrame(made, columns=["estimate", "lower", "upper"])

    return odds(observed.cast("long"), row.cast("long"), column.cast("long"), total.cast("long"))


def fisher_odds(observed: int, row: int, column: int, total: int, level: float = 0.95) -> tuple[float, float, float]:
    """The conditional maximum-likelihood odds ratio and its exact interval.

    Counts under an odds ratio have weights C(row, j) C(total - row, column - j) ratio^j; those within forty
    standard deviations of the most likely count are summed, so large groups cost no more than small ones.
    """
    low, high = max(0, row + column - total), min(row, column)
    if observed in (row, column):
        return math.inf, math.nan, math.nan

    def at(log_ratio: float) -> tuple[np.ndarray, np.ndarray]:
        # The mode solves a quadratic: (row - j)(column - j) ratio = j (total - row - column + j).
        r = math.exp(log_ratio)
        a, b, c = r - 1, -(r * (row + column) + total - row - column), r * row * column
        mode = c / -b if abs(a) < 1e-12 else 2 * c / (-b + math.sqrt(max(0.0, b * b - 4 * a * c)))
        spread = math.sqrt(1 / sum(1 / max(x, 0.5) for x in (mode, row - mode, column - mode, total - row - column + mode)))
        j = np.arange(max(low, int(mode - 40 * spread) - 2), min(high, int(mode + 40 * spread) + 2) + 1)
        steps = np.log((row - j[:-1]) * (column - j[:-1]).astype(float)) - np.log((j[:-1] + 1) * (total - row - column + j[:-1] + 1).astype(float)) + log_ratio
        logs = np.concatenate(([0.0], np.cumsum(steps)))
        p = np.exp(logs - logs.max())
        return j, p / p.sum()

    def solve(f) -> float:
        a, b = -60.0, 60.0
        for _ in range(80):
            m = (a + b) / 2
            a, b = (m, b) if f(m) < 0 else (a, m)
        return math.exp((a + b) / 2)

    tail = (1 - level) / 2
    above = lambda x: (lambda j, p: p[j >= observed].sum())(*at(x)) - tail
    below = lambda x: tail - (lambda j, p: p[j <= observed].sum())(*at(x))
    mean = lambda x: (lambda j, p: (j * p).sum())(*at(x)) - observed
    estimate = 0.0 if observed == low else solve(mean)
    return estimate, 0.0 if observed == low else solve(above), solve(below)


def student_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    x = df / (df + t * t)
    return incomplete_beta(df / 2, 0.5, x)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)
