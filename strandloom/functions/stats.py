"""Statistics as columns: tails of the gamma and chi-squared distributions, G, genotype fits, gamma estimates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LANCZOS = np.array(  # fixed values: coefficients of the Lanczos approximation, g = 7
    [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
)


def log_gamma(a: np.ndarray) -> np.ndarray:
    z = np.asarray(a, float) - 1
    total = _LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total)


def gamma_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised lower and upper incomplete gamma functions, each with its own relative accuracy.

    Below a + 1 the series gives the lower one, above the continued fraction the upper one. NaN where a is not
    positive or either is NaN; x below 0 counts as 0.
    """
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lower, upper = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    known = (a > 0) & ~np.isnan(x)
    zero, endless = known & (x <= 0), known & np.isposinf(x)
    lower[zero], upper[zero], lower[endless], upper[endless] = 0, 1, 1, 0
    known &= (x > 0) & np.isfinite(x)
    scale = np.zeros(a.shape)
    scale[known] = np.exp(a[known] * np.log(x[known]) - x[known] - log_gamma(a[known]))
    near, far = known & (x < a + 1), known & (x >= a + 1)
    if near.any():
        p, q = a[near], x[near]
        term = total = 1 / p
        n = p.copy()
        for _ in range(10_000):
            n = n + 1
            term = term * q / n
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-17).all():
                break
        lower[near] = total * scale[near]
        upper[near] = 1 - lower[near]
    if far.any():
        p, q = a[far], x[far]
        tiny = 1e-300
        b = q + 1 - p
        c, d = np.full(p.shape, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            k = -i * (i - p)
            b = b + 2
            d = k * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
            if (np.abs(step - 1) < 1e-16).all():
                break
        upper[far] = h * scale[far]
        lower[far] = 1 - upper[far]
    return lower, upper


@cache
def _tail(which: int):
    """A vectorised column function of (a, x): 0 the lower, 1 the upper incomplete gamma; null where it is not defined."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, x in batches:
            out = gamma_tails(a.to_numpy(float), x.to_numpy(float))[which]
            yield pd.Series(out).where(~np.isnan(out), None)

    return F.pandas_udf(run, "double")


def _lower(a: Column, x: Column) -> Column:
    return _tail(0)(a, x)


def _upper(a: Column, x: Column) -> Column:
    return _tail(1)(a, x)


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X >= x) for chi-squared with dof degrees of freedom; null where dof is not positive."""
    return _upper(dof.cast("double") / 2, x.cast("double") / 2)


def chi2_cdf(x: Column, dof: Column) -> Column:
    return _lower(dof.cast("double") / 2, x.cast("double") / 2)


def gamma_tail(x: Column, k: Column, theta: Column) -> Column:
    """P(X >= x) for a gamma distribution of shape k and scale theta; 1 for x of 0 or less."""
    return F.when(x <= 0, F.lit(1.0)).otherwise(_upper(k.cast("double"), F.try_divide(x.cast("double"), theta.cast("double"))))


def g_statistic(major: Column, minor: Column) -> Column:
    """2 sum(O ln(O / E)) of two counts against equal shares; a count of 0 adds nothing."""
    expected = (major + minor) / F.lit(2.0)
    term = lambda n: F.when(n > 0, n * F.ln(F.try_divide(n, expected))).otherwise(F.lit(0.0))
    return 2 * (term(major) + term(minor))


def gamma_shape(n: Column, x: Column, log_x: Column, x_log_x: Column) -> Column:
    """Bias-corrected closed-form shape from n, sum x, sum ln x, sum x ln x over x > 0; null for n <= 1 or equal x."""
    n = n.cast("double")
    k = F.try_divide(n * x, n * x_log_x - log_x * x)
    corrected = k - (3 * k - 2 / F.lit(3.0) * (k / (1 + k)) - 4 / F.lit(5.0) * (k / ((1 + k) * (1 + k)))) / n
    return F.when((n > 1) & (k > 0), corrected)


def gamma_scale(n: Column, x: Column, log_x: Column, x_log_x: Column) -> Column:
    """Bias-corrected closed-form scale from the same sums; null for n <= 1."""
    n = n.cast("double")
    return F.when(n > 1, (n * x_log_x - log_x * x) / (n * n) * F.try_divide(n, n - 1))


def _misfit(shares: Column, expected_top: list[float]) -> Column:
    n, top = F.size(shares), len(expected_top)
    rest = F.lit(0.05) / n
    expected = F.transform(shares, lambda _, i: F.coalesce(F.try_element_at(F.array(*map(F.lit, expected_top)), (i + 1).cast("int")), rest) if top > 1 else F.when(i == 0, F.lit(expected_top[0])).otherwise(rest))
    return F.aggregate(F.zip_with(shares, expected, lambda o, e: (o - e) * (o - e) / e), F.lit(0.0), lambda total, x: total + x)


def homozygous_fit(shares: Column) -> Column:
    """How badly descending shares fit one allele of 0.95 (chi-squared CDF, n - 1 degrees of freedom); 0 below two shares."""
    n = F.size(shares)
    return F.when(n < 2, F.lit(0.0)).otherwise(chi2_cdf(_misfit(shares, [0.95]), n - 1))


def heterozygous_fit(shares: Column) -> Column:
    """How badly descending shares fit two alleles of 0.475 each; 1 below two shares."""
    n = F.size(shares)
    return F.when(n < 2, F.lit(1.0)).otherwise(chi2_cdf(_misfit(shares, [0.475, 0.475]), n - 1))


def genotype(homozygous: Column, heterozygous: Column) -> tuple[Column, Column]:
    """The better of both fits, as its name and its value; heterozygous only if strictly better."""
    return F.when(heterozygous < homozygous, F.lit("het")).otherwise(F.lit("hom")), F.least(homozygous, heterozygous)
