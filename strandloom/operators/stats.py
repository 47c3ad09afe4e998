"""Divergences, gamma fits and multiple testing on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.stats import gamma_scale, gamma_shape
from strandloom.operators.ordered import numbered


def shares(df: DataFrame, n: str, by: list[str], out: str = "p") -> DataFrame:
    """df with the share of n in its group; null in a group that sums to 0."""
    return df.withColumn(out, F.try_divide(F.col(n), F.sum(n).over(Window.partitionBy(*by))))


def kl_divergence(df: DataFrame, p: str, q: str, by: list[str]) -> DataFrame:
    """by, kld: sum of p ln(p / q) of each group; a p of 0 adds nothing."""
    return df.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(p) > 0, F.col(p) * F.ln(F.col(p) / F.col(q)))), F.lit(0.0)).alias("kld"))


def gamma_sums(x: str) -> list[Column]:
    """Sufficient statistics over x > 0: gamma_n, sum x, sum ln x, sum x ln x."""
    v = F.when(F.col(x) > 0, F.col(x))
    return [F.count(v).alias("gamma_n"), F.sum(v).alias("_x"), F.sum(F.ln(v)).alias("_lx"), F.sum(v * F.ln(v)).alias("_xlx")]


def gamma_fit(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """by, gamma_n, k, theta: bias-corrected closed-form fit of each group; null with fewer than two values."""
    sums = [F.col(c) for c in ("gamma_n", "_x", "_lx", "_xlx")]
    grouped = df.groupBy(*by).agg(*gamma_sums(x)) if by else df.agg(*gamma_sums(x))
    return grouped.select(*by, "gamma_n", gamma_shape(*sums).alias("k"), gamma_scale(*sums).alias("theta"))


def bh_threshold(df: DataFrame, p: str, q: float, mode: str = "zero_based", tie: str | None = None) -> DataFrame:
    """df with threshold for each p-value.

    ``zero_based``: rank / N * q with ranks from 0, compared value by value. ``standard``: the step-up procedure:
    the largest (rank + 1) / N * q that its p-value stays below is the threshold of all. Rows are ranked range by range
    (``ordered.numbered``), so no task holds more of them than another; equal p-values are told apart by tie, or anyhow.
    """
    if mode not in ("zero_based", "standard"):
        raise ValueError(f"mode {mode}")
    ranks = numbered(df, p, tie if tie else F.xxhash64(*df.columns), out="_rank")
    n = df.agg(F.count("*").alias("_n"))  # one row
    own = ranks.crossJoin(F.broadcast(n)).withColumn("threshold", (F.col("_rank") - (1 if mode == "zero_based" else 0)) / F.col("_n") * F.lit(q))
    if mode == "standard":
        most = own.agg(F.max(F.when(F.col(p) <= F.col("threshold"), F.col("threshold"))).alias("_most"))  # one row
        own = own.crossJoin(F.broadcast(most)).withColumn("threshold", F.col("_most"))
    return own.select(*df.columns, "threshold")


def summary(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """by, n, total, mean, var, sd (of the population)."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.stddev_pop(x).alias("sd"))


def median(df: DataFrame, x: str, by: list[str], exact: bool = True) -> DataFrame:
    """by, median: exact, or within the accuracy of percentile_approx."""
    return df.groupBy(*by).agg((F.median(x) if exact else F.percentile_approx(x, 0.5)).alias("median"))
