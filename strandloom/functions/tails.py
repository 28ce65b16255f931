"""Tails of distributions and corrected p-values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def poisson_cdf_value(q: float, mean: float) -> float:
    """P(Poisson(mean) <= floor(q)), summed upwards from the smallest term in logarithms."""
    if mean <= 0:
        return 1.0
    k = np.arange(0, int(math.floor(q)) + 1)
    terms = k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])
    return float(min(1.0, np.exp(terms).sum()))


def poisson_quantile_value(p: float, mean: float) -> int:
    """The smallest k with P(Poisson(mean) <= k) >= p."""
    if mean > 700:  # exp(-mean) is near the smallest number
        return _large_mean_quantile(p, mean)
    term = total = math.exp(-mean)
    k = 0
    while total < p * (1 - 64 * 2.3e-16) and term > 0:
        k += 1
        term *= mean / k
        total += term
    return k


def _large_mean_quantile(p: float, mean: float) -> int:
    """Terms within 40 standard deviations of the mean, relative to the largest; what lies outside
    is below the smallest number."""
    reach = int(40 * math.sqrt(mean)) + 40
    low = max(0, int(mean) - reach)
    k = np.arange(low + 1, int(mean) + reach + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / k))])
    terms = np.exp(logs - logs.max())
    total = np.cumsum(terms)
    return low + int(min(np.searchsorted(total / total[-1], p * (1 - 64 * 2.3e-16)), len(terms) - 1))


def _each_once(f, first: pd.Series, second: pd.Series) -> pd.Series:
    """``f`` of each pair, worked out once for equal pairs: counts repeat a lot."""
    known: dict[tuple, float] = {}
    return pd.Series([known[k] if (k := (a, b)) in known else known.setdefault(k, f(a, b)) for a, b in zip(first, second)])


@F.pandas_udf(T.DoubleType())
def poisson_cdf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for q, mean in parts:
        yield _each_once(poisson_cdf_value, q, mean)


@F.pandas_udf(T.LongType())
def poisson_quantile(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for p, mean in parts:
        yield _each_once(poisson_quantile_value, p, mean)


def benjamini_hochberg(df: DataFrame, group: list[str], p: str, n: str | Column, out: str = "q") -> DataFrame:
    """``df`` with corrected p-values: the least n / rank * p of the value itself and larger ones,
    at most 1."""
    asc = Window.partitionBy(*group).orderBy(p)
    ranked = df.withColumn("__rk", F.row_number().over(asc))
    desc = Window.partitionBy(*group).orderBy(F.desc(p), F.desc("__rk")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col(n) if isinstance(n, str) else n
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(total / F.col("__rk") * F.col(p)).over(desc))).drop("__rk")
