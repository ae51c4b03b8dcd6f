"""Paired experiments: McNemar tests, step-down corrections, strata, heterogeneity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators.order import order_statistics


def mcnemar_counts(a: Column, b: Column) -> tuple[Column, Column]:
    return F.count_if(a & ~b).alias("b10"), F.count_if(~a & b).alias("b01")


def mcnemar_chi2(b10: Column, b01: Column) -> Column:
    """With continuity correction, not clamped; 0 without discordant pairs."""
    gap = F.abs(b10 - b01) - 1
    return F.coalesce(F.try_divide(gap * gap, b10 + b01), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series) -> pd.Series:
    """Survival of chi-squared with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)))


@F.pandas_udf(T.DoubleType())
def binomial_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided McNemar: twice the lower tail of a fair binomial, 1 at most."""

    def p(x: int, y: int) -> float:
        n, k = int(x + y), int(min(x, y))
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs))) if n else 1.0

    return pd.Series([p(x, y) for x, y in zip(b, c, strict=True)], dtype="float64")


def holm(tests: DataFrame, p: str, name: str, alpha: float, family: list[str]) -> DataFrame:
    """Step-down by (p, name): threshold alpha/(N-k), strict, and the first failure stops all that follow."""
    by = W.partitionBy(*family)
    order = by.orderBy(p, name)
    ranked = tests.withColumn("threshold", alpha / (F.count("*").over(by) - F.row_number().over(order) + 1))
    return ranked.withColumn("rejected", F.bool_and(F.col(p) < F.col("threshold")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def index_edges(rows: DataFrame, value: str, parts: int) -> DataFrame:
    """One row: edges sorted[n * i div parts], i from 1 to parts - 1."""
    return order_statistics(rows, value, {f"edge{k}": (k, parts) for k in range(1, parts)})


def stratum(value: Column, edges: list[Column], names: list[str]) -> Column:
    """The name of the stratum that a value falls into: below the first edge, below the second, and so on; unknown without a value."""
    found = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        found = F.when(value < edge, name).otherwise(found)
    return F.when(value.isNull(), "unknown").otherwise(found)


def index_strata(rows: DataFrame, value: str, names: list[str]) -> Column:
    """Strata of about as many rows each, by index edges of the values that aren't null; all are unknown where there is none."""
    edges = index_edges(rows, value, len(names))
    return stratum(F.col(value), [edges.select(c).scalar() for c in edges.columns], names)


def cochran_q(rows: DataFrame, effect: str, variance: str) -> DataFrame:
    """Heterogeneity with inverse-variance weights (variance floored at 1e-12)."""
    w = 1 / F.greatest(F.col(variance), F.lit(1e-12))
    s = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col(effect)).alias("wx"), F.sum(w * F.col(effect) * F.col(effect)).alias("wxx"), F.count("*").alias("n"))
    return s.select((F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")).alias("q"), (F.col("n") - 1).alias("df"))


def variance_from_interval(low: Column, high: Column) -> Column:
    width = (high - low) / 3.92
    return F.greatest(width * width, F.lit(1e-12))
