"""Integrity gates: counts, rates, parity of metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(rows: DataFrame, by: str, hit: Column, expected: float, within: float) -> DataFrame:
    share = F.count_if(hit) / F.count("*")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(share, 9).alias("rate"), (F.abs(share - expected) <= within).alias("passed"))


def equal_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: each table's count, and whether all are equal."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    one = reduce(lambda a, b: a.join(b), counts)  # one row each
    first, *rest = tables
    return one.withColumn("passed", reduce(lambda a, b: a & b, [F.col(first) == F.col(x) for x in rest], F.lit(True)))


def parity(rows: DataFrame, by: list[str], keys: dict[str, str]) -> DataFrame:
    """Whether a key has more than one value, nulls ignored. min and max decide it in one partial aggregation."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias(name) for name, c in keys.items()])
