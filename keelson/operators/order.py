"""Global order without a task that sees all rows: range partitions by sampled quantiles, counted, and numbered in place.

Rows of equal keys are told apart by a hash of the whole row and a random number, so a hot key is split among partitions like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.session import materialize

#: Bits of a row's place in its partition, in what monotonically_increasing_id gives.
_PLACE = 33


def in_order(rows: DataFrame, order: list[Column], parts: int | None = None, descending: bool = False) -> DataFrame:
    """Rows in range partitions of the order, sorted in each; written as files they follow one another. Nulls are first, or last in descending order."""
    keys = [*order, F.xxhash64(*rows.columns), F.rand(7)]
    named = rows.withColumns({f"__o{i}": k for i, k in enumerate(keys)})
    names = [f"__o{i}" for i in range(len(keys))]
    by = [F.desc(n) if descending else F.asc(n) for n in names]
    ranges = named.repartitionByRange(*by) if parts is None else named.repartitionByRange(parts, *by)
    return ranges.sortWithinPartitions(*by).drop(*names)


def numbered(rows: DataFrame, order: list[Column], parts: int | None = None, descending: bool = False) -> DataFrame:
    """Adds `position`, from 0 in order. Ties are broken somehow, but in the written rows for good."""
    placed = materialize(in_order(rows, order, parts, descending).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", _PLACE)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row a partition
    before = W.partitionBy().orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__id").bitwiseAND((1 << _PLACE) - 1)
    return placed.withColumn("__part", part).join(F.broadcast(firsts), "__part").withColumn("position", F.col("__before") + place).drop("__id", "__part", "__before")


def order_statistics(rows: DataFrame, value: str, places: dict[str, tuple[int, int]]) -> DataFrame:
    """One row: for each name and (k, of), the element at place n * k div of among the n values that aren't null, from 0 in ascending order.
    Values are counted by partition of their order; nothing but those counts and the elements sought is gathered."""
    positions = numbered(rows.where(F.col(value).isNotNull()).select(F.col(value).alias("x")), [F.col("x")])
    n = positions.agg(F.count("*").alias("n")).scalar()
    return positions.agg(*[F.max(F.when(F.col("position") == F.floor(n * k / of), F.col("x"))).alias(name) for name, (k, of) in places.items()])


def first_of(rows: DataFrame, order: list[Column], k: int, of: int = 1, descending: bool = False) -> DataFrame:
    """The first n * k div of of the n rows in order: as many as the table makes them, so they are numbered, not gathered by a limit."""
    positions = numbered(rows, order, descending=descending)
    n = positions.agg(F.count("*").alias("n")).scalar()
    return positions.where(F.col("position") < F.floor(n * k / of)).drop("position")
