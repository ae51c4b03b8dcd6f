"""Alignment of records: last write wins, relational division, pairs of runs, resolution by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one with the greatest (unique) order. max_by over a struct keeps it one partial aggregation."""
    packed = F.struct(F.col(order), *[F.col(c) for c in rows.columns if c not in (*keys, order)]).alias("x")
    return rows.groupBy(*keys).agg(F.max(packed).alias("x")).select(*[F.col(c) if c in keys else F.col(f"x.{c}") for c in rows.columns])


def having_all(rows: DataFrame, key: str, part: str, parts: list | None = None) -> DataFrame:
    """Keys that have every one of the parts (relational division), or every part that occurs where none are named."""
    if parts is not None:
        rows, wanted = rows.where(F.col(part).isin(parts)), F.lit(len(parts))
    else:
        wanted = rows.select(F.count_distinct(part)).scalar()
    return rows.groupBy(key).agg(F.count_distinct(part).alias("n")).where(F.col("n") == wanted).select(key)


def eligible(rows: DataFrame, key: str, failed: str) -> DataFrame:
    """Keys none of whose rows failed; a null isn't a failure."""
    return rows.groupBy(key).agg(F.bool_or(F.coalesce(F.col(failed), F.lit(False))).alias("any")).where(~F.col("any")).select(key)


def matrix(rows: DataFrame, key: str, part: str, parts: list, value: str) -> DataFrame:
    """One row a key with a column for each part, keys that lack one dropped."""
    return rows.groupBy(key).pivot(part, parts).agg(F.max(value)).dropna(subset=parts)


def unordered_pairs(rows: DataFrame, key: str, part: str, values: list[str]) -> DataFrame:
    """Each unordered pair of parts that a key has: key, a, b and the values of both."""
    left = rows.select(key, F.col(part).alias("a"), *[F.col(v).alias(f"{v}_a") for v in values])
    right = rows.select(key, F.col(part).alias("b"), *[F.col(v).alias(f"{v}_b") for v in values])
    return left.join(right, key).where(F.col("a") < F.col("b"))


def first_of(*found: Column) -> Column:
    """The first of the sources that has a value (label id zero is a value)."""
    return F.coalesce(*found)


def first_source(rows: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """The value of the source with the least priority number, by key."""
    order = W.partitionBy(key).orderBy(priority, value)
    return rows.where(F.col(value).isNotNull()).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def backfill_truth(records: DataFrame, ids: DataFrame) -> DataFrame:
    """records: truth_id, truth, top5_ids, top1, top5; ids: label, id (the least, if a label has several). A record without truth_id takes
    that of its label without brackets, else of the label as it is; zero is an id like any other. Only for records filled so, top1
    and top5 are computed anew; those that no label matches stay as they are."""
    known = ids.groupBy(F.lower(F.trim("label")).alias("key")).agg(F.min("id").alias("id"))
    text = F.lower(F.trim(F.coalesce("truth", F.lit(""))))
    found = records.withColumns({"__bare": F.when(F.col("truth_id").isNull(), F.trim(F.translate(text, "[]", ""))), "__whole": F.when(F.col("truth_id").isNull(), text)})
    for key in ("__bare", "__whole"):
        found = found.join(known.select(F.col("key").alias(key), F.col("id").alias(f"{key}_id")), key, "left")
    found = found.withColumn("__id", F.coalesce("__bare_id", "__whole_id"))
    new = F.col("__id").isNotNull()
    answers = F.coalesce("top5_ids", F.array())
    filled = {"truth_id": F.coalesce("truth_id", "__id"), "top1": F.when(new, F.coalesce(F.get(answers, F.lit(0)) == F.col("__id"), F.lit(False))).otherwise(F.col("top1")), "top5": F.when(new, F.array_contains(answers, F.col("__id"))).otherwise(F.col("top5"))}
    return found.withColumns(filled).select(*records.columns)
