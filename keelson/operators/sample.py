"""Sampling by hash order: the same rows in every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def cap_by_class(rows: DataFrame, cls: str, key: str, cap: int, seed: int) -> DataFrame:
    """At most cap rows of each class, in hash order."""
    order = W.partitionBy(cls).orderBy(hash_order(seed, key), key)
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= cap).drop("__k")


def proportional(rows: DataFrame, cls: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows by class share: floors, then the largest remainders (larger class, then name, on ties)."""
    counts = rows.groupBy(cls).agg(F.count("*").alias("size"))
    all_ = W.partitionBy()
    quota = counts.withColumn("exact", F.lit(n) * F.col("size") / F.sum("size").over(all_)).withColumn("base", F.floor("exact"))
    place = F.row_number().over(all_.orderBy((F.col("exact") - F.col("base")).desc(), F.col("size").desc(), cls))
    quota = quota.withColumn("quota", F.col("base") + (place <= F.lit(n) - F.sum("base").over(all_)).cast("int")).select(F.col(cls).alias("__c"), "quota")
    order = W.partitionBy(cls).orderBy(hash_order(seed, key), key)
    return rows.withColumn("__k", F.row_number().over(order)).join(quota, F.col(cls) == F.col("__c")).where(F.col("__k") <= F.col("quota")).drop("__k", "__c", "quota")


def one_per_class_then_fill(rows: DataFrame, cls: str, key: str, n: int, seed: int) -> DataFrame:
    """A class-diverse pick: first of every class in hash order, then seconds, and so on."""
    h = hash_order(seed, key)
    ranked = rows.withColumn("__h", h).withColumn("__k", F.row_number().over(W.partitionBy(cls).orderBy("__h", key)))
    return ranked.where(F.col("__k") <= n).orderBy("__k", "__h", key).limit(n).drop("__h", "__k")


def exactly(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement (the distribution of a reservoir)."""
    return rows.orderBy(hash_order(seed, key), key).limit(n)


def split(rows: DataFrame, cls: str, key: str, share: float, seed: int) -> DataFrame:
    """Stratified split: `part` is val for round(n * share) rows of a class, halves to even, one at least where it has more than one."""
    n = F.count("*").over(W.partitionBy(cls))
    held = F.when(n > 1, F.greatest(F.lit(1), F.rint(n * share).cast("int"))).otherwise(0)
    k = F.row_number().over(W.partitionBy(cls).orderBy(hash_order(seed, key), key))
    return rows.withColumn("part", F.when(k <= held, "val").otherwise("train"))


def bernoulli(rows: DataFrame, group: str, key: str, share: float, least: int, most: int, seed: int) -> DataFrame:
    """About a share of each group by hash, at least `least` and at most `most` rows."""
    h = hash_order(seed, key)
    ranked = rows.withColumn("__h", h).withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy("__h", key)))
    hit = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    return ranked.where((hit | (F.col("__k") <= least)) & (F.col("__k") <= most)).drop("__h", "__k")
