"""Agreement of two raters over a video's segments, and of many over videos. Undefined statistics are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pearson(a: Column, b: Column) -> Column:
    """Null with fewer than two rows or no variance."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(value: str, by: list[str]) -> Column:
    part = W.partitionBy(*by)
    return F.rank().over(part.orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def spearman(rows: DataFrame, by: list[str], a: str, b: str, ties: str = "average", order: str = "idx") -> DataFrame:
    """ties: average ranks, or ordinal ones by `order`."""
    if ties == "average":
        ra, rb = average_rank(a, by), average_rank(b, by)
    else:
        part = W.partitionBy(*by)
        ra, rb = F.row_number().over(part.orderBy(a, order)), F.row_number().over(part.orderBy(b, order))
    ranked = rows.select(*by, ra.cast("double").alias("ra"), rb.cast("double").alias("rb"))
    return ranked.groupBy(*by).agg(pearson(F.col("ra"), F.col("rb")).alias("rho"))


def kendall(rows: DataFrame, key: str, a: str, b: str, order: str = "idx") -> DataFrame:
    """Tau-b by counting pairs inside each key (a video's own segments)."""
    item = F.struct(F.col(order).alias("i"), F.col(a).alias("a"), F.col(b).alias("b"))
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("s"))
    count = lambda test: F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.size(F.filter("s", lambda y: (y["i"] > x["i"]) & test(x, y))))
    sign = lambda x, y: F.signum(x["a"] - y["a"]) * F.signum(x["b"] - y["b"])
    counted = by.select(key, F.size("s").alias("n"), count(lambda x, y: sign(x, y) > 0).alias("c"), count(lambda x, y: sign(x, y) < 0).alias("d"), count(lambda x, y: x["a"] == y["a"]).alias("ta"), count(lambda x, y: x["b"] == y["b"]).alias("tb"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return counted.select(key, F.try_divide(F.col("c") - F.col("d"), F.sqrt((pairs - F.col("ta")) * (pairs - F.col("tb")))).alias("tau"))


def jaccard(a: Column, b: Column, empty: float | None) -> Column:
    """Of two arrays as sets; `empty` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def set_f1(a: Column, b: Column) -> Column:
    """1 if both are empty, 0 if one is."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1)))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two booleans; null where chance agreement is 1."""
    pa, pb, po = F.avg(a.cast("double")), F.avg(b.cast("double")), F.avg((a == b).cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(pe < 1 - 1e-9, F.try_divide(po - pe, 1 - pe))
