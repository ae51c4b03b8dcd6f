"""Coverage, concentration and curve measures over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def kept_ratio(segments: DataFrame) -> DataFrame:
    """Duration of important segments over the end of the last; null for a video of no length."""
    kept = F.coalesce(F.sum(F.when(F.col("label") == "important", F.col("dur"))), F.lit(0.0))
    return segments.groupBy("video_id").agg(F.try_divide(kept, F.max("end_s")).alias("kept_ratio"))


def gini(rows: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """Gini coefficient by key; negatives dropped, 0 where the total is 0."""
    by = W.partitionBy(key)
    ranked = rows.where(F.col(value) >= 0).select(key, F.col(value).alias("x"), F.row_number().over(by.orderBy(value, tie)).alias("i"), F.count("*").over(by).alias("n"))
    total = F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("x"))
    return ranked.groupBy(key).agg(F.coalesce(F.try_divide(total, F.max("n") * F.sum("x")), F.lit(0.0)).alias("gini"))


def temporal(segments: DataFrame) -> DataFrame:
    """Range, coverage, centre of mass and mean gap (overlaps count 0) of the important segments."""
    by = W.partitionBy("video_id")
    gap = F.greatest(F.lead("start_s").over(by.orderBy("idx")) - F.col("end_s"), F.lit(0.0))
    kept = segments.withColumn("total", F.max("end_s").over(by)).where(F.col("label") == "important")
    # greatest skips nulls: the last segment has no gap
    kept = kept.withColumn("gap", F.when(F.lead("start_s").over(by.orderBy("idx")).isNotNull(), gap))
    centre = F.sum(F.col("dur") * (F.col("start_s") + F.col("end_s")) / 2) / F.sum("dur") / F.max("total")
    return kept.groupBy("video_id").agg(
        F.round(F.max("end_s") - F.min("start_s"), 6).alias("range_s"), F.round(F.sum("dur") / F.max("total"), 6).alias("coverage_ratio"),
        F.round(centre, 6).alias("com_position"), F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 6).alias("mean_gap"), F.count("*").alias("n"),
    )


def timeline(segments: DataFrame, bins: int) -> DataFrame:
    """Covered time by equal bins of a video. Each segment makes `bins` rows; no join."""
    total = F.max("end_s").over(W.partitionBy("video_id"))
    rows = segments.withColumn("total", total).where(F.col("label") == "important").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    overlap = F.least("end_s", (F.col("bin") + 1) * F.col("total") / bins) - F.greatest("start_s", F.col("bin") * F.col("total") / bins)
    return rows.groupBy("video_id", "bin").agg(F.round(F.sum(F.greatest(F.lit(0.0), overlap)), 6).alias("covered"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal bins, the last closed on the right."""
    inside = rows.where(F.col(value).between(low, high))
    return inside.groupBy(F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def locate(points: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment each point (video_id, t) lies in, both ends closed, the first on a boundary. An equi-join by video; the range is its condition."""
    s = segments.select(F.col("video_id").alias("v"), "idx", "start_s", "end_s")
    met = points.join(s, (F.col("video_id") == F.col("v")) & F.col("t").between(F.col("start_s"), F.col("end_s")))
    return met.groupBy("video_id", "t").agg(F.min("idx").alias("idx"))


def mean_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean weight at a video's points, 0 outside of segments."""
    s = segments.select(F.col("video_id").alias("v"), "idx", "start_s", "end_s", "weight")
    met = points.join(s, (F.col("video_id") == F.col("v")) & F.col("t").between(F.col("start_s"), F.col("end_s")), "left")
    first = met.groupBy("video_id", "t").agg(F.min(F.struct(F.col("idx"), F.col("weight"))).alias("x"))
    return first.groupBy("video_id").agg(F.round(F.avg(F.coalesce("x.weight", F.lit(0.0))), 9).alias("importance"))


def trapezoid(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area under the curve by the trapezoid rule over ordered x; null with fewer than two points."""
    order = W.partitionBy(*keys).orderBy(x)
    area = (F.col(x) - F.lag(x).over(order)) * (F.col(y) + F.lag(y).over(order)) / 2
    return rows.withColumn("area", area).groupBy(*keys).agg(F.sum("area").alias("auc"))


def complete_curves(points: DataFrame, full: DataFrame, classes: int) -> DataFrame:
    """points: video_id, ordering, fraction, failed, top1, top5; full: video_id, top1, top5. Curves of those videos and orderings that have no
    failed point, every fraction that any video has in that ordering, and a full record, with their ends: chance at 0, the full record at 1."""
    hit = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").cast("double").alias(c)
    failed = F.coalesce(F.col("failed"), F.lit(False))
    grid = points.where(~failed).groupBy("ordering").agg(F.count_distinct("fraction").alias("all"))
    whole = points.groupBy("video_id", "ordering").agg(F.bool_or(failed).alias("bad"), F.count_distinct("fraction").alias("own"))
    whole = whole.where(~F.col("bad")).join(F.broadcast(grid), "ordering").where(F.col("own") == F.col("all")).select("video_id", "ordering")  # a row an ordering
    ends = whole.join(full.select("video_id", hit("top1"), hit("top5")), "video_id")
    inner = points.join(ends.select("video_id", "ordering"), ["video_id", "ordering"]).select("video_id", "ordering", "fraction", hit("top1"), hit("top5"))
    chance = ends.select("video_id", "ordering", F.lit(0.0).alias("fraction"), F.lit(min(1.0, 1 / classes)).alias("top1"), F.lit(min(1.0, 5 / classes)).alias("top5"))
    return inner.unionByName(chance).unionByName(ends.select("video_id", "ordering", F.lit(1.0).alias("fraction"), "top1", "top5"))
