"""Segment selection under a budget. Inputs have video_id, idx, start_s, end_s, dur, weight, label; results are the segments kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

def by_video() -> WindowSpec:
    return W.partitionBy("video_id")


def important(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("label") == "important")


def threshold(segments: DataFrame, least: float, weight: str = "weight", default: float = 0.0) -> DataFrame:
    """Segments of at least the weight; a video without any has no rows."""
    return segments.where(F.coalesce(F.col(weight), F.lit(default)) >= least)


def threshold_or_best(segments: DataFrame, least: float, weight: str = "weight") -> DataFrame:
    """As threshold, but a video without any keeps its heaviest segment, the first on ties."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    ranked = segments.withColumn("hits", F.sum((w >= least).cast("int")).over(by_video())).withColumn("best", F.row_number().over(by_video().orderBy(w.desc(), "idx")))
    return ranked.where((w >= least) | ((F.col("hits") == 0) & (F.col("best") == 1))).drop("hits", "best")


def lowest_evidence(segments: DataFrame, weight: str = "weight") -> DataFrame:
    """As many of the lightest segments as are important, one at least."""
    n = F.greatest(F.sum((F.col("label") == "important").cast("int")).over(by_video()), F.lit(1))
    ranked = segments.withColumn("n", n).withColumn("k", F.row_number().over(by_video().orderBy(F.coalesce(F.col(weight), F.lit(0.0)), "idx")))
    return ranked.where(F.col("k") <= F.col("n")).drop("n", "k")


def fast_forward(segments: DataFrame, alpha: float, inverted: bool = False) -> DataFrame:
    """All segments, with playing time as `played`: whole if important (inverted: if not), else a share alpha."""
    kept = (F.col("label") == "important") != F.lit(inverted)
    return segments.withColumn("played", F.greatest(F.col("dur"), F.lit(0.0)) * F.when(kept, 1.0).otherwise(alpha))


def until_share(segments: DataFrame, share: float, order: list[Column]) -> DataFrame:
    """In the order, segments while the duration before them is under the share of the total; one at least."""
    order = [*order, F.col("idx")]
    before = F.coalesce(F.sum("dur").over(by_video().orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranked = segments.withColumn("before", before).withColumn("total", F.sum("dur").over(by_video())).withColumn("k", F.row_number().over(by_video().orderBy(*order)))
    return ranked.where((F.col("before") < share * F.col("total")) | (F.col("k") == 1)).drop("before", "total", "k")


def evenly_spaced(segments: DataFrame, count: Column) -> DataFrame:
    """count segments spread over the whole video, halves to even; one (or none asked): the centre."""
    sized = segments.withColumn("n", F.count("*").over(by_video()).cast("int")).withColumn("want", count.cast("int"))
    picks = F.when(F.col("want") <= 1, F.array((F.col("n") / 2).cast("int"))).when(F.col("want") >= F.col("n"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("want"), F.lit(2)) - 1), lambda i: F.rint(i * (F.col("n") - 1) / (F.greatest(F.col("want"), F.lit(2)) - 1)).cast("int"))
    )
    return sized.where(F.array_contains(picks, F.col("idx"))).drop("n", "want")


def tolerance(durations: Column) -> Column:
    """Half the upper median duration, 0.05 at least."""
    return F.greatest(F.lit(0.05), 0.5 * F.element_at(F.array_sort(durations), (F.size(durations) / 2).cast("int") + 1))
