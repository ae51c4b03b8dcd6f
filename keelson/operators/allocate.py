"""Allocation of frames and clips: segmentation, apportionment, quantile starts, bin packing."""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.text import let


def fixed_segments(videos: DataFrame, duration: str, step: float) -> DataFrame:
    """Segments of `step` seconds, the last cut; none for a video of no length."""
    n = F.ceil(F.col(duration) / step).cast("int")
    idx = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    rows = videos.withColumn("idx", idx)
    return rows.select("video_id", "idx", (F.col("idx") * step).alias("start_s"), F.least((F.col("idx") + 1) * F.lit(step), F.col(duration)).alias("end_s"))


def frame_range(start: Column, end: Column, fps: float) -> tuple[Column, Column]:
    """Truncated frame numbers."""
    return (start * fps).cast("int").alias("first"), (end * fps).cast("int").alias("last")


def spread(size: Column, n: int) -> Column:
    """n places from 0 to size - 1 at even distances, rounded half to even; places repeat where there are fewer."""
    step = (size - 1) / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * step).cast("int"))


# How a recogniser is shown a selection.
PROTOCOLS = ("repack", "mask", "sparse")


def protocol_frames(kept: Column, total: Column, fps: Column, n: int, protocol: Column) -> Column:
    """frames and blank: n frames for a recogniser under a protocol. kept is an array of (start_s, end_s), or null for the whole video. repack spreads
    them over the kept frames, mask over all and blanks those that aren't kept; sparse is repack. The whole video is spread over
    for a null selection, and by repack for an empty one. Null for an unknown protocol or a video without frames."""
    last = total - 1
    first_frame = lambda s: F.greatest(F.lit(0), F.rint(s["start_s"] * fps).cast("int"))
    last_frame = lambda s: F.least(last, F.rint(s["end_s"] * fps).cast("int"))
    ranges = F.transform(kept, lambda s: F.when(first_frame(s) <= last_frame(s), F.sequence(first_frame(s), last_frame(s))).otherwise(F.array().cast("array<int>")))

    def shown(pool: Column) -> Column:
        whole, none = spread(total, n), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.lit(False))
        packed = F.transform(spread(F.size(pool), n), lambda i: F.get(pool, i))
        masked = F.struct(whole.alias("frames"), F.transform(whole, lambda i: ~F.array_contains(pool, i)).alias("blank"))
        repacked = F.struct(F.when(F.size(pool) > 0, packed).otherwise(whole).alias("frames"), none.alias("blank"))
        chosen = F.when(pool.isNull(), F.struct(whole.alias("frames"), none.alias("blank"))).when(protocol == "mask", masked).otherwise(repacked)
        return F.when((total > 0) & protocol.isin(*PROTOCOLS), chosen)

    return let(F.array_sort(F.array_distinct(F.flatten(ranges))), shown)


# How segments are masked.
MASKS = ("blur", "freeze", "black", "mean", "cut")


def masked(frames: DataFrame, key: str, frame: str, hidden: str, mode: str) -> DataFrame:
    """frames: a row a frame, with whether it is hidden. Adds `shows`, the frame to be shown in its place (null for a uniform one), and `effect`, what is done to it (null for nothing). cut
    leaves hidden frames out; freeze shows the last frame before that isn't hidden, or the first of all; black and mean show one
    of that kind; blur blurs the frame itself."""
    if mode not in MASKS:
        raise ValueError(f"unknown mask {mode!r}")
    covered, own = F.coalesce(F.col(hidden), F.lit(False)), F.col(frame)
    none = F.lit(None).cast("string")
    if mode == "cut":
        return frames.where(~covered).withColumns({"shows": own, "effect": none})
    if mode == "freeze":
        order = W.partitionBy(key).orderBy(frame)
        last = F.last(F.when(~covered, own), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
        return frames.withColumns({"shows": F.coalesce(last, F.min(frame).over(W.partitionBy(key))), "effect": none})
    effect = F.when(covered, mode)
    return frames.withColumns({"shows": F.when(~covered | F.lit(mode == "blur"), own), "effect": effect})


def apportion(rows: DataFrame, key: str, idx: str, share: str, seats: int) -> DataFrame:
    """Seats by share: rounded half to even, then the difference goes by remainder, one each in turn, as often as needed."""
    by = W.partitionBy(key)
    exact = seats * F.col(share) / F.sum(share).over(by)
    rounded = rows.withColumn("exact", exact).withColumn("base", F.rint("exact").cast("int"))
    rounded = rounded.withColumn("gap", F.lit(seats) - F.sum("base").over(by)).withColumn("n", F.count("*").over(by))
    rest = F.col("exact") - F.col("base")
    place = F.row_number().over(by.orderBy((rest * F.signum("gap")).desc(), idx))
    turns = F.floor((F.abs("gap") - place) / F.col("n")) + 1
    return rounded.withColumn("seats", (F.col("base") + F.signum("gap") * F.when(place <= F.abs("gap"), turns).otherwise(0)).cast("int")).select(key, idx, "seats")


def uniform_starts(room: Column, clips: int) -> Column:
    """Starts of clips spread over the room, halves to even."""
    if clips <= 1:
        return F.array(F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(clips - 1)), lambda i: F.rint(i * room / (clips - 1)).cast("int"))


def importance_quantiles(segments: DataFrame, shares: list[float]) -> DataFrame:
    """The first segment where cumulative weight reaches each share of the total."""
    by = W.partitionBy("video_id")
    total = F.sum("weight").over(by)
    cum = F.sum("weight").over(by.orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    rows = segments.select("video_id", "idx", cum.alias("cum"), total.alias("total")).where(F.col("total") > 0).withColumn("q", F.explode(F.array(*map(F.lit, shares))))
    return rows.where(F.round("cum", 9) >= F.round(F.col("q") * F.col("total"), 9)).groupBy("video_id", "q").agg(F.min("idx").alias("idx"))


def first_fit_decreasing(items: DataFrame, key: str, ids: list[str], cost: str, budget: float, most: int) -> DataFrame:
    """Packs each key's items into bins: largest first, into the first bin with room for cost and count; an item over the
    budget gets a bin of its own. Sequential within a key, so choose keys that bound a group's size."""
    kinds = dict(items.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (key, *ids)] + ["bin int"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([cost, *ids], ascending=[False] + [True] * len(ids), kind="stable")
        room: list[list[float]] = []
        out = []
        for c in rows[cost]:
            k = next((k for k, (left, n) in enumerate(room) if c <= left and n < most), len(room))
            if k == len(room):
                room.append([budget, 0])
            room[k][0] -= c
            room[k][1] += 1
            out.append(k)
        return rows[[key, *ids]].assign(bin=out)

    return items.select(key, *ids, cost).groupBy(key).applyInPandas(pack, schema)


def linspace(n: Column, count: int) -> Column:
    """count places spread over n items, halves to even; with fewer items the last repeats."""
    picks = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(count)) - 1), lambda i: F.rint(i * (n - 1) / F.greatest(F.least(n, F.lit(count)) - 1, F.lit(1))).cast("int"))
    return F.when(n > 0, F.concat(picks, F.array_repeat((n - 1).cast("int"), F.greatest(count - n, F.lit(0)).cast("int"))))


def strided(n: Column, stride: float) -> Column:
    """Places 0, stride, 2 * stride, ... under n, rounded half to even."""
    steps = F.ceil(n / stride).cast("int")
    return F.when(n > 0, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), lambda i: F.rint(i * stride).cast("int")), lambda x: x < n))


def thinned_frames(start: Column, end: Column, weight: Column, fps: float, frames: Column, step: int = 1) -> Column:
    """Frames of one kept segment at a density: weight over duration, in [0, 1], of its frames, one at least, spread evenly (halves to even).
    Frame numbers are rounded and stop at the last frame; a segment beyond it has none."""
    first, last = F.greatest(F.rint(start * fps), F.lit(0.0)).cast("int"), F.least(F.rint(end * fps), frames - 1).cast("int")
    n = F.floor((last - first) / step).cast("int") + 1
    density = F.least(F.greatest(weight / F.greatest(end - start, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
    m = F.greatest(F.rint(n * density).cast("int"), F.lit(1))
    picks = F.transform(F.sequence(F.lit(0), F.least(m, F.greatest(n, F.lit(1))) - 1), lambda i: F.when(m >= n, i).otherwise(F.rint(i * (n - 1) / F.greatest(m - 1, F.lit(1))).cast("int")))
    return F.when(last >= first, F.transform(picks, lambda i: first + i * step)).otherwise(F.array().cast("array<int>"))


def pooled_clips(pool: Column, per_clip: int, clips: int) -> Column:
    """Clips of per_clip neighbouring frames of a pool, their starts spread evenly (a single one: the centre). A pool no longer than a
    clip is every clip, its last frame repeated; an empty pool is frame 0."""
    full = F.when(F.size(pool) > 0, pool).otherwise(F.array(F.lit(0)))
    room = F.greatest(F.size(full) - per_clip, F.lit(0))
    starts = F.array((room / 2).cast("int")) if clips == 1 else uniform_starts(room, clips)
    padded = F.concat(full, F.array_repeat(F.element_at(full, -1), F.greatest(per_clip - F.size(full), F.lit(0))))
    return F.when(room > 0, F.transform(starts, lambda s: F.slice(full, s + 1, per_clip))).otherwise(F.array_repeat(padded, clips))


def hybrid_starts(items: Column, frames: Column, fps: float, clips: int, per_clip: int, step: int = 1, share: float = 0.5) -> Column:
    """Clip starts, a share of them (rounded up, one at least) at quantiles of the frames' cumulative weight, the rest spread evenly; the two
    may coincide. items: structs of start_s, end_s, weight; a frame in several has the last one's weight, a frame in none has none.
    Without any weight all starts are spread evenly."""
    anchors = min(clips, max(1, ceil(clips * share)))
    last = F.greatest(frames - per_clip * step, F.lit(0)).cast("int")
    even = lambda n: F.array((last / 2).cast("int")) if n == 1 else uniform_starts(last, n)

    def weight(placed_items: Column, f: Column) -> Column:
        over = F.filter(placed_items, lambda x: (x["a"] <= f) & (f <= x["b"]) & (f < frames))
        return F.coalesce(F.try_element_at(over, F.lit(-1))["weight"].cast("double"), F.lit(0.0))

    def reached(weights: Column, goal: Column) -> Column:
        """The number of frames before the cumulative weight reaches the goal."""
        state = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        return F.aggregate(weights, state, lambda a, w: F.struct((a["s"] + w).alias("s"), (a["n"] + (a["s"] + w < goal).cast("int")).alias("n")), lambda a: F.least(a["n"], last))

    def placed(weights: Column, total: Column) -> Column:
        found = F.transform(F.array(*[F.lit((i + 0.5) / anchors) for i in range(anchors)]), lambda q: let(q * total, lambda goal: reached(weights, goal)))
        rest = even(clips - anchors) if clips > anchors else F.array().cast("array<int>")
        none = even(clips) if clips > anchors else F.array().cast("array<int>")
        return F.when(total > 0, F.array_sort(F.concat(found, rest))).otherwise(none)

    bounds = F.transform(items, lambda x: F.struct(F.rint(x["start_s"] * fps).alias("a"), F.rint(x["end_s"] * fps).alias("b"), x["weight"].alias("weight")))
    weights = let(bounds, lambda those: F.transform(F.sequence(F.lit(0), F.greatest(frames, F.lit(1)) - 1), lambda f: weight(those, f)))
    return let(weights, lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: placed(w, total)))


def tiles(width: Column, height: Column, size: int = 448, least: int = 1, most: int = 12) -> Column:
    """(columns, rows) of the grid of square tiles nearest to an image's proportions. Of grids equally near, the largest whose half area
    the image exceeds, else the smallest; grids of one area in order of columns."""
    grids = sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most), key=lambda g: (g[0] * g[1], g))
    off = lambda g: F.abs(width / height - g["columns"] / g["rows"])
    known = F.array(*[F.struct(F.lit(i).alias("columns"), F.lit(j).alias("rows")) for i, j in grids])
    nearest = let(F.array_min(F.transform(known, off)), lambda d: F.filter(known, lambda g: off(g) == d))
    fits = lambda g: width * height > 0.5 * size * size * g["columns"] * g["rows"]
    return let(nearest, lambda near: F.coalesce(F.try_element_at(F.filter(near, fits), F.lit(-1)), F.get(near, 0)))
