"""Selection by a condition's name. Each condition is an expression over the segments of one video, gathered once, so any number of
conditions is one aggregation and one projection. A video's segments are few (its length over the segment length), so its array is small.

Conditions: full, full-single, vlm-selected, vlm-strict-0.9, vlm-weighted, vlm-score-threshold-tNN, vlm-fastforward-aNN,
lowest-evidence-fastforward-aNN, lowest-evidence, random, uniform, uniform-vs-strict-0.9, motion, uniform-equal-segs,
id-ORDER-fNN (vlm, anti-vlm, random, temporal, motion), vlm-aggregate, vlm-anchored, vlm-anchored-hybrid."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.text import let
from keelson.operators.select import tolerance

# The weight that counts as strict, and (above and below) the conditions' names.
STRICT = 0.9
#: Why nothing could be selected. A missing motion score is transient: the row is tried again, not written.
EMPTY_POOL, NO_SCORE, NO_STRICT, NOTHING = "nothing to choose from", "unscored", "none strict", "none chosen"


def gather(segments: DataFrame, motion: str = "weight2", videos: DataFrame | None = None) -> DataFrame:
    """video_id, items: idx i, duration d, weight w, motion m, importance flag v. videos: all video_ids, also those without segments."""
    item = F.struct(F.col("idx").alias("i"), F.col("dur").alias("d"), F.coalesce("weight", F.lit(0.0)).alias("w"), F.col(motion).alias("m"), (F.col("label") == "important").alias("v"))
    by = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.array().cast(by.schema["items"].dataType)
    return by if videos is None else videos.select("video_id").distinct().join(by, "video_id", "left").withColumn("items", F.coalesce("items", empty))


def _indices(items: Column) -> Column:
    return F.array_sort(F.transform(items, lambda x: x["i"]))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x["d"])


def _by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items in order of a key, then of idx."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(key(x).alias("k"), x["i"].alias("n"), x.alias("x")))), lambda y: y["x"])


def seed_text(seed: int, condition: str) -> Column:
    """Hexadecimal seed of a video and condition."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("video_id").cast("string"), F.lit(condition)), 256), 1, 16)


def _hash(seed: int) -> Callable[[Column], Column]:
    return lambda x: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("video_id").cast("string"), x["i"].cast("string")))


def _crossing(ordered: Column, goal: Column) -> Column:
    """Items in their order while the duration before them is under the goal."""
    state = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("k"))
    return F.aggregate(ordered, state, lambda a, x: F.struct((a["s"] + x["d"]).alias("s"), F.when(a["s"] < goal, F.array_append(a["k"], x["i"])).otherwise(a["k"]).alias("k")), lambda a: F.array_sort(a["k"]))


def _edges(items: Column, goal: Column, tol: Column, one: Column, rest: Column) -> Column:
    """All segments where the goal is about everything, one where it is about nothing."""
    return F.when(goal >= _sum(items) - tol, _indices(items)).when(goal <= tol, F.array(one)).otherwise(rest)


def _tolerance(items: Column) -> Column:
    return tolerance(F.transform(items, lambda x: x["d"]))


def greedy(items: Column, ordered: Column, goal: Column) -> Column:
    """In the order, a segment joins unless it overshoots the goal by more than the tolerance, until the sum is within it;
    if it never is, segments in the order up to the one that crosses the goal."""

    def known(once: Column) -> Column:
        own, aim, tol = once["ordered"], once["goal"], once["tol"]

        def step(a: Column, x: Column) -> Column:
            fits = (F.abs(a["s"] - aim) > tol) & (a["s"] + x["d"] <= aim + tol)
            return F.when(fits, F.struct((a["s"] + x["d"]).alias("s"), F.array_append(a["k"], x["i"]).alias("k"))).otherwise(a)

        state = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("k"))
        near = F.aggregate(own, state, step, lambda a: F.when(F.abs(a["s"] - aim) <= tol, F.array_sort(a["k"])))
        return _edges(items, aim, tol, F.get(own, F.lit(0))["i"], F.coalesce(near, _crossing(own, aim)))

    return let(F.struct(ordered.alias("ordered"), goal.alias("goal"), _tolerance(items).alias("tol")), known)


def spread(n: Column, count: Column) -> Column:
    """Places of count items spread over n, halves to even; one: the centre."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(2)) - 1), lambda j: F.rint(j * (n - 1) / (F.greatest(count, F.lit(2)) - 1)).cast("int")))
    return F.when(count <= 1, F.array((n / 2).cast("int"))).otherwise(many)


def uniform(items: Column, goal: Column) -> Column:
    """Evenly spread segments whose duration is near the goal: of the count that the mean duration suggests, one more, one less, two
    more, two less, the first within the tolerance; else the nearest of those up to three away, the fewest on ties."""
    n = F.size(items)

    def known(once: Column) -> Column:
        aim, tol, guess = once["goal"], once["tol"], once["guess"]

        def trial(count: Column) -> Column:
            off = lambda places: F.abs(F.aggregate(places, F.lit(0.0), lambda a, p: a + F.get(items, p)["d"]) - aim)
            return let(spread(n, count), lambda places: F.struct(off(places).alias("off"), count.alias("count"), F.transform(places, lambda p: F.get(items, p)["i"]).alias("k")))

        first = F.filter(F.array(*[guess + k for k in (0, 1, -1, 2, -2)]), lambda c: (c >= 1) & (c <= n))
        hits = F.filter(F.transform(first, trial), lambda t: t["off"] <= tol)
        best = F.array_min(F.transform(F.sequence(F.greatest(guess - 3, F.lit(1)), F.least(guess + 3, n)), trial))
        return _edges(items, aim, tol, F.get(items, (n / 2).cast("int"))["i"], F.coalesce(F.get(hits, F.lit(0))["k"], best["k"]))

    def guessed(once: Column) -> Column:
        guess = F.least(F.greatest(F.rint(F.try_divide(once["goal"], _sum(items) / n)).cast("int"), F.lit(1)), n)
        return let(F.struct(once["goal"].alias("goal"), once["tol"].alias("tol"), guess.alias("guess")), known)

    return F.when(n > 0, let(F.struct(goal.alias("goal"), _tolerance(items).alias("tol")), guessed))


def choose(condition: str, seed: int = 42) -> Column:
    """kept (indices) and reason (of failure, or null) of gathered items under a condition, each made once a row."""
    items = F.col("items")
    chosen = F.filter(items, lambda x: x["v"])
    strict = F.filter(items, lambda x: x["w"] >= STRICT)
    goal, fewest = _sum(chosen), F.greatest(F.size(chosen), F.lit(1))
    unscored = F.exists(items, lambda x: x["m"].isNull())
    none = F.array().cast("array<int>")
    fails: list[tuple[Column, str]] = []
    match = re.fullmatch(r"(vlm-score-threshold-t|(?:vlm|lowest-evidence)-fastforward-a|id-(?:vlm|anti-vlm|random|temporal|motion)-f)(\d{1,3})", condition)
    if match and match[1].endswith("-a") or condition in ("vlm-aggregate", "vlm-anchored", "vlm-anchored-hybrid"):
        kept = _indices(items)
    elif match and match[1].startswith("vlm-score"):
        over = F.filter(items, lambda x: x["w"] >= int(match[2]) / 100)
        kept = F.when(F.size(over) > 0, _indices(over)).otherwise(_indices(F.slice(_by(items, lambda x: -x["w"]), 1, 1)))
    elif match:
        order = {"vlm": lambda x: -x["w"], "anti-vlm": lambda x: x["w"], "random": _hash(seed), "temporal": lambda x: x["i"], "motion": lambda x: -x["m"]}[match[1][3:-2]]
        ordered = _by(items, order)
        # one at least: no duration is under a goal of zero
        kept = F.coalesce(F.nullif(_crossing(ordered, int(match[2]) / 100 * _sum(items)), none), _indices(F.slice(ordered, 1, 1)))
        fails += [(unscored, NO_SCORE)] if match[1] == "id-motion-f" else []
    elif condition in ("full", "full-single"):
        return F.struct(none.alias("kept"), F.lit(None).cast("string").alias("reason"))
    elif condition in ("vlm-selected", "vlm-weighted"):
        kept = _indices(chosen)
    elif condition == "vlm-strict-0.9":
        kept, fails = _indices(strict), [(F.size(strict) == 0, NO_STRICT)]
    elif condition == "lowest-evidence":
        kept = _indices(F.slice(_by(items, lambda x: x["w"]), F.lit(1), fewest))
    elif condition == "random":
        kept = greedy(items, _by(items, _hash(seed)), goal)
    elif condition == "motion":
        kept, fails = greedy(items, _by(items, lambda x: -x["m"]), goal), [(unscored, NO_SCORE)]
    elif condition == "uniform":
        kept = uniform(items, goal)
    elif condition == "uniform-vs-strict-0.9":
        kept, fails = uniform(items, _sum(strict)), [(F.size(strict) == 0, NO_STRICT)]
    elif condition == "uniform-equal-segs":
        kept = F.array_sort(F.transform(spread(F.size(items), F.least(fewest, F.size(items))), lambda p: F.get(items, p)["i"]))
    else:
        raise ValueError(f"unknown condition {condition!r}")
    early = F.when(F.size(items) == 0, EMPTY_POOL)
    for failed, why in fails:
        early = early.when(failed, why)

    def judged(found: Column) -> Column:
        reason = F.coalesce(found["early"], F.when(F.size(found["kept"]) == 0, NOTHING))
        return F.struct(F.when(reason.isNull(), found["kept"]).otherwise(none).alias("kept"), reason.alias("reason"))

    return let(early, lambda e: let(F.struct(e.alias("early"), F.when(e.isNull(), kept).otherwise(none).alias("kept")), judged))


def run(gathered: DataFrame, conditions: list[str], seed: int = 42) -> DataFrame:
    """One row a video and condition: video_id, condition, kept, failed, reason. Arrays are made in one pass for all conditions."""
    found = [choose(c, seed).alias(f"c{n}") for n, c in enumerate(conditions)]
    each = [F.struct(F.lit(c).alias("condition"), F.col(f"c{n}.kept"), F.col(f"c{n}.reason").isNotNull().alias("failed"), F.col(f"c{n}.reason")) for n, c in enumerate(conditions)]
    return gathered.select("video_id", *found).select("video_id", F.explode(F.array(*each)).alias("x")).select("video_id", "x.*")


def to_write(selected: DataFrame) -> DataFrame:
    """Rows of failures that are written, as neither top-1 nor top-5 correct; transient ones aren't, so that they are tried again."""
    failed = selected.where(F.col("failed") & (F.col("reason") != NO_SCORE))
    return failed.select("video_id", "condition", "reason", F.lit(False).alias("top1"), F.lit(False).alias("top5"))


def to_retry(selected: DataFrame) -> DataFrame:
    return selected.where(F.col("failed") & (F.col("reason") == NO_SCORE)).select("video_id", "condition")
