"""Bootstrap by resampling weights, and the rules that read intervals and p-values off its replicates.

A row of key k counts in replicate r as often as a Poisson variable of mean 1 says, drawn by a hash of seed, k and r: rows need no numbers, no draws are
made or shuffled, and rows with equal keys are drawn together. A task holds the sums of all replicates for the groups it meets and passes on
one row a group. Replicate -1 counts every row once: it is what was observed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of a published 32-bit mixing function, and the odd number next to 2**32 divided by the golden ratio.
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))
STRIDE = 0x9E3779B9
#: A weight is how many of these a 32-bit number reaches: 2**32 times the distribution function of a Poisson variable of mean 1.
REACHED = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Groups whose sums a task holds, and rows that it weighs at once.
GROUPS, ROWS = 256, 512


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x


def weights(high: np.ndarray, low: np.ndarray, replicates: int) -> np.ndarray:
    """Counts of rows (by two 32-bit words of a digest) in replicates, a row each."""
    stride = np.arange(1, replicates + 1, dtype=np.uint32) * np.uint32(STRIDE)
    words = mixed(low[:, None] ^ mixed(high[:, None] + stride))
    return np.searchsorted(np.array(REACHED, np.uint32), words, side="right").astype(np.float64)


def replicate_sums(rows: DataFrame, key: list[str], features: dict[str, Column], replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """For each group and replicate r (from -1): the sum of the counts as `n`, and of count * feature for each feature. Rows
    with a null feature take no part."""
    by, names = by or [], list(features)
    kinds = dict(rows.dtypes)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    given = rows.select(F.struct(*by).alias("by") if by else F.lit(0).alias("by"), word(1).alias("high"), word(9).alias("low"), *[c.cast("double").alias(f"f{i}") for i, c in enumerate(features.values())])
    given = given.dropna(subset=[f"f{i}" for i in range(len(names))])
    group = f"struct<{', '.join(f'`{c}`: {kinds[c]}' for c in by)}>" if by else "int"
    schema = f"by {group}, sums array<array<double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.Scalar, np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                groups = pa.concat_arrays([pa.array([g.as_py()], type=g.type) for g, _ in held.values()])
                sums = pa.array([s.tolist() for _, s in held.values()], type=pa.list_(pa.list_(pa.float64())))
                held.clear()
                yield pa.RecordBatch.from_arrays([groups, sums], names=["by", "sums"])

        for batch in batches:
            high, low = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint32) for c in ("high", "low"))
            x = np.stack([np.ones(batch.num_rows), *(batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(names)))], axis=1)
            groups = batch.column("by")
            places: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups.to_pylist()):
                places.setdefault(tuple(g.values()) if by else (), []).append(i)
            for g, at in places.items():
                if g not in held and len(held) >= GROUPS:
                    yield from flushed()
                sums = held.setdefault(g, (groups[at[0]], np.zeros((replicates + 1, len(names) + 1))))[1]
                for k in range(0, len(at), ROWS):
                    part = np.array(at[k : k + ROWS])
                    sums[0] += x[part].sum(axis=0)
                    sums[1:] += weights(high[part], low[part], replicates).T @ x[part]
        yield from flushed()

    each = given.mapInArrow(run, schema).select(*[F.col(f"by.{c}").alias(c) for c in by], F.posexplode("sums").alias("__r", "__s"))
    sums = [F.sum(F.col("__s")[i]).alias(n) for i, n in enumerate(["n", *names])]
    return each.groupBy(*by, (F.col("__r") - 1).alias("r")).agg(*sums)


def replicate_means(rows: DataFrame, key: list[str], values: list[str], replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """For each group and replicate the values' means, null in one that drew no row."""
    sums = replicate_sums(rows, key, {v: F.col(v) for v in values}, replicates, seed, by)
    return sums.select(*(by or []), "r", "n", *[F.try_divide(F.col(v), F.col("n")).alias(v) for v in values])


def replicate_pearson(rows: DataFrame, key: list[str], x: str, y: str, replicates: int, seed: int, by: list[str] | None = None, least_std: float = 1e-9) -> DataFrame:
    """For each group and replicate `value`, the correlation of x and y; null where one of them hardly varies."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = replicate_sums(rows, key, {"x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}, replicates, seed, by)
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    spread = lambda c: F.sqrt(F.greatest(mean(c + c) - mean(c) * mean(c), F.lit(0.0)))
    varied = (spread("x") >= least_std) & (spread("y") >= least_std)
    return sums.select(*(by or []), "r", "n", F.when(varied, (mean("xy") - mean("x") * mean("y")) / (spread("x") * spread("y"))).alias("value"))


def collected(replicates: DataFrame, values: list[str], by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Per group: `n` rows, and for each value v its observed `v` and `v_s`, the sorted replicates that are defined. Their number is what was asked
    for, so a row stays small."""
    own = F.col("r") >= 0
    found = [F.max(F.when(~own, F.col("n"))).cast("long").alias("n")]
    for v in values:
        found += [F.max(F.when(~own, F.col(v))).alias(v), F.array_sort(F.collect_list(F.when(own, F.round(F.col(v), digits)))).alias(f"{v}_s")]
    return replicates.groupBy(*(by or [])).agg(*found)


def linear(s: Column, q: float) -> Column:
    """The q-quantile of a sorted array, linear between order statistics."""
    place = (F.size(s) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    return F.get(s, low) + (place - low) * (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low))


def at_share(s: Column, q: float, less: int = 0) -> Column:
    """The element at place int(q * size) - less of a sorted array."""
    return F.get(s, (F.floor(F.size(s) * F.lit(q)) - less).cast("int"))


def _share(s: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_divide(F.size(F.filter(s, test)).cast("double"), F.size(s))


def centred_p(s: Column, observed: Column) -> Column:
    """Two-sided p of replicates shifted by the observed value: twice the smaller tail at its size, between 1/B and 1, null without replicates. Tolerates 1e-9."""
    size = F.abs(observed) - 1e-9
    p = 2 * F.least(_share(s, lambda d: d - observed >= size), _share(s, lambda d: d - observed <= -size))
    return F.when(F.size(s) > 0, F.least(F.lit(1.0), F.greatest(1 / F.size(s), p)))


def sign_p(s: Column, observed: Column) -> Column:
    """Twice the share of replicates that are zero or on its other side, at most 1, null without replicates."""
    other = F.when(observed >= 0, _share(s, lambda d: d <= 0)).otherwise(_share(s, lambda d: d >= 0))
    return F.when(F.size(s) > 0, F.least(F.lit(1.0), 2 * other))
