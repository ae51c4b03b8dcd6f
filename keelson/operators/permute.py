"""Permutation nulls within videos: each video's permutations are arrays in its own task, and only sums by trial leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.resample import STRIDE, mixed

_SUMS = "sums array<array<double>>"
#: Numbers that a task's permutations of one size may hold at once.
HELD = 4_000_000
#: Places up to which orders are found by comparing all keys with each other, and numbers that are compared at a time.
COMPARED, AT_ONCE = 16, 1 << 16


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1 of each row."""
    below = (x[:, None, :] < x[:, :, None]).sum(axis=2)
    equal = (x[:, None, :] == x[:, :, None]).sum(axis=2)
    return below + (equal + 1) / 2


def permutations(high: np.ndarray, low: np.ndarray, n: int, trials: int) -> np.ndarray:
    """For videos by two 32-bit words of a digest: orders of n places, videos x trials x n. Place i has the key mix(low ^ mix(high + trial * STRIDE) + i * STRIDE);
    equal keys go by place."""
    return np.argsort(_keys(high, low, n, trials).transpose(1, 2, 0), axis=2, kind="stable")


def _keys(high: np.ndarray, low: np.ndarray, n: int, trials: int) -> np.ndarray:
    """Places x videos x trials."""
    stride = np.arange(1, trials + 1, dtype=np.uint32) * np.uint32(STRIDE)
    base = low[:, None] ^ mixed(high[:, None] + stride)
    return mixed(base + (np.arange(n, dtype=np.uint32) * np.uint32(STRIDE))[:, None, None])


def _rho(ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Correlation along the last axis; nan without variance."""
    a, b = ra - ra.mean(axis=-1, keepdims=True), rb - rb.mean(axis=-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def _jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of boolean masks along the last axis; 0 where both are empty."""
    return (a & b).sum(axis=-1) / np.maximum((a | b).sum(axis=-1), 1)


def _add(sums: np.ndarray, rho: np.ndarray, jaccard: np.ndarray) -> None:
    sums += np.stack([np.nansum(rho, axis=0), (~np.isnan(rho)).sum(axis=0), jaccard.sum(axis=0), np.full(len(sums), len(rho))], axis=1)


def _plain(a: np.ndarray, b: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Videos of few places, without nan, whose greatest weights, as many as were kept, are the same in any order: no equal weights are parted."""
    n, count = a.shape[1], kept.sum(axis=1)
    if n > COMPARED:
        return np.zeros(len(a), bool)
    down, rows = -np.sort(-a, axis=1), np.arange(len(a))
    parted = (count > 0) & (count < n) & (down[rows, np.maximum(count, 1) - 1] == down[rows, np.minimum(count, n - 1)])
    return ~(parted | np.isnan(a).any(axis=1) | np.isnan(b).any(axis=1))


def _add_sorted(sums: np.ndarray, high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray, kept_a: np.ndarray, kept_b: np.ndarray, trials: int) -> None:
    """Adds some videos of one size to the sums by trial."""
    order = permutations(high, low, a.shape[1], trials)
    ra, rb = _ranks(a), _ranks(b)
    rows = np.arange(len(a))[:, None, None]
    rho = np.concatenate([_rho(ra, rb)[:, None], _rho(ra[rows, order], rb[:, None, :])], axis=1)
    place = np.argsort(np.argsort(-a[rows, order], axis=2, kind="stable"), axis=2, kind="stable")
    shuffled = place < kept_a.sum(axis=1)[:, None, None]
    _add(sums, rho, np.concatenate([_jaccard(kept_a, kept_b)[:, None], _jaccard(shuffled, kept_b[:, None, :])], axis=1))


def _add_compared(sums: np.ndarray, high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray, kept_a: np.ndarray, kept_b: np.ndarray, trials: int) -> None:
    """The same for plain videos, a place at a time: what moves a weight needs no sorting, and neither ranks nor kept weights are found anew."""
    n, videos = a.shape[1], len(a)
    keys = _keys(high, low, n, trials)
    to = np.zeros((n, videos, trials), np.uint8)
    for j in range(n):
        for i in range(j):
            later = keys[j] < keys[i]
            to[i] += later
            to[j] += ~later
    ra, rb = _ranks(a), _ranks(b)
    ca, cb = ra - ra.mean(axis=1, keepdims=True), rb - rb.mean(axis=1, keepdims=True)
    count = kept_a.sum(axis=1)
    greatest = (a >= -np.sort(-a, axis=1)[np.arange(videos), np.maximum(count, 1) - 1][:, None]) & (count > 0)[:, None]
    first = np.arange(videos)[:, None] * n
    dot, both = np.zeros((videos, trials)), np.zeros((videos, trials))
    centred, kept = cb.ravel(), kept_b.astype(float).ravel()
    for j in range(n):
        at = first + to[j]
        dot += ca[:, j, None] * centred[at]
        both += greatest[:, j, None] * kept[at]
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = dot / np.sqrt((ca * ca).sum(axis=1) * (cb * cb).sum(axis=1))[:, None]
    jaccard = both / np.maximum((greatest.sum(axis=1) + kept_b.sum(axis=1))[:, None] - both, 1)
    _add(sums, np.concatenate([_rho(ra, rb)[:, None], rho], axis=1), np.concatenate([_jaccard(kept_a, kept_b)[:, None], jaccard], axis=1))


def null_by_trial(videos: DataFrame, key: str, trials: int, seed: int) -> DataFrame:
    """videos: key, a, b (arrays of two raters' weights, by place) and kept_a, kept_b (arrays of booleans). trial (-1: as observed), rho and jaccard: means over the videos,
    rho over those where it is defined. In a trial the first rater's weights are shuffled within each video, and as many of them as it kept, the greatest, are kept. Videos with
    arrays of different lengths or empty ones take no part."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    same = (F.size("a") == F.size("b")) & (F.size("a") > 0) & (F.size("kept_a") == F.size("a")) & (F.size("kept_b") == F.size("a"))
    given = videos.where(same).select(word(1).alias("high"), word(9).alias("low"), *[F.col(c).cast("array<double>").alias(c) for c in ("a", "b")], *[F.col(c).cast("array<int>").alias(c) for c in ("kept_a", "kept_b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trials + 1, 4))
        for batch in batches:
            words = [batch.column(c).to_numpy().astype(np.uint32) for c in ("high", "low")]
            sizes = pc.list_value_length(batch.column("a")).to_numpy()
            starts = np.cumsum(sizes) - sizes
            flat = [pc.fill_null(batch.column(c).flatten(), v).to_numpy().astype(t) for c, v, t in (("a", np.nan, float), ("b", np.nan, float), ("kept_a", 0, bool), ("kept_b", 0, bool))]
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                at = starts[rows, None] + np.arange(n)
                part = [*(w[rows] for w in words), *(x[at] for x in flat)]
                plain = _plain(*part[2:5])
                for which, add, step in ((plain, _add_compared, AT_ONCE // trials), (~plain, _add_sorted, HELD // (n * max(n, trials)))):
                    own = [x[which] for x in part]
                    for k in range(0, len(own[0]), max(1, step)):
                        add(sums, *(x[k : k + max(1, step)] for x in own), trials)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], type=pa.list_(pa.list_(pa.float64())))], names=["sums"])

    each = given.mapInArrow(run, _SUMS).select(F.posexplode("sums").alias("i", "s"))
    total = each.groupBy((F.col("i") - 1).alias("trial")).agg(*[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(4)])
    return total.where("s3 > 0").select("trial", F.try_divide("s0", "s1").alias("rho"), F.try_divide("s2", "s3").alias("jaccard"), F.col("s3").cast("long").alias("n"))


def null_summary(value: str, digits: int = 9) -> list[Column]:
    """Aggregates of a value over null_by_trial's rows: observed, p95 (the element at place int(0.95 * (trials - 1))), and the one-sided p with one added to both counts."""
    v = F.round(F.col(value), digits)
    observed, nulls = F.max(F.when(F.col("trial") < 0, v)), F.array_sort(F.collect_list(F.when(F.col("trial") >= 0, v)))
    p95 = F.get(nulls, F.floor((F.size(nulls) - 1) * F.lit(0.95)).cast("int"))
    p = F.when(observed.isNotNull() & (F.size(nulls) > 0), (F.size(F.filter(nulls, lambda x: x >= observed)) + 1) / (F.size(nulls) + 1))
    return [observed.alias(f"{value}_observed"), p95.alias(f"{value}_p95"), F.round(p, digits).alias(f"{value}_p")]
