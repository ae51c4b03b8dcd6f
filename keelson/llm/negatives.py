"""Hard-negative mining by a vertical scan with branch and bound (BOND).

Vectors are written in blocks of BLOCK, each by columns: one array of a block's values for each dimension, with the dimension's least and greatest value.
An anchor reads a block's dimensions in descending order of its own magnitudes, STEP at a time, and adds their products up for the candidates
that are left. What the dimensions still unread can add lies between the sums of their least and of their greatest products, so each
candidate has bounds, and those that can't count any more leave the bitmap; when all dimensions are read, scores are exact.

First scan: candidates have the anchor's label, and go when their upper bound is below the POSITIVES-th best lower bound. Second scan: candidates have another
label. Each positive has a window of scores, and a candidate goes when it lies outside of all of them, or when each window that it may lie in has
NEGATIVES candidates already that surely lie in it and are better.

Anchors are a stated query set, in sets of ANCHORS, and each set scans each block: a task holds one block and one set. Every block gives its own best,
and the best of all blocks are selected by windows, with what a task has selected already.

Scores are integers, so bounds and ties are exact: a component becomes floor(256 * x).

Defined cases: rows with a null vec_id, label or vector and those with null or non-finite components take no part, nor do those with a component of LARGEST or more in magnitude (products
would leave 64 bits); a shorter vector ends in zeros; equal rows are one row, and rows with the same vec_id and another vector or label are rows of their own,
never an anchor's own positives; ties go to the smaller vec_id; fewer rows give fewer positives and negatives; an anchor without
a positive has no row; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import arrow_schema, materialize, shuffle_partitions, table

BLOCK, ANCHORS, STEP = 16_384, 128, 8
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score that a negative's has at least, and at most.
LEAST, MOST = 30, 90
LARGEST = float(1 << 17)

BLOCKS = "block long, n int, ids binary, labels binary, columns array<binary>"
NEAR = "anchor_id long, label long, copy int, vec_id long, score long"
FOUND = "anchor_id long, copy int, positive_id long, place int, negative_id long, positive_score long, negative_score long"


def valid(vectors: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, x (the integer components) of the rows that take part, once each."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", lambda v: F.floor(v * 256).cast("int")).alias("x")).distinct()


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def columnar(vectors: DataFrame, dims: int, n_blocks: int) -> DataFrame:
    """A row for each block: ids, labels, and an array of values for each dimension."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["x"], dims).astype(np.int32)
        columns = [np.ascontiguousarray(x[:, d]).tobytes() for d in range(dims)]
        return pd.DataFrame([(key[0], len(x), rows["vec_id"].to_numpy(np.int64).tobytes(), rows["label"].to_numpy(np.int64).tobytes(), columns)], columns=["block", "n", "ids", "labels", "columns"])

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    return materialize(dealt.groupBy("block").applyInPandas(build, BLOCKS), "columns")


class Block:
    """A block by columns."""

    def __init__(self, r: dict) -> None:
        self.ids, self.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        self.columns = [np.frombuffer(c, np.int32).astype(np.int64) for c in r["columns"]]
        self.low = np.array([c.min() for c in self.columns], np.int64)
        self.high = np.array([c.max() for c in self.columns], np.int64)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Reads the dimensions for `rows`, in descending order of the anchor's magnitudes; keep(rows, lower, upper) says
        after each STEP of them who stays. Returns the rows left and their exact scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        rest_low, rest_high = ends.min(axis=0).sum(), ends.max(axis=0).sum()
        scores = np.zeros(len(rows), np.int64)
        for at in range(0, len(order), STEP):
            step = slice(at, at + STEP)
            for d in order[step]:
                scores += anchor[d] * self.columns[d][rows]
            rest_low, rest_high = rest_low - ends[:, step].min(axis=0).sum(), rest_high - ends[:, step].max(axis=0).sum()
            stay = keep(rows, scores + rest_low, scores + rest_high)
            if stay is not None and not stay.all():
                rows, scores = rows[stay], scores[stay]
            if not len(rows):
                break
        return rows, scores


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, if there are as many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def nearest_of_label(block: Block, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of the block with the anchor's label."""

    def keep(_: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray | None:
        kth = _kth(lower, k)
        return None if kth is None else upper >= kth

    rows, scores = block.scan(anchor, np.flatnonzero((block.labels == label) & (block.ids != anchor_id)), keep)
    best = np.lexsort((block.ids[rows], -scores))[:k]
    return block.ids[rows[best]], scores[best]


def window(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """Scores s with least * score <= 100 * s <= most * score."""
    return -(-least * score // 100), most * score // 100


def best_in_windows(block: Block, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, the k best rows of the block with another label whose scores lie in it."""

    def keep(_: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lower), bool)
        for low, high in windows:
            surely = lower[(lower >= low) & (upper <= high)]
            kth = _kth(surely, k)
            stay |= (upper >= (low if kth is None else max(low, kth))) & (lower <= high)
        return stay

    some = [w for w in windows if w[0] <= w[1]]
    rows, scores = block.scan(anchor, np.flatnonzero(block.labels != label), keep) if some else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = []
    for low, high in windows:
        here = np.flatnonzero((scores >= low) & (scores <= high))
        best = here[np.lexsort((block.ids[rows[here]], -scores[here]))[:k]]
        out.append((block.ids[rows[best]], scores[best]))
    return out


def _scanned(blocks: DataFrame, sets: DataFrame, n_blocks: int, n_sets: int, dims: int, scan, schema: str) -> DataFrame:
    """Sets each set of anchors against each block; scan(block, anchors' row, their matrix) gives rows."""
    arrow = arrow_schema(blocks.sparkSession, schema)
    parts = shuffle_partitions(blocks.sparkSession)  # a pair of block and set is seconds of work for a few MB, so its tasks aren't merged by size
    every_set, every_block = F.sequence(F.lit(0), F.lit(n_sets - 1)), F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
    ours = blocks.withColumn("set", F.explode(every_set)).repartition(parts, "block", "set")
    met = ours.join(sets.withColumn("block", F.explode(every_block)).repartition(parts, "block", "set"), ["block", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                out = list(scan(Block(r), r["anchors"], _matrix([a["x"] for a in r["anchors"]], dims)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return met.mapInArrow(run, schema)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """The hard negatives of each anchor (vec_id divisible by `every`) and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = materialize(valid(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, dims, n_asked = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.count_if(F.col("vec_id") % every == 0)).first()
    n_blocks, n_sets = max(1, -(-n // block)), max(1, -(-n_asked // anchors))
    blocks = columnar(rows, dims, n_blocks)
    copy = F.row_number().over(W.partitionBy("vec_id").orderBy("label", "x"))
    asked = asked.withColumn("copy", copy).withColumn("set", F.pmod(F.xxhash64("vec_id"), F.lit(n_sets)).cast("int"))

    def first(of: Block, anchors: list[dict], x: np.ndarray) -> Iterator[tuple]:
        for a, v in zip(anchors, x, strict=True):
            for vec_id, score in zip(*nearest_of_label(of, a["vec_id"], a["label"], v, positives), strict=True):
                yield a["vec_id"], a["label"], a["copy"], int(vec_id), int(score)

    sets = asked.groupBy("set").agg(F.collect_list(F.struct("vec_id", "label", "copy", "x")).alias("anchors"))
    near = _scanned(blocks, sets, n_blocks, n_sets, dims, first, NEAR)
    by_score = W.partitionBy("anchor_id", "copy").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= positives)
    kept = materialize(near.select("anchor_id", "copy", F.struct("place", "vec_id", "score").alias("p")).groupBy("anchor_id", "copy").agg(F.sort_array(F.collect_list("p")).alias("positives")), "positives")

    def second(of: Block, anchors: list[dict], x: np.ndarray) -> Iterator[tuple]:
        for a, v in zip(anchors, x, strict=True):
            windows = [window(p["score"], least, most) for p in a["positives"]]
            for p, (ids, scores) in zip(a["positives"], best_in_windows(of, a["label"], v, windows, negatives), strict=True):
                for vec_id, score in zip(ids, scores, strict=True):
                    yield a["vec_id"], a["copy"], p["vec_id"], p["place"], int(vec_id), p["score"], int(score)

    with_positives = asked.join(kept.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "copy"])
    sets = with_positives.groupBy("set").agg(F.collect_list(F.struct("vec_id", "label", "copy", "x", "positives")).alias("anchors"))
    found = _scanned(blocks, sets, n_blocks, n_sets, dims, second, FOUND)
    best = W.partitionBy("anchor_id", "copy", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
met AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM near JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM met WHERE rank <= 10"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
