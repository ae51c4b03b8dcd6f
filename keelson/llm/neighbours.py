"""Approximate nearest neighbours by a permutation index, for the largest inner product.

PIVOTS vectors, taken by a hash of all vectors, stand for places. Each vector is represented by its PREFIX nearest pivots in order
(a permutation prefix), and posted under each of them with its position there: pivot inverted files. A query merges
the lists of its own nearest pivots and ranks what it meets by footrule distance, the sum of the differences of the
positions, where a missing pivot counts as position PREFIX. The best candidates are reranked by the exact inner product in double
precision; there are GROWTH times the square root of all vectors of them, 10 k at least, so the share that is scored exactly falls as the table grows.

The index is a table, built and written once, with a row for each block of BLOCK vectors: their ids, vectors and inverted files. Sets of
QUERIES queries are set against all blocks, so no task holds more than a block and a set. Merging the lists costs a query
PREFIX**2 / PIVOTS additions for each vector: the queries are a share of all rows, so that part grows with the square of the table.

Many copies of one vector don't crowd out others: of equal vectors only the k + 1 smallest vec_ids can be among
the nearest k, and only those are indexed (every different vector is). Recall at 20 is measured in tests against brute force.

Defined cases: null, empty or zero vectors, those with null or non-finite components, and those whose length isn't the most
common (the larger on a tie) take no part; rows with a null vec_id neither; ties go to the smaller vec_id; a query's own
vec_id is never its neighbour; fewer candidates than k give fewer rows; repeated query rows count once; repeated candidate
rows are one candidate; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import materialize, table

PIVOTS, PREFIX, GROWTH = 512, 128, 5
BLOCK, QUERIES = 8192, 8192
FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, once each."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & sound & some)
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0)).distinct()


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots in order, ties to the first pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """For each pivot, which vectors of a block have it in their prefix, and where."""

    def __init__(self, rows: np.ndarray, places: np.ndarray, starts: np.ndarray, prefix: int, size: int) -> None:
        self.rows, self.places, self.starts, self.prefix, self.size = rows, places, starts, prefix, size

    @classmethod
    def of(cls, x: np.ndarray, pivots: np.ndarray, prefix: int) -> InvertedFiles:
        order = prefixes(x, pivots, prefix)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        starts = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))
        return cls((by_pivot // order.shape[1]).astype(np.int32), (by_pivot % order.shape[1]).astype(np.int16), starts, order.shape[1], len(x))

    def nearest(self, own: np.ndarray, count: int) -> np.ndarray:
        """Rows with the least footrule distance to a query whose prefix is `own`: a shared pivot saves
        2 * prefix - i - j of the distance without it and costs |i - j|."""
        if self.size <= count:
            return np.arange(self.size)
        spans = [slice(self.starts[p], self.starts[p + 1]) for p in own]
        rows = np.concatenate([self.rows[s] for s in spans])
        saved = np.concatenate([2 * self.prefix - i - self.places[s] - np.abs(self.places[s] - i) for i, s in enumerate(spans)])
        return np.argpartition(-np.bincount(rows, saved, minlength=self.size), count - 1)[:count]


def _matrix(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(n, -1)


BLOCKS = "block long, ids binary, vectors binary, rows binary, places binary, starts binary, prefix int"


def index(vectors: DataFrame, pivots: np.ndarray, n_blocks: int, prefix: int = PREFIX) -> DataFrame:
    """The permutation index of vec_id, embedding: a row a block, with its vectors and their inverted files."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_list()).astype(np.float64)
        files = InvertedFiles.of(x, pivots, prefix)
        parts = (rows["vec_id"].to_numpy(np.int64), x, files.rows, files.places, files.starts.astype(np.int64))
        return pd.DataFrame([(key[0], *(np.ascontiguousarray(v).tobytes() for v in parts), files.prefix)], columns=["block", "ids", "vectors", "rows", "places", "starts", "prefix"])

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    return materialize(dealt.groupBy("block").applyInPandas(build, BLOCKS), "index")


def _asked(queries: DataFrame, pivots: np.ndarray, n_sets: int, prefix: int) -> DataFrame:
    """A row for each set of queries: their ids, vectors and prefixes."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_list()).astype(np.float64)
        own = prefixes(x, pivots, prefix).astype(np.int32)
        return pd.DataFrame([(key[0], rows["vec_id"].to_numpy(np.int64).tobytes(), x.tobytes(), np.ascontiguousarray(own).tobytes())], columns=["set", "query_ids", "queries", "own"])

    dealt = queries.withColumn("set", F.pmod(F.xxhash64("vec_id"), F.lit(n_sets)))
    return dealt.groupBy("set").applyInPandas(build, "set long, query_ids binary, queries binary, own binary")


def candidates_of_block(n: int, n_blocks: int, k: int, growth: float) -> int:
    """Candidates that a block gives a query: its part of all, and three standard deviations of what chance puts there."""
    part = max(10 * k, growth * n**0.5) / n_blocks
    return int(np.ceil(part + (3 * part**0.5 if n_blocks > 1 else 0)))


def search(vectors: DataFrame, every: int, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, growth: float = GROWTH, block: int = BLOCK) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = materialize(valid(vectors), "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    places = np.array([r[0] for r in rows.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(pivots).collect()], dtype=np.float64)
    n_blocks, n_sets = max(1, -(-n // block)), max(1, -(-asked // QUERIES))
    first = W.partitionBy("embedding").orderBy("vec_id")
    once = rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1).drop("copy")
    count = candidates_of_block(n, n_blocks, k, growth)
    blocks = index(once, places, n_blocks, prefix).withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sets - 1).cast("long"))))
    sets = _asked(rows.where(F.col("vec_id") % every == 0), places, n_sets, prefix).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, query_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["query_ids"], np.int64)
                x, queries = _matrix(r["vectors"], len(ids)), _matrix(r["queries"], len(query_ids))
                own = np.frombuffer(r["own"], np.int32).reshape(len(query_ids), -1)
                files = InvertedFiles(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["places"], np.int16), np.frombuffer(r["starts"], np.int64), r["prefix"], len(ids))
                out = []
                for query_id, q, o in zip(query_ids, queries, own, strict=True):
                    near = files.nearest(o, count)
                    near = near[ids[near] != query_id]
                    score = (x[near] * q).sum(axis=1)
                    best = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(best), query_id), ids[near][best], score[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    met = blocks.join(sets, ["block", "set"]).mapInArrow(run, FOUND)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=20)
