"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    met = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("node"))
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = _least(down)
    met = down.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node"))
    out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns node, root (least node of its component) for nodes other than roots.
    Each round is written to the shared folder; the rounds grow with the logarithm of a component's diameter."""
    now = materialize(edges.where(F.col("a") != F.col("b")), "edges")
    print_of = [F.count("*"), F.bit_xor(F.xxhash64("a", "b"))]
    seen = None
    while True:
        now = materialize(_small_star(_large_star(now)), "edges")
        mark = tuple(now.agg(*print_of).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
