"""Helpers of the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import materialize, table

__all__ = ["BATCH_ROWS", "give_back", "map_batches", "materialize", "shuffle_partitions", "small_batches", "table"]

#: Rows in an Arrow batch; whole texts pass through Python, so a batch must stay small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, most_bytes: int | None = None) -> None:
    """Bounds the rows of an Arrow batch, and its bytes where told, unless the session does already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if most_bytes is not None and spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most_bytes))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Returns a Python worker's free memory to the system: workers outlive tasks, and wait beside those of other stages."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def map_batches(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Applies a function of column lists to each Arrow batch, without a shuffle."""
    small_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def count_below(cuts: list, value: Column, include: bool = False) -> Column:
    """How many of sorted cuts are below a value (or equal to it): first among every k-th of them, then among the k in between."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    below = (lambda x: x <= value) if include else (lambda x: x < value)
    whole = F.size(F.filter(F.array(*map(F.lit, cuts[k - 1 :: k])), below)) * k
    return whole + F.size(F.filter(F.slice(F.array(*map(F.lit, cuts)), whole + 1, k), below))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
