"""Incremental ingest: new records once, rolling rate limits, windowed counts of late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def record_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events with ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first record of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, by: list[str], late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def pending(batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no output yet."""
    return batch.join(done.select(*keys).distinct(), keys, "left_anti")


#: Parts of a target by key.
BUCKETS = 256


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends only keys that the target lacks. Every batch is a part of the target by its number and, within, by a hash of the keys: a batch looks only where its own keys
    would be, and one that is run again replaces what it had written."""
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(keys).withColumn("_bucket", bucket).persist()
        try:
            own = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # BUCKETS at most
            path = spark._jvm.org.apache.hadoop.fs.Path(target)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                done = read_appended(spark, target, batch.schema).where(F.col("_bucket").isin(own) & (F.col("_batch") != number))
                fresh_rows = pending(fresh, done, keys)
            else:
                fresh_rows = fresh
            fresh_rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target.rstrip('/')}/_batch={number}")
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """What append_new has written, with the parts _batch and _bucket."""
    parts = StructType([*schema.fields, StructField("_batch", LongType()), StructField("_bucket", IntegerType())])
    return spark.read.schema(parts).parquet(target)
